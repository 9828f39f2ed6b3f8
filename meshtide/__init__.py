"""Mesh orientation analytics on Spark, with an optional training-data subpackage."""
