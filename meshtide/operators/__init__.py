"""Operators on meshes."""
