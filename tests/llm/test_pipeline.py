"""The pipeline's stages against plain versions on the smallest tables."""

import os

import brute
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "SimHash near-dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    clean = corpus_pipeline.saved(stages["toxicity"](spark, docs, SF), "t")
    assert clean.columns == docs.columns and 0.7 * len(rows) < clean.count() <= len(rows)
    rows = {r.doc_id: r.text for r in clean.collect()}

    single = corpus_pipeline.saved(stages["exact dedup"](spark, clean, SF), "t")
    assert {r.doc_id for r in single.collect()} == {r[0] for r in brute.exact_dedup(list(rows.items())) if r[3]}
    rows = {r.doc_id: r.text for r in single.collect()}

    apart = corpus_pipeline.saved(stages["SimHash near-dedup"](spark, single, SF), "t")
    linked = brute.linked({i: brute.fingerprint(t) for i, t in rows.items()})
    assert {r.doc_id for r in apart.collect()} == set(linked.values())
    rows = {r.doc_id: r.text for r in apart.collect()}

    last = corpus_pipeline.saved(stages["decontamination"](spark, apart, SF), "t")
    assert last.columns == docs.columns
    assert {r.doc_id for r in last.collect()} == set(rows) - {w[0] for w in brute.contaminated(list(rows.items()), items)}

    packed = stages["packing"](spark, last, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in last.collect()}
