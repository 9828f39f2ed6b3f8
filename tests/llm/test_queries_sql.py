"""The registered queries against their SQL, and the whole pipeline, on the smallest tables."""

import glob
import os

import brute
import duckdb
import pytest

from meshtide.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return made


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found), key=repr)
    assert rows(got.select(*columns).collect()) == rows([tuple(r[i] for i in at) for r in want.fetchall()])


def test_whole_pipeline(spark):
    """run() packs each document that passes all stages, once and whole; only clean documents of one text each are left."""
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for own in pieces.values():
        at = 0
        for start, length, _ in sorted(own):
            assert start == at
            at += length
        assert {n for *_, n in own} == {at}
    left = {i: texts[i] for i in pieces}
    assert 0.4 * len(texts) < len(left) < len(texts)
    assert all(r[3] for r in brute.exact_dedup(list(left.items())))
    assert set(brute.linked({i: brute.fingerprint(t) for i, t in left.items()}).items()) == {(i, i) for i in left}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not brute.contaminated(list(left.items()), items)
