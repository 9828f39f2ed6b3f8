"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.llm import decontamination, exact_dedup, html_text, line_dedup, ngram_lm, packing, secret_scan, simhash, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the byte-level tokenizer; its package is outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), threshold=0.8)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), max_length=2048, with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return toxicity.score_documents(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), max_bits=3)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.where(ngram_lm.is_training(F.col("doc_id"))))
    scored = ngram_lm.score_documents(docs, model)
    return scored.select("doc_id", (~ngram_lm.is_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_text": op6_html_text,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_lm": op10_ngram_lm,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
        ts AS (SELECT DISTINCT t.item_id, array_to_string(list_slice(t.w, u.i, u.i + 4), ' ') AS s FROM t, LATERAL (SELECT unnest(range(1, len(t.w) - 3)) AS i) u),
        ds AS (SELECT DISTINCT d.doc_id, array_to_string(list_slice(d.w, u.i, u.i + 4), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(d.w) - 3)) AS i) u),
        n AS (SELECT item_id, count(*) AS n_shingles FROM ts GROUP BY item_id),
        p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN ts USING (s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
        FROM p JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT d.doc_id, u.i, hash(list_slice(d.w, u.i, u.i + 19)) AS h, list_slice(d.w, u.i, u.i + 19) AS s FROM d, LATERAL (SELECT unnest(range(1, len(d.w) - 18)) AS i) u),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 20)) AS k)),
        words AS (SELECT d.doc_id, u.i, d.w[u.i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) u),
        kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS t
                 FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_line_dedup": r"""
        WITH lines AS (
            SELECT d.doc_id, u.i, d.parts[u.i] AS line,
                   translate(regexp_replace(d.parts[u.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.parts) + 1)) AS i) u),
        frequent AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id""",
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
}
