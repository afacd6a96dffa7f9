"""The query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, language_id, packing, pii, resampling, secret_scan, separator_scan, simhash, term_index, token_files, toxicity


def tokenizer_path(name: str) -> str:
    """A tokenizer file on this and every executor: in ``TOKENIZER_DIR`` if set, else where the package has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _crc_of_id(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labels of rows outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(_crc_of_id(3) != 1)
    return toxicity.fit(docs, labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_crc_of_id(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=50256)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_records(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_records(manifest, digest_only=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, _crc_of_id(4) != 2)
    got = language_id.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (_crc_of_id(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=4, bits=4)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = term_index.index(documents(spark, sf_dir))
    return term_index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), postings, k=10)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return resampling.resample(documents(spark, sf_dir), target, percent=5, least_words=20)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_separator_scan, op3_bpe_codec, op4_exact_dedup, op5_best_fit_packing, op6_token_records, op7_language_id, op8_pii, op9_simhash, op10_embedding_near_dedup, op11_block_max_wand, op12_secret_scan, op13_importance_resampling)}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op11_block_max_wand": """
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        s AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM t WHERE len(w) > 0),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
        g AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
        i AS (SELECT p.r, p.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * big_n) // big_l))) AS gain FROM p JOIN g USING (term) JOIN t USING (r), s),
        c AS (SELECT item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN i USING (term) WHERE item_id IS NOT NULL GROUP BY item_id, r),
        o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c JOIN t USING (r) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS (SELECT * FROM v WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
        l AS (SELECT a.n AS a, b.n AS b FROM g a JOIN g b ON a.n <> b.n AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
        r AS (SELECT n AS a, n AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        c AS (SELECT r.a, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.b GROUP BY r.a),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.a = v.n LEFT JOIN k ON k.a = v.n""",
}
