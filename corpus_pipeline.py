"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``; the last returns a row for each packed piece. Between stages the rows are written as Parquet in the
shared folder and read again.

Null texts count as empty: of all empty texts exact dedup leaves the largest doc_id, and packing gives it a piece of the end
id alone. Rows that share doc_id and text share their fate. Of ties the stages keep what their operators say (the largest
doc_id of equal texts, the smallest of near copies). Empty tables go through all stages and give no rows. Extra columns,
whatever their names, stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup, packing, pii, queries, simhash, toxicity
from folioscope.llm.common import written

#: Documents whose calibrated toxicity reaches this go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``TOXIC``."""
    return toxicity.score(docs, queries.toxicity_model(spark, docs, sf_dir), most=TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates (four words, four bits) the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, words=4, bits=4)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of at most 1024 tokens, with its place in a sequence."""
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_pii),
    ("best-fit packing", pack),
]

#: Boosted trees and tokenizers can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
