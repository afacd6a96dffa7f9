"""Registered queries as they ship, held against their SQL."""

import duckdb

from folioscope.llm import queries


def test_op4_gives_the_rows_of_its_sql(spark, tmp_path):
    rows = [(k, f"text number {k % 7} with some words", "en", "s", 30) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op4_exact_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = con.sql(queries.ORACLE["op4_exact_dedup"])
    assert sorted(tuple(map(str, r)) for r in df.select(*out.columns).collect()) == sorted(tuple(map(str, r)) for r in out.fetchall())


def test_op10_gives_the_rows_of_its_sql(spark, tmp_path):
    base = [[1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.9, 0.3, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05], [0.0, 0.0, 0.0], None, [1.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [0.0, 0.0, 1.0]]
    spark.createDataFrame(list(enumerate(base)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["op10_embedding_near_dedup"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = con.sql(queries.ORACLE["op10_embedding_near_dedup"])
    rows = sorted(tuple(map(str, r)) for r in df.select(*out.columns).collect())
    assert rows == sorted(tuple(map(str, r)) for r in out.fetchall()) and ("0", "3", "0", "True") in rows
