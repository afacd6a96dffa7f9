"""The pipeline on the odd tables, against a plain chain of brute-force versions."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_operators import BYTE, brute_components, brute_fingerprint, brute_pii

import corpus_pipeline
from folioscope.llm import queries
from folioscope.llm.tokens import load_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, base string, spans string, _base int, score double"


def table(path, spark, rows):
    rows = [(d, t, "en", "s", None if t is None else len(t), "x", "x", "x", "x", 1, 0.5) for d, t in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int("zuppvile" in (t or ""))) for d, t, *_ in rows if d is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def chained(rows, toxic):
    """(doc_id, text) that is left before packing."""
    rows = [(d, t) for d, t in rows if t not in toxic]
    keep = {}
    for d, t in rows:
        keep[t or ""] = max(keep.get(t or "", d), d)
    rows = [(d, t) for d, t in rows if keep[t or ""] == d]
    fps = [brute_fingerprint(t or "", 4) for _, t in rows]
    linked = [(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4]
    rows = [r for r, c in zip(rows, brute_components([d for d, _ in rows], linked)) if r[0] == c]
    out = []
    for d, t in rows:
        for kind, a, b in reversed([x.split(":") for x in filter(None, brute_pii(t or "").split(","))]):
            t = t[: int(a)] + f"<{kind}>" + t[int(b) :]
        out.append((d, t))
    return out


def test_run_gives_what_a_plain_chain_gives(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    say = lambda k, n: " ".join(words[(k * 7 + i * i * (k % 5 + 1)) % len(words)] for i in range(n))
    rows = [(k, f"number {k} " + say(k, 20 + k)) for k in range(60)]
    rows += [(100 + k, f"you zuppvile zuppvile fool {k} " + say(k, 30)) for k in range(40)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1]), (204, rows[5][1] + " " + "end"), (205, say(1, 100_000)), (206, "mail a.b@c.org from 10.0.0.1 now please"), (207, " \n\t "), (3, rows[3][1])]
    table(tmp_path, spark, rows)
    model = queries.toxicity_model(spark, queries.documents(spark, str(tmp_path)), str(tmp_path))
    toxic = {t for _, t in rows if t and model.score([t])[0] >= corpus_pipeline.TOXIC}
    assert toxic == {t for _, t in rows if t and "zuppvile" in t}
    want = chained(rows, toxic)
    tok, pieces = load_tokenizer(BYTE), []
    for d, t in want:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cut = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        pieces += [(d, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for n, (a, b) in enumerate(zip(cut, cut[1:]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(pieces)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns_and_handle_an_empty_table(spark, tmp_path):
    table(tmp_path, spark, [(1, "some text here"), (None, "no id"), (None, None), (2, "zuppvile " * 5)])
    docs = queries.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.filter("false")):
            out = stage(spark, own, str(tmp_path))
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            assert out.count() <= own.count()
            assert {r["digest"] for r in out.collect()} <= {"x"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.filter("false"), str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]


@pytest.mark.parametrize("names", [["_digest", "_keep_id", "digest"], ["_base", "_spans", "_proposed", "proposed", "Base"]])
def test_no_column_of_the_table_is_touched(spark, names):
    from pyspark.sql import functions as F

    from folioscope.llm import exact_dedup, pii

    df = spark.createDataFrame([(1, "a@b.org"), (2, "a@b.org"), (3, "plain")], "doc_id long, text string")
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    for out in (exact_dedup.drop_duplicates(df), pii.redact(df)):
        assert out.columns == df.columns and {r[n] for r in out.collect() for n in names} == {"mine"}
    assert re.search("<email>", str(pii.redact(df).collect()))
