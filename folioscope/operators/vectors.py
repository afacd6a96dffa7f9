"""Vector search: a stated set of query vectors against all rows as matrix products, exact or through a partitioned index.

Queries are taken in sets of at most ``QUERY_VECTORS``, each sent to every task. A task multiplies its Arrow batches with
the set and keeps its own best ``k`` of each query, so neither pairs nor vectors are shuffled, only the best of each task.

The index deals all rows over cells around centroids (k-means on a bounded sample) and writes them by cell. A search reads
only the cells that its queries probe (partition pruning) and multiplies a cell's rows with the queries that probe it. How
many cells a query probes is set from the recall measured on the sample.

Rows whose vector is null or holds null, and queries of another length, match nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path

#: Query vectors that every task gets at once, rows from which centroids are fitted, and numbers of a product at once.
QUERY_VECTORS, SAMPLE, PRODUCT = 4096, 20_000, 2_000_000


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the rows of an Arrow list column that have the commonest length and no null."""
    import pyarrow.compute as pc

    n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    if not n.any():
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0))
    size = int(np.bincount(n[n > 0]).argmax())
    rows = np.flatnonzero(n == size)
    flat = column.take(rows).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    if flat.null_count:
        whole = np.isfinite(m).all(axis=1)
        rows, m = rows[whole], m[whole]
    return rows, m


def _best(found, k: int, key: str):
    """Of (_q, key, ..., score) the best ``k`` of each query, equal ones by key."""
    import pyarrow as pa

    q, score = found["_q"].to_numpy(), np.round(found["score"].to_numpy(), 6)
    order = np.lexsort([found[key].to_numpy(), -score, q])
    q = q[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return found.take(pa.array(order[nth < k]))


def _multiplied(rows: DataFrame, sets, key: str, embedding: str, k: int | None, least: float | None, cell: str | None = None) -> DataFrame:
    """(_q, columns of ``rows`` but the vector, score). ``sets``: (query ids, matrix, probed cells or None)."""
    ids, asked, probed = sets
    carried = [f for f in rows.schema.fields if f.name not in (embedding, cell)]
    schema = "_q long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", score double"
    by_cell: dict = {}
    if probed is not None:
        for q, cells in enumerate(probed.tolist()):
            for c in cells:
                by_cell.setdefault(c, []).append(q)

    def products(batch):
        at, m = _matrix(batch.column(batch.schema.get_field_index(embedding)))
        if not len(at) or not len(asked) or m.shape[1] != asked.shape[1]:
            return
        if cell is None:
            groups = [(np.arange(len(at)), np.arange(len(ids)))]
        else:
            own = batch.column(batch.schema.get_field_index(cell)).to_numpy(zero_copy_only=False)[at]
            groups = [(np.flatnonzero(own == c), np.array(by_cell[c])) for c in np.unique(own).tolist() if c in by_cell]
        for r, q in groups:
            step = max(1, PRODUCT // len(q))
            for a in range(0, len(r), step):
                part = r[a : a + step]
                yield at[part], q, m[part] @ asked[q].T

    def run(batches):
        import pyarrow as pa

        kept = None
        names = [f.name for f in carried]
        for batch in batches:
            for rows_at, q, s in products(batch):
                if k is not None:
                    floor = np.partition(s, len(s) - min(k, len(s)), axis=0)[len(s) - min(k, len(s))] - 1e-6
                else:
                    floor = least - 1e-6
                r, c = np.nonzero(s >= floor)
                columns = [pa.array(q[c], pa.int64()), *(batch.column(batch.schema.get_field_index(n)).take(pa.array(rows_at[r])) for n in names), pa.array(s[r, c])]
                own = pa.RecordBatch.from_arrays(columns, names=["_q", *names, "score"])
                if k is None:
                    yield own
                else:
                    own = pa.Table.from_batches([own]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([own])])
                    kept = _best(own.combine_chunks(), k, key)
        if kept is not None:
            yield from kept.to_batches()

    got = rows.mapInArrow(run, schema)
    names = F.array(*[F.lit(int(i)) for i in ids]) if len(ids) else F.array().cast("array<bigint>")
    return got.select(F.element_at(names, (F.col("_q") + 1).cast("int")).cast("long").alias("query_id"), *[F.col(f"`{f.name}`") for f in carried], F.round("score", 6).alias("score"))


def _sets(queries: DataFrame, key: str, embedding: str):
    """(query ids, matrix) of sets of at most about ``QUERY_VECTORS`` rows."""
    own = queries.filter(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))
    parts = max(1, math.ceil(2 * own.count() / QUERY_VECTORS))
    for p in range(parts if parts > 1 else 1):
        rows = (own if parts == 1 else own.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)).toArrow()
        at, m = _matrix(rows["v"].combine_chunks())
        yield rows["id"].to_numpy()[at], m


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, columns of ``vectors`` but the vector, score): the ``k`` largest inner products of each query, exactly."""
    found = _union([_multiplied(vectors, (*s, None), key, embedding, k, None) for s in _sets(queries, key, embedding)])
    return _top(found, k, key)


def above(vectors: DataFrame, queries: DataFrame, least: float, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """All pairs whose inner product, rounded to six places, is at least ``least``."""
    found = _union([_multiplied(vectors, (*s, None), key, embedding, None, least) for s in _sets(queries, key, embedding)])
    return found.filter(F.col("score") >= least)


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


# --- index ------------------------------------------------------------------------------------------------------------


@dataclass
class VectorIndex:
    """Rows written by cell under ``path``; ``probes`` cells of ``centroids`` a query reach the recall asked for."""

    path: str
    schema: object
    centroids: np.ndarray
    probes: int


def centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centroids; empty cells take the rows that lie worst."""
    rng = np.random.default_rng(seed)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        gone = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        total[gone] = x[np.argsort(s.max(axis=1))[: len(gone)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """Cells to probe so that, on the sample, the share of the true best ``k`` that lie in them reaches ``recall``."""
    asked = x[:: max(1, len(x) // 200)]
    own = (x @ c.T).argmax(axis=1)
    best = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    order = np.argsort(-(asked @ c.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None, :], axis=1)
    needed = np.take_along_axis(rank, own[best], axis=1).ravel()
    return int(np.sort(needed)[min(math.ceil(recall * len(needed)), len(needed)) - 1]) + 1


def index(vectors: DataFrame, k: int = 10, recall: float = 0.97, key: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
    """Cells for all rows of ``vectors``: about the square root of their number, fitted on at most ``SAMPLE`` of them.

    Rows are dealt by (cell, hash of the key), so that a cell that many equal vectors fill is written by several tasks.
    """
    spark = vectors.sparkSession
    whole = vectors.filter(F.col(embedding).isNotNull())
    n = whole.count()
    rows = whole.select(embedding).orderBy(F.xxhash64(key)).limit(SAMPLE).toArrow()
    _, x = _matrix(rows[embedding].combine_chunks())
    cells = max(1, min(math.isqrt(n), len(x) // 8 or 1))
    c = centroids(x, cells) if len(x) else np.zeros((0, 0))
    probes = probes_for(x, c, min(k, len(x)), recall) if len(x) else 0
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

    def assigned(batches):
        import pyarrow as pa

        for batch in batches:
            at, m = _matrix(batch.column(batch.schema.get_field_index(embedding)))
            if len(at) and m.shape[1] == c.shape[1]:
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array((m @ c.T).argmax(axis=1).astype("i4"))], names=[*own.schema.names, "cell"])

    path = shared_path(spark, "cells")
    dealt = whole.mapInArrow(assigned, schema).repartitionByRange("cell", F.xxhash64(key))
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return VectorIndex(path, schema, c, probes)


def probe(own: VectorIndex, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``nearest`` through the index: of each query's best ``k`` about the share of the recall that the index was built for."""
    spark, parts = queries.sparkSession, []
    for ids, m in _sets(queries, key, embedding):
        fits = len(m) and len(own.centroids) and m.shape[1] == own.centroids.shape[1]
        ids, m = (ids, m) if fits else (ids[:0], m[:0])
        probed = np.argsort(-(m @ own.centroids.T), axis=1)[:, : own.probes] if fits else np.zeros((0, 0), dtype=np.int64)
        rows = spark.read.schema(own.schema).parquet(own.path).filter(F.col("cell").isin(np.unique(probed).tolist()))
        parts.append(_multiplied(rows, (ids, m, probed), key, embedding, k, None, "cell"))
    return _top(_union(parts), k, key)
