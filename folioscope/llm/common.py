"""Helpers shared by the operators: the shared folder, written tables, grouped streams and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many narrow rows (under 100 bytes each, so under 20 MB).
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch, about.
BATCH_BYTES = "4m"
#: Parts whose totals one task adds up in ``running_totals``.
RANGE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where it is unset, a fresh temporary one is made if driver and executors are one process; a cluster must name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Later stages read files that outlive any executor, and joins see plain scans, which lets adaptive execution
    split skewed partitions.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def absent(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to clash with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def plain(name: str):
    """The column of this very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def running_totals(df: DataFrame, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, ordered by ``part`` (an int) and then ``order``.

    In three levels, so that no task sees all rows: within a part, over the parts of a range, and over the ranges,
    of which there is one for every ``RANGE`` parts.
    """
    before = lambda w: F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = df.groupBy(F.col(part).alias("_p")).agg(F.sum(value).alias("_v")).withColumn("_r", F.floor(F.col("_p") / RANGE))
    ranges = parts.groupBy("_r").agg(F.sum("_v").alias("_v")).select("_r", before(Window.orderBy("_r")).alias("_first"))
    parts = parts.withColumn("_in", before(Window.partitionBy("_r").orderBy("_p"))).join(ranges, "_r").select("_p", (F.col("_in") + F.col("_first")).alias("_base"))
    own = df.withColumn("_v", F.col(value)).withColumn("_own", before(Window.partitionBy(part).orderBy(*order)))
    return own.join(parts, F.col(part) == F.col("_p")).withColumn(name, F.col("_base") + F.col("_own")).drop("_v", "_own", "_p", "_base")


def map_batches(df: DataFrame, run, schema, encoders: bool = False) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES``, whatever the length of the texts.

    The bound is set for the session. Python workers are kept from task to task: a worker that has tokenized before
    frees its encoders here, unless ``encoders`` says that this step, or one in the same stage, tokenizes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def freed(batches):
        import pyarrow as pa

        from . import tokens

        if not encoders:
            tokens.release()
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numpy_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each node's component."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def sorted_groups(batches, columns: list[str], keys: list[str]):
    """Turn Arrow batches sorted by ``keys`` into dicts of numpy columns that hold whole groups only.

    The last group of a batch waits for the next batch. Memory: one batch and one group.
    """
    held = None
    for batch in batches:
        now = {c: _column(batch, c) for c in columns}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in columns}
        n = len(now[columns[0]])
        if not n:
            continue
        same = np.ones(n, dtype=bool)
        for k in keys:
            same &= now[k] == now[k][-1]
        start = int(np.argmax(same)) if same[-1] else n
        if start:
            yield {c: v[:start] for c, v in now.items()}
        held = {c: v[start:] for c, v in now.items()}
    if held is not None and len(held[columns[0]]):
        yield held


def sorted_groups_of_rows(batches, key: str):
    """Turn Arrow batches sorted by ``key`` into dicts of Arrow columns, one for each key. Memory: a batch and a group."""
    import pyarrow as pa

    held: list = []

    def whole():
        t = pa.Table.from_batches(held).combine_chunks()
        return {c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in t.column_names}

    for batch in batches:
        keys = _column(batch, key)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:]):
            if held and _column(held[-1], key)[-1] != keys[a]:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _column(batch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    kind = str(col.type)
    if kind.startswith(("list", "large_list")):
        flat = col.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)
    return col.to_numpy(zero_copy_only=False)


def split_hot(index: DataFrame, key: str, most: int) -> DataFrame:
    """Add ``blk``, ``lo`` and ``hi`` so that each (key, lo, hi) is a bounded unit of pair work.

    A key of at most ``most`` rows is one unit. A larger one is dealt by hash over B = ceil(n / most) blocks, and
    each row goes to the units of its block with every block: no pair is lost, none is compared in two units, and a
    unit holds about 2 * most rows. ``index`` must be a written table, with an ``id`` column that spreads.
    """
    hot = written(
        index.groupBy(key).count().filter(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("blocks")),
        "hot",
    )
    if hot.isEmpty():
        return index.withColumns({"blk": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    dealt = index.join(small_side(hot), key, "left").withColumn("blk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
    other = dealt.withColumn("oth", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    return other.withColumns({"lo": F.least("blk", "oth"), "hi": F.greatest("blk", "oth")}).drop("oth", "blocks")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by alternating star contraction.

    ``links`` holds pairs of non-null longs in any order, repeats allowed. Each round replaces the links by links
    from larger neighbours to the smallest, written to the shared folder; it stops once only stars are left, which
    takes a logarithmic number of rounds. A hub's rows meet only in aggregations with partial sums and in joins of
    written tables, whose skewed partitions adaptive execution splits. The tables of a round are deleted once the next
    has been written.
    """
    e = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(rounds):
        # Every node's smallest neighbour, itself included. A node with larger neighbours hands them over.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "least")
        large = e.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("w").alias("v"))
        large = written(_thinned(large.filter("u <> v")), "links")
        # The smaller neighbours of a node are all handed to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")), "least")
        if low.filter("n > 1").isEmpty():
            roots = low.select(F.col("u").alias("v"), F.lit(1).alias("inner"))
            if large.join(roots, "v", "left_semi").isEmpty():
                stars = large.select(F.col("u").alias("node"), F.col("v").alias("component"))
                return stars.unionByName(large.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("w"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("w").alias("v"))
        old, e = e, written(_thinned(small.filter("u <> v")), "links")
        discard(old, least, large, low)
    raise RuntimeError("links did not settle; raise rounds")


def _thinned(e: DataFrame) -> DataFrame:
    """Distinct links (u > v), reduced to a spanning forest within each partition first."""

    def forest(batches):
        import pyarrow as pa

        for t in _chunks(batches, 200_000):
            u, v = t
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            lab = numpy_components(len(nodes), at[: len(u)], at[len(u) :])
            far = np.flatnonzero(lab != np.arange(len(nodes)))
            yield pa.RecordBatch.from_pydict({"u": nodes[far], "v": nodes[lab[far]]})

    return map_batches(e, forest, "u long, v long").distinct()


def _chunks(batches, rows: int):
    us, vs, n = [], [], 0
    for x in batches:
        us.append(_column(x, "u").astype(np.int64))
        vs.append(_column(x, "v").astype(np.int64))
        n += len(us[-1])
        if n >= rows:
            yield np.concatenate(us), np.concatenate(vs)
            us, vs, n = [], [], 0
    if n:
        yield np.concatenate(us), np.concatenate(vs)
