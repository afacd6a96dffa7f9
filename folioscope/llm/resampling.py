"""Operator 13: importance resampling towards a target distribution over hashed n-grams.

Documents and target texts are bags of runs of 1 to ``GRAMS`` words, hashed into ``BUCKETS``. A bucket's gain is the
logarithm of how much likelier it is in the target; a document's weight is the sum of its features' gains, and Gumbel noise
from a hash of its id makes the highest scores a draw without replacement in proportion to the weights.

**Features.** In blocks of about ``BLOCK_BYTES`` of text, each distinct word gets a number from an integer dictionary; an
n-gram is a tuple of numbers, packed into one integer. Each distinct tuple of a block is put together as bytes and hashed
once, and its bucket is joined back to where the tuple stands. Each document leaves one row: its sorted buckets as gaps of a
byte each. Each task leaves one row of bucket totals, which are added up by bucket, so texts are read once and nothing of a
document is shuffled. The gains (one for each bucket) go to every task, which adds them up from those rows.

**Draw.** Scores are dealt by ranges and numbered from the totals of the ranges (``running_totals``), so no task sees all
of them, however many are drawn.

Defined results: a null or empty text has no features and weight 0; every row is a document of its own, so equal rows have
equal scores and take ranks one after the other; a row whose doc_id is null is scored as if its id were the empty text and
comes last among equals; an empty target leaves T = 0; an empty table gives no rows; a very long text is handled in pieces
that overlap by two words; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, running_totals, written
from .words import Dictionary

BUCKETS, GRAMS = 10_000, 3
#: Bytes of text whose words share a dictionary, and words of one text that are turned into tuples at once.
BLOCK_BYTES, RUN = 4_000_000, 1 << 20
SCHEMA = "doc_id long, n_words long, n_features long, gaps binary, totals binary"


def buckets_of_block(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    known = Dictionary()
    every = [known(t) for t in texts]
    length = np.array([len(x) for x in every], dtype=np.int64)
    flat = np.concatenate(every) if every else np.zeros(0, dtype=np.int64)
    del every
    words, n = known.words(), len(known.words())
    text = np.repeat(np.arange(len(texts)), length)
    rows, buckets = [], []
    for a in range(0, len(flat), RUN):
        for g in range(1, GRAMS + 1):
            # Runs that begin here; the last ones reach into the next part.
            end = min(a + RUN, len(flat) - g + 1)
            if end <= a:
                continue
            whole = text[a:end] == text[a + g - 1 : end + g - 1]
            at = np.flatnonzero(whole) + a
            rows.append(text[at])
            buckets.append(_hashed(flat, at, g, words, n))
    none = np.zeros(0, dtype=np.int64)
    return length, np.concatenate([none, *rows]), np.concatenate([none, *buckets])


def _hashed(flat: np.ndarray, at: np.ndarray, g: int, words: list[bytes], n: int) -> np.ndarray:
    """The buckets of the runs of ``g`` words that begin at ``at``: each distinct tuple is hashed once."""
    if n**g < 1 << 63:
        key = flat[at]
        for k in range(1, g):
            key = key * n + flat[at + k]
        key, place = np.unique(key, return_inverse=True)
        parts = []
        for _ in range(g):
            parts.append(key % n)
            key = key // n
        parts.reverse()
    else:
        tuples, place = np.unique(np.stack([flat[at + k] for k in range(g)], axis=1), axis=0, return_inverse=True)
        parts, place = list(tuples.T), place.reshape(-1)
    crc, join, get = zlib.crc32, b" ".join, words.__getitem__
    columns = [map(get, p.tolist()) for p in parts]
    made = columns[0] if g == 1 else map(join, zip(*columns))
    return (np.fromiter(map(crc, made), dtype=np.int64, count=len(parts[0])) % BUCKETS)[place]


def as_gaps(text: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's sorted buckets as gaps: 255 stands for 255 more to come."""
    key = text * BUCKETS + bucket
    key.sort()
    text, bucket = key // BUCKETS, key % BUCKETS
    gap = np.diff(bucket, prepend=0)
    new = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, dtype=bool)
    gap[new] = bucket[new]
    size = gap // 255 + 1
    out = np.full(size.sum(), 255, dtype=np.uint8)
    out[np.cumsum(size) - 1] = gap % 255
    return out, np.r_[0, np.cumsum(np.bincount(text, size, n).astype(np.int64))]


def from_gaps(gaps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature of texts whose gaps lie between ``offsets``."""
    ends = np.flatnonzero(gaps != 255)
    reach = np.cumsum(gaps, dtype=np.int64)
    text = np.searchsorted(offsets, ends, side="right") - 1
    base = np.r_[0, reach][offsets[:-1]]
    return text, reach[ends] - base[text]


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document with its buckets, and a row for each task with its bucket totals, written."""

    def run(batches):
        import pyarrow as pa

        totals = np.zeros(BUCKETS, dtype=np.int64)

        def made(ids, texts):
            length, text, bucket = buckets_of_block(texts)
            totals[:] += np.bincount(bucket, minlength=BUCKETS)
            n = np.bincount(text, minlength=len(texts))
            data, offsets = as_gaps(text, bucket, len(texts))
            gaps = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(length), pa.array(n), gaps, pa.nulls(len(texts), pa.binary())], names=["doc_id", "n_words", "n_features", "gaps", "totals"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(doc)
                texts.append(t.as_py())
                size += len(texts[-1] or b"")
                if size >= BLOCK_BYTES:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "n_words": [0], "n_features": [int(totals.sum())], "gaps": pa.array([None], pa.binary()), "totals": [totals.astype("<i8").tobytes()]})

    return written(map_batches(docs.select(F.col(key).cast("long"), F.col("text").cast("string")), run, SCHEMA), "features")


def bucket_totals(made: DataFrame) -> DataFrame:
    """(bucket, n) of all documents."""

    def run(batches):
        import pyarrow as pa

        own = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                own += np.frombuffer(t.as_py(), dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int64()), pa.array(own)], names=["bucket", "n"])

    return map_batches(made.filter("totals is not null").select("totals"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(made: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))."""
    every = made.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = every.join(bucket_totals(made).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_totals(target).withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = [x.filter("totals is not null").agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for x in (made, target)]
    number = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log((number("t") + 1) * float(sums[0] + BUCKETS) / ((number("s") + 1) * float(sums[1] + BUCKETS))))
    rows = both.select("bucket", gain.cast("long").alias("gain")).toArrow()  # BUCKETS rows
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return out


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, gaps = len(batch), batch.column(3).combine_chunks() if hasattr(batch.column(3), "combine_chunks") else batch.column(3)
            offsets = np.frombuffer(gaps.buffers()[1], dtype="<i4")[gaps.offset : gaps.offset + n + 1].astype(np.int64)
            data = np.frombuffer(gaps.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            text, bucket = from_gaps(data, offsets - offsets[0])
            total = np.r_[0, np.cumsum(gain[bucket])]
            edge = np.searchsorted(text, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total[edge[1:]] - total[edge[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    rows = made.filter("totals is null").select("doc_id", "n_words", "n_features", "gaps")
    return map_batches(rows, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank of the drawn ones, of those with at least ``least_words``.

    ``docs`` and ``target`` hold doc_id and text; ``percent`` of the documents that are long enough are drawn.
    """
    made, wanted = features(docs), features(target)
    rows = weighed(made, gains(made, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).withColumn("long_enough", (F.col("n_words") >= least_words).cast("long")), "scores")
    draws = ranged.agg(F.coalesce(F.sum("long_enough"), F.lit(0))).first()[0] * percent // 100
    numbered = running_totals(ranged, "part", order, "long_enough", "before")
    rank = F.when((F.col("long_enough") == 1) & (F.col("before") < draws), F.col("before") + 1)
    return numbered.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
