"""Operator 2: token counts by scanning flat token files for end-of-document identifiers.

A flat file holds nothing but ids, document after document, each closed by the end id. ``scan`` deals the files into
blocks of equal size that know nothing of documents. Each block is searched in one vector comparison; it tells how
many separators it has, where the first and last lie, and the lengths between them. A prefix scan over the blocks'
totals (one narrow row a block, in three levels, so that no task sees all of them) then gives each block the number of documents and tokens before it and the token at
which its first, perhaps unfinished, document began, so that documents across blocks are stitched without reading
anything again.

Defined results: an empty table makes no file; an empty or null text is one token long (the end id), a very long one
spans as many blocks as it needs; repeated rows each have a document of their own in the file; extra columns are
ignored; ids after the last separator of a file, if any, are a last document without an end and are counted as such.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, running_totals, written
from .token_files import MANIFEST, file_system
from .tokens import IdEncoder, held, text_blocks


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as flat files, in the order in which they lie; returns (manifest, order).

    ``order`` has (file, nth, doc_id): which document stands at which place. The files themselves don't know it. Each
    task writes its own share where it reads it, so texts are not shuffled; for another order, sort ``docs`` before.
    Special tokens written in a text are ordinary text here, so that the end id closes documents only.
    """
    folder = folder or fresh_path(docs.sparkSession, "flat")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = held(IdEncoder, tokenizer, False)
        tail = np.array([end_id], dtype=encode.dtype).tobytes()
        part, out, path, nth = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            for first, texts in text_blocks(batch):
                if out is None:
                    fs, path = file_system(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.u{encode.dtype.itemsize}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                got = [x + tail for x in encode(texts)]
                out.write(b"".join(got))
                n = len(got)
                file = f"{folder}/{path.rpartition('/')[2]}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([file] * n), pa.array(range(nth, nth + n), pa.int64()), batch.column(0).slice(first, n), pa.array([len(x) for x in got], pa.int64())],
                    names=["part", "file", "nth", "doc_id", "bytes"],
                )
                nth += n
        if out is not None:
            out.close()

    order = written(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "part int, file string, nth long, doc_id long, bytes long", encoders=True), "order")
    manifest = order.groupBy("part", "file").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    manifest = manifest.withColumn("tokens", (F.col("bytes") / F.substring_index("file", ".u", -1).cast("int")).cast("long"))
    return written(manifest.select(*(c.split()[0] for c in MANIFEST.split(", "))), "manifest"), order.select("file", "nth", "doc_id")


def scan(manifest: DataFrame, end_id: int, block_tokens: int = 4 << 20) -> DataFrame:
    """(file, nth, start, n_tokens) for each document: start counts the ids of all documents before, over all files."""
    spark = manifest.sparkSession
    blocks = manifest.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / block_tokens).cast("int") - 1)))
    blocks = blocks.select("part", "file", "tokens", "block")
    blocks = blocks.repartition(4 * spark.sparkContext.defaultParallelism, "file", "block")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                wide = int(row["file"].rpartition(".u")[2])
                fs, path = file_system(row["file"])
                begin = row["block"] * block_tokens
                with fs.open_input_file(path) as f:
                    f.seek(begin * wide)
                    ids = np.frombuffer(f.read(min(block_tokens, row["tokens"] - begin) * wide), dtype=f"<u{wide}")
                at = np.flatnonzero(ids == end_id)
                last = bool(begin + len(ids) == row["tokens"])
                if last and (not len(at) or at[-1] != len(ids) - 1):
                    at = np.r_[at, len(ids) - 1]  # an unclosed last document
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([row["file"]]), pa.array([row["block"]], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) + 1 if len(at) else 0], pa.int64()), pa.array([at.astype(np.int64)], pa.list_(pa.int64())), pa.array([np.r_[-1, at[:-1]].astype(np.int64)[: len(at)]], pa.list_(pa.int64()))],
                    names=["part", "file", "block", "size", "seps", "closed", "at", "prev"],
                )

    found = written(map_batches(blocks, run, "part int, file string, block int, size long, seps long, closed long, at array<long>, prev array<long>"), "blocks")
    # The prefix scan: tokens before each block over all files, documents before it in its file, and where the
    # document that is open at its start began: the end of the last block before that closed one.
    totals = found.select("part", "file", "block", "size", "seps", "closed")
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = running_totals(totals, "part", ["block"], "size", "base")
    ends = F.when(F.col("seps") > 0, F.col("base") + F.col("closed"))
    first = F.min("base").over(Window.partitionBy("file"))
    totals = totals.withColumns({"before": F.coalesce(F.sum("seps").over(in_file), F.lit(0)), "open": F.coalesce(F.max(ends).over(in_file), first)})
    joined = found.select("file", "block", F.arrays_zip("at", "prev").alias("ends")).join(written(totals.select("file", "block", "base", "before", "open"), "scan"), ["file", "block"])
    each = joined.select("file", "base", "before", "open", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.col("end.prev") + 1)
    return each.select("file", (F.col("before") + F.col("k")).alias("nth"), start.alias("start"), (F.col("base") + F.col("end.at") + 1 - start).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens of every document, read from the flat files by ``scan``; start is its place in them."""
    manifest, order = write_flat(docs, tokenizer, end_id)
    return order.join(scan(manifest, end_id), ["file", "nth"]).select("doc_id", "start", "n_tokens")
