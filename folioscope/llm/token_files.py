"""Operator 6: token ids as length-delimited binary records with masked checksums and a separate offset index.

``write_records`` deals documents into ascending ranges of doc_id, one file a range. A record is framed as

    length (8 bytes) | masked crc of the length (4) | payload | masked crc of the payload (4)

all little-endian; a crc32 is masked by turning it right by 15 bits and adding 0xa282ead8, so that checksums of data
that hold checksums stay sound. The payload is doc_id (8 bytes; the lowest long for null), the bytes an id takes (4)
and the ids. Beside each ``.rec`` file an ``.idx`` file holds the offset of every record and the file's end as 8-byte
integers, so that a loader can read records in any order. Files are named by attempt; the manifest has a row for each
run of records (about ``RUN_BYTES``) of a task that succeeded, so files of lost or repeated tasks are never read, and
runs of one file can be read by several tasks.

Defined results: a null or empty text is a record with the end id alone, a very long one a long record; an empty table
makes no file and an empty result; rows that share a doc_id follow each other, in the order of a hash of their texts,
and go on in the next file where they are many; null doc_ids come first, likewise. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, running_totals, written
from .tokens import IdEncoder, held, text_blocks

NULL_ID = np.iinfo(np.int64).min
#: Fixed values of the checksum mask (as in TFRecord files, over zlib's crc32).
_MASK_ADD, _MASK_TURN = 0xA282EAD8, 15
MANIFEST = "part int, file string, docs long, tokens long, bytes long"
#: Bytes of records, about, that a row of the record manifest stands for and one reading task takes at a time.
RUN_BYTES = 16 << 20
RUNS = "part int, run int, file string, skip long, docs long, tokens long, bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> _MASK_TURN | crc << (32 - _MASK_TURN)) + _MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return head + masked_crc(head).to_bytes(4, "little") + payload + masked_crc(payload).to_bytes(4, "little")


def file_system(uri: str):
    """(pyarrow file system, path) for a Spark path."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def in_doc_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending doc_id over the partitions and within each; ties by a hash of the text, and by it.

    The hash lets a doc_id (or null) of many rows spread over partitions.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text")
    return own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest, a written table with a row for each run of records."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "records")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = held(IdEncoder, tokenizer)
        tail = np.array([end_id], dtype=encode.dtype).tobytes()
        wide = encode.dtype.itemsize.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        out, index, at, run, skip = None, None, 0, 0, 0
        begin, docs_in, tokens = 0, 0, 0

        def told():
            name = path.rpartition("/")[2]
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "run": pa.array([run], pa.int32()), "file": [f"{folder}/{name}"], "skip": [skip], "docs": [docs_in], "tokens": [tokens], "bytes": [at - begin]}
            )

        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_blocks(batch):
                frames, offsets = [], []
                for k, own in enumerate(encode(texts)):
                    doc = ids[first + k].as_py()
                    head = int(NULL_ID if doc is None else doc).to_bytes(8, "little", signed=True)
                    frames.append(frame(head + wide + own + tail))
                    offsets.append(at)
                    at += len(frames[-1])
                    tokens += len(own) // encode.dtype.itemsize + 1
                if out is None:
                    fs, path = file_system(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, index = fs.open_output_stream(path), fs.open_output_stream(path.removesuffix(".rec") + ".idx")
                out.write(b"".join(frames))
                index.write(np.array(offsets, dtype="<i8").tobytes())
                docs_in += len(offsets)
                if at - begin >= RUN_BYTES:
                    yield told()
                    run, skip, begin, docs_in, tokens = run + 1, skip + docs_in, at, 0, 0
        if out is not None:
            index.write(np.array([at], dtype="<i8").tobytes())
            out.close()
            index.close()
            if docs_in:
                yield told()

    return written(map_batches(in_doc_order(docs), write, RUNS, encoders=True), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the tokens in all runs before."""
    return running_totals(manifest, "part", ["run"], "tokens", "first")


def spread(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """The runs dealt over as many partitions as there are, up to a few thousand, so that reading uses all cores."""
    n = runs.count()
    return runs.repartition(min(n, 4096), "file", "run") if n > 1 else runs


def read_records(manifest: DataFrame, digest_only: bool = False, piece: int = 8 << 20) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 and, unless ``digest_only``, ids.

    Each run is found by the file's index and read in pieces of about ``piece`` bytes; a checksum that fails raises.
    """
    runs = written(with_starts(manifest).select("file", "run", "skip", "docs", "first"), "starts")
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["file"])
                with fs.open_input_file(path.removesuffix(".rec") + ".idx") as f:
                    f.seek(8 * row["skip"])
                    offsets = np.frombuffer(f.read(8 * (row["docs"] + 1)), dtype="<i8")
                start = row["first"]
                with fs.open_input_file(path) as f:
                    a = 0
                    while a < len(offsets) - 1:
                        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + piece, side="right")) - 1)
                        f.seek(int(offsets[a]))
                        data = f.read(int(offsets[b] - offsets[a]))
                        rows = []
                        for lo, hi in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist()):
                            doc, ids = unframe(data[lo:hi])
                            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                            start += len(ids)
                        cols = list(zip(*rows))
                        own = [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if not digest_only:
                            own.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(own, names=names)
                        a = b

    return map_batches(spread(manifest.sparkSession, runs), read, columns)


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one record, after both checksums."""
    n = int.from_bytes(record[:8], "little")
    payload = record[12 : 12 + n]
    if masked_crc(record[:8]) != int.from_bytes(record[8:12], "little") or masked_crc(payload) != int.from_bytes(record[12 + n : 16 + n], "little"):
        raise ValueError("a record's checksum does not match")
    doc, wide = int.from_bytes(payload[:8], "little", signed=True), int.from_bytes(payload[8:12], "little")
    return None if doc == NULL_ID else doc, np.frombuffer(payload[12:], dtype=f"<u{wide}")
