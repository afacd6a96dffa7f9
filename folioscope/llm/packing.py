"""Operator 5: best-fit packing by exact-complement hashing.

Only the number of pieces of each length decides how bins are filled, and there are at most ``capacity`` lengths, so
the plan is made once from a histogram that does not grow with the data. First each length meets its exact complement.
Then pieces are placed from the longest down: the complement that a piece would leave in each open gap is looked up
among single lengths, then (for triple sums: the piece and a pair) among the sums of pairs, and a combination that
fills a gap exactly is consumed as often as its availability counts allow. A piece without one goes by best fit. Short
pieces are what later gaps need, so it can pay to leave them: plans are made for each of ``SHARES``, the least share of its own
length that a piece's companions have (0: any, 2: none, which is best fit), and the one with the fewest bins is taken.
A plan is a list of patterns (lengths in one bin, how many such bins): each step uses up a length, a combination or a
kind of gap, so their number depends on the capacity alone.

Each piece is numbered within its length (task, then place in the task, with offsets from sums by task and length),
and its number says which bin of which pattern is its own. No piece is moved to learn its bin.

Defined results: a null or empty text is one piece of the end id; documents longer than the capacity are cut from the
end into full pieces, so that only the first may be shorter; an empty table gives no rows; repeated rows are packed
each; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, absent, map_batches, plain, written
from .tokens import IdEncoder, held, text_blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Least shares of a piece's length that its companions have, a plan each.
SHARES = (0.6, 0.0, 2.0)


class _Numbers:
    """Numbers the pieces of each length within a task."""

    def __init__(self):
        self.seen: dict[int, int] = {}

    def __call__(self, length: np.ndarray) -> np.ndarray:
        order = np.argsort(length, kind="stable")
        kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
        base = np.array([self.seen.get(int(x), 0) for x in kinds], dtype=np.int64)
        seq = np.empty(len(length), dtype=np.int64)
        seq[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(base, count)
        for x, n in zip(kinds.tolist(), (base + count).tolist()):
            self.seen[x] = n
        return seq


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut them into pieces; with ``keep_ids`` also the ids themselves.

    ``part`` and ``seq`` number the pieces of one length within a task.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, numbers = held(IdEncoder, tokenizer), TaskContext.get().partitionId(), _Numbers()
        for batch in batches:
            for first, texts in text_blocks(batch):
                rows: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
                own = []
                for k, raw in enumerate(encode(texts)):
                    ids = np.append(np.frombuffer(raw, dtype=encode.dtype), end_id).astype("<u4")
                    doc = batch.column(0)[first + k].as_py()
                    cut = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(cut, cut[1:])):
                        for c, v in zip(rows, (doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                            rows[c].append(v)
                        if keep_ids:
                            own.append(ids[a:b].astype(np.int32))
                cols = [pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in rows.items()]
                names = list(rows)
                if keep_ids:
                    cols.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                length = np.array(rows["length"], dtype=np.int64)
                cols += [pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(numbers(length))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "part", "seq"])

    schema = PIECES + (", ids array<int>" if keep_ids else "") + ", part int, seq long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, encoders=True)


def numbered(items: DataFrame, part: str, seq: str) -> DataFrame:
    """``items`` (with ``length``) with the task, and the place among its items of that length."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, numbers = TaskContext.get().partitionId(), _Numbers()
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            cols = [*batch.columns, pa.array(np.full(len(length), task, dtype=np.int32)), pa.array(numbers(length))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, part, seq])

    more = [T.StructField(part, T.IntegerType()), T.StructField(seq, T.LongType())]
    return map_batches(items, run, T.StructType([*items.schema.fields, *more]), encoders=True)


class _PairSums:
    """Which pairs of present lengths have a sum; those with the longest shorter part come first."""

    def __init__(self, have: np.ndarray, capacity: int):
        kinds = np.flatnonzero(have)
        a, b = np.meshgrid(kinds, kinds, indexing="ij")
        a, b = a[(a >= b) & (a + b < capacity)], b[(a >= b) & (a + b < capacity)]
        order = np.lexsort([a, a + b])
        self.have, self.long, self.short = have, a[order], b[order]
        self.at = np.searchsorted((a + b)[order], np.arange(capacity + 1))

    def first(self, total: int, least: int) -> tuple[int, int] | None:
        """The pair with this sum of which both are there, neither shorter than ``least``. Counts only fall."""
        end = self.at[total + 1] if total + 1 < len(self.at) else len(self.long)
        while self.at[total] < end:
            a, b = int(self.long[self.at[total]]), int(self.short[self.at[total]])
            if b < least:
                return None
            if self.have[a] and self.have[b] > (a == b):
                return a, b
            self.at[total] += 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many bins) that use every piece once: of the plans for ``SHARES`` one with the fewest bins."""
    return min((_plan(counts, capacity, share) for share in SHARES), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills go before best fit; companions have at least ``share`` of a piece's length."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    bins: dict[int, list[list]] = {}  # gap -> [lengths, how many] of the open bins that leave it

    def times(lengths: tuple[int, ...]) -> int:
        kinds, need = np.unique(lengths, return_counts=True)
        return int((have[kinds] // need).min())

    def put(lengths: tuple[int, ...], n: int) -> None:
        if gap := capacity - sum(lengths):
            bins.setdefault(gap, []).append([lengths, n])
        else:
            out.append((lengths, n))

    def into(gap: int, lengths: tuple[int, ...]) -> None:
        """Place ``lengths`` together into bins with this gap, as often as pieces and bins allow."""
        left = times(lengths)
        while left and gap in bins:
            held_lengths, n = bins[gap].pop()
            used = min(n, left)
            if n > used:
                bins[gap].append([held_lengths, n - used])
            if not bins[gap]:
                del bins[gap]
            for x in lengths:
                have[x] -= used
            left -= used
            put((*held_lengths, *lengths), used)

    def exact(length: int) -> tuple[int, tuple[int, ...]] | None:
        """(gap, lengths) of a combination with ``length`` that fills an open gap: alone, with one, or with a pair."""
        if length in bins:
            return length, (length,)
        least, gaps = max(1, int(share * length) + 1), sorted((g for g in bins if g > length), reverse=True)
        for gap in gaps:
            other = gap - length
            if least <= other <= length and have[other] > (other == length):
                return gap, (length, other)
        for gap in gaps:
            if (pair := sums.first(gap - length, least)) and times((length, *pair)):
                return gap, (length, *pair)
        return None

    for length in range(capacity, 0, -1):
        other = capacity - length
        own = int(have[length]) if not other else times((length, other)) if other <= length else 0
        if own:
            for x in (length, other)[: 1 + bool(other)]:
                have[x] -= own
            put((length, other)[: 1 + bool(other)], own)
    sums = _PairSums(have, capacity)
    for length in range(capacity, 0, -1):
        while have[length]:
            found = exact(length)
            if found is None and (fit := min((g for g in bins if g > length), default=0)):
                found = fit, (length,)
            if found:
                into(*found)
            else:
                n = -(-int(have[length]) // (capacity // length))
                have[length] -= n
                put((length,), n)
    return out + [(lengths, n) for kinds in bins.values() for lengths, n in kinds]


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, rows with a ``length`` of 1 to ``capacity``."""
    part, seq = absent(items.columns, "part", "seq")
    return _placed(numbered(items, part, seq), items.columns, part, seq, capacity)


def _placed(items: DataFrame, names: list[str], part: str, seq: str, capacity: int) -> DataFrame:
    """The columns ``names`` with ``sequence_id`` and ``offset``, from items numbered by ``part`` and ``seq``.

    They are written to the shared folder first, so that the numbers stay as they are. Nothing else is written, and the
    sums by task and length are sent to the tasks if they are few: each file that a task writes makes Spark start helper
    processes, and with a shuffle there would be one for every shuffle partition, however small.
    """
    own = written(items, "pieces")
    first, rank = absent(own.columns, "first", "rank")
    sums = own.groupBy(plain(part), "length").agg((F.max(plain(seq)) + 1).alias("n"))
    totals = sums.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in totals}
    before = Window.partitionBy("length").orderBy(plain(part)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(part, "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    if sum(r["tasks"] for r in totals) <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    # For each length: where each run of its pieces begins, in which bin and at which offset.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, n in plan(counts, capacity):
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), base, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        base += n
    table = {x: np.array(r, dtype=np.int64) for x, r in runs.items()}
    kept = [f for f in own.schema.fields if f.name in names and f.name not in ("sequence_id", "offset")]
    names = [f.name for f in kept]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", rank))
            bin_, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                t = table[x]
                k = np.searchsorted(t[:, 0], ranks[at], side="right") - 1
                bin_[at] = t[k, 1] + ranks[at] - t[k, 0]
                off[at] = t[k, 2]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bin_), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = own.join(sums, [part, "length"]).withColumn(rank, plain(first) + plain(seq))
    ranked = ranked.select(*map(plain, names), *([] if "length" in names else ["length"]), plain(rank))
    more = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return map_batches(ranked, place, T.StructType([*kept, *more]), encoders=True)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row a piece."""
    own = pieces(docs, tokenizer, end_id, capacity, keep_ids)
    return _placed(own, [c for c in own.columns if c not in ("part", "seq")], "part", "seq", capacity)
