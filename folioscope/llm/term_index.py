"""Operator 11: ranked lexical search by Block-Max WAND over compressed posting blocks.

**Index.** Documents are cut into shards of about ``SHARD_BYTES`` of text where they lie; no text and no posting is
shuffled. A shard's postings are sorted by term and document and cut into blocks of ``BLOCK`` postings. A block is a row:
its term, its first and last document (numbers within the shard), the gaps between documents and the term counts, each
packed in 1, 2 or 4 bytes as the block needs, and its impact frontier: the (term count, document length) pairs that no
other posting of the block beats in both. Since a score rises with the count and falls with the length, the frontier gives
the block's exact maximum impact for any corpus statistics, so an index stays right as others are added beside it. One
row a shard holds its documents' ids and lengths.

**Search.** Questions are taken in sets of at most ``QUESTION_ROWS`` terms, each sent to every task. Only the blocks of
their terms are read. In a shard, the pointers of all lists of a question are moved shallowly from block edge to block edge:
between two edges the sum of the maxima of the blocks there bounds every score. Stretches whose bound is below the
threshold are skipped, and a block is unpacked only if one of its stretches is left. Stretches are opened from the
largest bound on; a question's k-th best score so far is its threshold, and the first stretch below it ends the shard.
One shard in about the square root of their number is searched first; the k-th best scores found there are the first
thresholds in all others. Every task gives back its shard's best k, and the best of those are ranked.

Defined results: a null or empty text, or one without a term, is no document of the statistics and is never found; every
row is a document of its own, so equal rows share a score and take ranks one after the other; rows whose doc_id is null
count in the statistics and are ranked last among equals; rows of one item_id are one question, and rows without an item_id are none; a question without
terms, or whose terms occur nowhere, has no rows; an empty table on either side gives no rows; a very long text is a shard of its own and is cut at word edges while
it is read; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, small_side, sorted_groups_of_rows, written
from .words import counted_words

#: Postings of a block, bytes of text of a shard, and terms of all questions that are sent to every task at once.
BLOCK, SHARD_BYTES, QUESTION_ROWS = 128, 8_000_000, 100_000
#: Shards that a task searches, about.
SHARDS_A_TASK = 4
#: Stretches that are opened before the threshold is looked at again, doubled each time.
OPEN = 8

SCHEMA = "shard long, term string, block int, first int, last int, n int, total long, docs binary, counts binary, frontier binary"


# --- packing ----------------------------------------------------------------------------------------------------------


def widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes (1, 2 or 4) that the values of each block take."""
    most = np.maximum.reduceat(values, starts)
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


def packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of blocks of numbers, each block as its width and its numbers in little-endian order."""
    wide = widths(values, starts)
    size = np.diff(np.r_[starts, len(values)])
    offsets = np.r_[0, np.cumsum(size * wide + 1)]
    out = np.zeros(offsets[-1], dtype=np.uint8)
    out[offsets[:-1]] = wide
    of = np.repeat(np.arange(len(starts)), size)
    at = offsets[of] + 1 + (np.arange(len(values)) - starts[of]) * wide[of]
    for b in range(4):
        own = wide[of] > b
        out[at[own] + b] = (values[own] >> (8 * b)) & 255
    return out, offsets


def unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(block, dtype=f"<u{block[0]}", offset=1).astype(np.int64)


def frontiers(count: np.ndarray, length: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u4 pairs of count and length, offsets in bytes): of each block the pairs that no other beats in both."""
    block = np.zeros(len(count), dtype=np.int64)
    block[starts[1:]] = 1
    block = np.cumsum(block)
    order = np.lexsort([-count, length, block])
    best = np.maximum.accumulate((block[order] << 32) | count[order])
    keep = np.r_[True, best[1:] > best[:-1]]
    own = order[keep]
    pairs = np.stack([count[own], length[own]], axis=1).astype("<u4")
    return pairs.view(np.uint8).reshape(-1), np.r_[0, np.cumsum(np.bincount(block[own], minlength=len(starts)))] * 8


# --- index ------------------------------------------------------------------------------------------------------------


def index(docs: DataFrame) -> DataFrame:
    """The posting blocks of ``docs`` (doc_id, text), written to the shared folder."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                text = text.as_py() or b""
                held.append((doc, text))
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from _shard(shard, held)
                    shard, held, size = shard + 1, [], 0
        if held:
            yield from _shard(shard, held)

    return written(map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA), "postings")


def _shard(shard: int, docs: list):
    import pyarrow as pa

    words, doc, term, count, length = counted_words(t for _, t in docs)
    ids = pa.array([d for d, _ in docs], pa.int64())
    docs.clear()
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy()
    about = (numbers.astype("<i8").tobytes(), length.astype("<u4").tobytes(), np.packbits(valid).tobytes())
    yield pa.RecordBatch.from_pydict({"shard": [shard], "term": pa.array([None], pa.string()), "block": pa.array([0], pa.int32()), "first": pa.array([0], pa.int32()), "last": pa.array([0], pa.int32()), "n": pa.array([int((length > 0).sum())], pa.int32()), "total": [int(length.sum())], "docs": pa.array([about[0]], pa.binary()), "counts": pa.array([about[1]], pa.binary()), "frontier": pa.array([about[2]], pa.binary())})
    if not len(doc):
        return
    new = np.r_[True, term[1:] != term[:-1]]
    begin = np.flatnonzero(new)  # of each term
    nth = np.arange(len(term)) - begin[np.cumsum(new) - 1]
    starts = np.flatnonzero(nth % BLOCK == 0)
    gaps = np.r_[0, np.diff(doc)]
    gaps[starts] = 0
    size = np.diff(np.r_[starts, len(doc)])
    made = [packed(gaps, starts), packed(count, starts), frontiers(count, length[doc], starts)]
    last = doc[starts + size - 1]
    names = pa.array(words, pa.binary()).cast(pa.string())
    for a in range(0, len(starts), 20_000):
        own = slice(a, min(a + 20_000, len(starts)))
        n = own.stop - a
        binaries = []
        for data, offsets in made:
            lo, hi = offsets[a], offsets[own.stop]
            binaries.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets[a : own.stop + 1] - lo).astype("<i4").tobytes()), pa.py_buffer(data[lo:hi].tobytes())]))
        at = starts[own]
        columns = [pa.array(np.full(n, shard)), names.take(pa.array(term[at])), pa.array((nth[at] // BLOCK).astype("i4")), pa.array(doc[at].astype("i4")), pa.array(last[own].astype("i4")), pa.array(size[own].astype("i4")), pa.nulls(n, pa.int64()), *binaries]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "term", "block", "first", "last", "n", "total", "docs", "counts", "frontier"])


# --- questions --------------------------------------------------------------------------------------------------------


def question_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of questions (item_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            words, doc, term, count, _ = counted_words((t.as_py() or b"" for t in texts))
            names = pa.array(words, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), names.take(pa.array(term)), pa.array(count)], names=["item_id", "term", "times"])

    return map_batches(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), run, "item_id long, term string, times long")


def weighed(asked: DataFrame, postings: DataFrame, n_docs: int) -> DataFrame:
    """``asked`` with ``w`` = floor(1000 ln((2N + 2) / (2 df + 1))); terms that no document holds drop out."""
    own = postings.filter("term is not null").join(small_side(asked.select("term").distinct()), "term", "left_semi")
    df = own.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    return asked.join(df, "term").withColumn("w", weight.cast("long")).drop("df")


# --- search -----------------------------------------------------------------------------------------------------------


class Questions:
    """Questions as arrays: ``terms`` sorted; for item k its terms ``term[begin[k]:begin[k + 1]]`` with their factors."""

    def __init__(self, items, terms, times, weights):
        order = np.lexsort([terms, items])
        self.items, at = np.unique(items[order], return_inverse=True)
        self.term = terms[order]
        self.factor = (times * weights)[order]
        self.begin = np.searchsorted(at, np.arange(len(self.items) + 1))


def impacts(count: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a posting adds for each unit of weight."""
    return (1_000_000_000 * count) // (1000 * count + 8 * (25 + (75 * length * n_docs) // total))


class Shard:
    """The blocks of one shard: headers with maximum impacts, and postings that are unpacked when first needed."""

    def __init__(self, term, first, last, docs, counts, frontier, length, n_docs, total):
        self.first, self.last, self.docs, self.counts = first, last, docs, counts
        self.length, self.n_docs, self.total = length, n_docs, total
        sizes = np.array([len(f) // 8 for f in frontier])
        pairs = np.frombuffer(b"".join(frontier), dtype="<u4").reshape(-1, 2).astype(np.int64)
        self.most = np.maximum.reduceat(impacts(pairs[:, 0], pairs[:, 1], n_docs, total), np.r_[0, np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
        self.terms, self.begin = np.unique(term, return_index=True)
        self.begin = np.r_[self.begin, len(term)]
        self.open: dict = {}

    def blocks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``terms``, blocks) of the lists that the shard has."""
        k = np.searchsorted(self.terms, terms)
        k[k == len(self.terms)] = 0
        has = np.flatnonzero(self.terms[k] == terms) if len(self.terms) else np.zeros(0, dtype=np.int64)
        lo, n = self.begin[k[has]], self.begin[k[has] + 1] - self.begin[k[has]]
        own = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(has) else np.zeros(0, dtype=np.int64)
        return np.repeat(has, n), own

    def postings(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if block not in self.open:
            doc = self.first[block] + np.cumsum(unpacked(self.docs[block]))
            self.open[block] = doc, impacts(unpacked(self.counts[block]), self.length[doc], self.n_docs, self.total)
        return self.open[block]

    def best(self, terms: np.ndarray, factors: np.ndarray, least: int, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best ``k`` with a score of at least ``least`` and above 0; equal ones by id."""
        which, blocks = self.blocks(terms)
        none = np.zeros(0, dtype=np.int64)
        if not len(blocks):
            return none, none
        bound = factors[which] * self.most[blocks]
        # Shallow moves: between two edges no list changes its block, so one sum bounds all documents there.
        edges = np.unique(np.r_[self.first[blocks], self.last[blocks] + 1])
        lo, hi = np.searchsorted(edges, self.first[blocks]), np.searchsorted(edges, self.last[blocks] + 1)
        most = np.cumsum(np.bincount(lo, bound, len(edges)).astype(np.int64) - np.bincount(hi, bound, len(edges)).astype(np.int64))[:-1]
        by_bound = np.argsort(-most, kind="stable")
        doc, score, at, step = none, none, 0, OPEN
        while at < len(by_bound) and most[by_bound[at]] >= max(least, 1):
            now = by_bound[at : at + step]
            now = np.sort(now[most[now] >= max(least, 1)])
            at, step = at + step, step * 2
            chosen = np.zeros(len(edges), dtype=np.int64)
            chosen[now] = 1
            reach = np.r_[0, np.cumsum(chosen)]
            parts = []
            for b in np.flatnonzero(reach[hi] > reach[lo]):  # blocks with a chosen stretch; the others stay packed
                d, impact = self.postings(int(blocks[b]))
                own = chosen[np.searchsorted(edges, d, side="right") - 1] > 0
                parts.append((d[own], impact[own] * factors[which[b]]))
            d, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            d, place = np.unique(d, return_inverse=True)
            total = np.zeros(len(d), dtype=np.int64)
            np.add.at(total, place, sums)
            doc, score = np.r_[doc, d], np.r_[score, total]
            keep = np.lexsort([ids[doc], -score])
            keep = keep[score[keep] > 0][:k]
            doc, score = doc[keep], score[keep]
            if len(doc) == k:
                least = max(least, int(score[-1]))
        good = score >= least
        return doc[good], score[good]


def _searched(blocks: DataFrame, q: Questions, least: dict, k: int, n_docs: int, total: int, shards: int) -> DataFrame:
    """(item_id, doc_id, score): the best ``k`` of every shard for every question. A task takes a few of ``shards``."""

    def run(batches):
        import pyarrow as pa

        floors = np.array([least.get(int(i), 0) for i in q.items])
        for g in sorted_groups_of_rows(batches, "shard"):
            term = g["number"].to_numpy(zero_copy_only=False)
            about = int(np.flatnonzero(np.isnan(term.astype(float)))[0])
            ids = np.frombuffer(g["docs"][about].as_py(), dtype="<i8")
            valid = np.unpackbits(np.frombuffer(g["frontier"][about].as_py(), dtype=np.uint8), count=len(ids)).astype(bool)
            length = np.frombuffer(g["counts"][about].as_py(), dtype="<u4").astype(np.int64)
            rank_ids = np.where(valid, ids, np.iinfo(np.int64).max)
            own = np.flatnonzero(np.arange(len(term)) != about)
            numbers = term[own].astype(np.int64)
            order = own[np.lexsort([g["block"].to_numpy()[own], numbers])]
            take = lambda c: g[c].take(pa.array(order))
            shard = Shard(term[order].astype(np.int64), take("first").to_numpy().astype(np.int64), take("last").to_numpy().astype(np.int64), take("docs").to_pylist(), take("counts").to_pylist(), take("frontier").to_pylist(), length, n_docs, total)
            out = [[], [], []]
            for i in range(len(q.items)):
                s = slice(q.begin[i], q.begin[i + 1])
                doc, score = shard.best(q.term[s], q.factor[s], int(floors[i]), k, rank_ids)
                if len(doc) == k:  # this shard's k-th best bounds the best of all
                    floors[i] = max(floors[i], score[-1])
                out[0].append(np.full(len(doc), q.items[i]))
                out[1].append(doc)
                out[2].append(score)
            item, doc, score = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids[doc], pa.int64(), mask=~valid[doc]), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    columns = ["shard", "number", "block", "first", "last", "docs", "counts", "frontier"]
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_A_TASK)
    dealt = blocks.select(*columns).repartition(parts, "shard").sortWithinPartitions("shard")
    return map_batches(dealt, run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _answered(asked: DataFrame, postings: DataFrame, k: int, n_docs: int, total: int, shards: int) -> DataFrame:
    """The best ``k`` for one set of questions (item_id, term, times, w) that fits ``QUESTION_ROWS``."""
    spark = postings.sparkSession
    rows = asked.toArrow()  # at most QUESTION_ROWS, or the terms of a single question
    terms = np.array(sorted(set(rows["term"].to_pylist())), dtype=object)
    number = {t: n for n, t in enumerate(terms)}
    q = Questions(rows["item_id"].to_numpy(), np.array([number[t] for t in rows["term"].to_pylist()], dtype=np.int64), rows["times"].to_numpy(), rows["w"].to_numpy())
    import pyarrow as pa

    known = spark.createDataFrame(pa.table({"term": pa.array(list(terms), pa.string()), "number": pa.array(range(len(terms)), pa.int64())}))
    about = postings.filter("term is null").withColumn("number", F.lit(None).cast("long"))
    blocks = postings.filter("term is not null").join(F.broadcast(known), "term").unionByName(about)
    few = max(1, math.isqrt(shards))
    first = F.pmod(F.xxhash64("shard"), F.lit(few)) == 0
    start = written(_ranked(_searched(blocks.filter(first), q, {}, k, n_docs, total, shards // few), k), "first")
    least = {r["item_id"]: r["score"] for r in start.filter(F.col("rank") == k).select("item_id", "score").collect()}  # a row a question of the set
    rest = _searched(blocks.filter(~first), q, least, k, n_docs, total, shards)
    return _ranked(start.drop("rank").unionByName(rest), k)


def search(items: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each question (item_id, text) its best ``k`` documents of the index."""
    n_docs, total, shards = postings.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    asked = written(weighed(question_terms(items.filter("item_id is not null")), postings, n_docs), "questions")
    parts = [(asked, 0)]
    found = []
    while parts:  # sets that fit; larger ones are halved by a hash of the item
        own, depth = parts.pop()
        if own.limit(QUESTION_ROWS + 1).count() > QUESTION_ROWS and own.select("item_id").distinct().limit(2).count() > 1:
            bit = F.shiftright(F.xxhash64("item_id"), depth).bitwiseAND(1)
            parts += [(own.filter(bit == b), depth + 1) for b in (0, 1)]
        elif not own.isEmpty():
            found.append(written(_answered(own, postings, k, n_docs, total, shards), "answers"))
    out = found[0] if found else asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    for f in found[1:]:
        out = out.unionByName(f)
    discard(asked)
    return out.select("item_id", F.col("rank").cast("int"), "doc_id", "score")
