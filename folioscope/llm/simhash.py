"""Operator 9: SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most d differing bits share at least m = 8 - d of their eight positional bytes. The
index lists distinct fingerprints under combinations of positional bytes chosen so that any m shared positions hold
one of them whole (for m of 4 or more twenty triples suffice, by Turán's construction). Within a list, the tally of a
pair starts at the positions that the list fixes and goes on over the others; the count filter drops pairs that stay
below m, and the differing bits of those that reach it are counted.

Here this departs from an index of single bytes whose postings are merged: such a list would hold a 256th of the corpus
and the tallies would be shuffled pair by pair, both growing with its square. A list of three bytes holds a 2^24th, and
the row carries its other bytes with it, so the tally ends where it begins. Lists give back a spanning forest of their
links rather than all pairs, lists beyond ``UNIT`` rows are dealt over several units, and components are found by star
contraction. Near copies have no more different fingerprints than lie within a few bits of each other, which bounds the
long lists that dealing repeats.

Defined results: a text without words (or null) has the fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows and equal fingerprints fall together without comparison; rows whose doc_id is
null get their fingerprint and the component of that fingerprint; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, numpy_components, plain, small_side, sorted_groups, split_hot, written

#: Fingerprints of a list that one unit compares; longer lists are dealt over several units.
UNIT = 2048
SEED = 42


def fingerprint(text: str | None, words: int, run: int = 1 << 16) -> int:
    """The SimHash of a text: A-Z lower-cased, words parted by ASCII white space, majority over XXH64 of shingles."""
    import xxhash

    own = (text or "").encode().lower().split()
    if not own:
        return 0
    flat = b" ".join(own)
    ends = list(accumulate(len(w) + 1 for w in own))
    starts = [0, *ends[:-1]]
    tails = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(tails), run):
        part = np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts[k : k + run], tails[k : k + run])], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(tails), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(1)
            fp = np.array([fingerprint(text[k].as_py(), words) for k in range(len(text))], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def byte_blocks(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``least`` of the eight positions include one of them."""
    if least < 4:
        return list(combinations(range(8), least))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [g for g in groups if len(g) == 3]
    for k, g in enumerate(groups):
        out += [(*two, one) for two in combinations(g, 2) for one in groups[(k + 1) % 3]]
    return out


def _keys(least: int):
    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)

    keys = []
    for n, block in enumerate(byte_blocks(least)):
        key = F.lit(n).cast("long")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return F.explode(F.array(*keys))


def links(reps: DataFrame, bits: int) -> DataFrame:
    """(a, b): a spanning forest, list by list, of the links between ``reps`` (id, fp), all fingerprints distinct."""
    if not 0 <= bits <= 7:
        raise ValueError("the index serves up to 7 differing bits")
    least = 8 - bits
    index = split_hot(reps.select("id", "fp", _keys(least).alias("key")), "key", UNIT)
    dealt = index.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        import pyarrow as pa

        for g in sorted_groups(batches, ["key", "lo", "hi", "blk", "id", "fp"], ["key", "lo", "hi"]):
            a, b = _linked(g, least, bits)
            yield pa.RecordBatch.from_pydict({"a": g["id"][a], "b": g["id"][b]})

    return map_batches(dealt.select("key", "lo", "hi", "blk", "id", "fp"), run, "a long, b long")


def _linked(g: dict, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(g["fp"])
    fp, blk = g["fp"], g["blk"]
    edge = np.r_[True, (g["key"][1:] != g["key"][:-1]) | (g["lo"][1:] != g["lo"][:-1]) | (g["hi"][1:] != g["hi"][:-1])]
    unit = np.cumsum(edge)
    whole = g["lo"] == g["hi"]
    # The positional bytes that a row's list fixes count for each of its pairs; the tally goes on over the others.
    blocks = byte_blocks(least)
    fixed = len(blocks[0])
    other = np.array([[p not in b for p in range(8)] for b in blocks])[g["key"] >> (8 * fixed)]
    posted = fp.view(np.uint8).reshape(-1, 8)
    forest = np.arange(n)
    found_a, found_b, held = [], [], 0
    at, d = np.arange(n), 0
    while True:
        d += 1
        at = at[at + d < n]
        at = at[unit[at] == unit[at + d]]
        if not len(at):
            break
        shared = fixed + ((posted[at] == posted[at + d]) & other[at]).sum(axis=1)
        ok = (shared >= least) & (whole[at] | (blk[at] != blk[at + d]))
        differ = fp[at] ^ fp[at + d]
        ok[ok] = np.bitwise_count(differ[ok].view(np.uint64)) <= bits
        found_a.append(at[ok])
        found_b.append(at[ok] + d)
        held += len(found_a[-1])
        if held > 300_000:
            forest = _folded(n, forest, found_a, found_b)
            found_a, found_b, held = [], [], 0
    forest = _folded(n, forest, found_a, found_b)
    far = np.flatnonzero(forest != np.arange(n))
    return far, forest[far]


def _folded(n: int, forest: np.ndarray, a: list, b: list) -> np.ndarray:
    far = np.flatnonzero(forest != np.arange(n))
    return numpy_components(n, np.concatenate([far, *a]).astype(np.int64), np.concatenate([forest[far], *b]).astype(np.int64))


def near_duplicates(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    fps = written(fingerprints(docs, words), "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "reps")
    own = connected_components(links(reps.filter("id is not null"), bits)).withColumnRenamed("node", "id")
    classes = written(reps.join(own, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "classes")
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns stay.

    Rows whose doc_id is null stay; so do all rows of a doc_id that stays.
    """
    own = near_duplicates(docs, words, bits)
    dropped = written(own.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return docs.join(small_side(dropped), "doc_id", "left_anti").select(*map(plain, docs.columns))
