"""Operator 10: embedding near-duplicates from randomised-rotation binary codes with stored correction factors.

A vector is normed and turned by random rotations; its code is the signs of ``CODE`` turned components. For the first
rotation the correction factor f, the inner product of the vector with its own code, makes <code, q> / f an unbiased
estimate of the cosine with any q, with an error of about sqrt((1 - f^2) / f^2) / sqrt(D - 1).

* Candidates: K bits of the code, drawn for each of L hash tables, are a table's key. K follows the logarithm of the
  number of distinct vectors, so that tables keep short lists; L follows from K, the cosine and the recall wanted at
  exactly that cosine (more similar pairs are found more surely). A row of a table holds an id and a code of fixed size
  (32 bytes), however many tables there are. Lists beyond ``UNIT`` rows are dealt over units.
* Screen: within a unit, pairs whose codes differ in more bits than pairs at the cosine ever do are dropped. A pair
  counts in the first table that it shares and in no other, which the codes tell. Rows left without a pair end here.
* Decision: the others meet their vectors, unit by unit. The estimate and its confidence bound drop pairs that cannot
  reach the cosine; all that remain are recomputed exactly in double precision.
* Results: units give each vector's number of links and a spanning forest of them, never the pairs. Identical vectors
  are one vector with a weight throughout.

Defined results: a null or zero vector, or one with null or non-finite components, links with nothing; vectors of
different lengths don't link (more than ``LENGTHS`` different lengths are refused); rows that share a vec_id count as
vectors of their own; a null vec_id has the component of its vector's smallest id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, numpy_components, small_side, sorted_groups, split_hot, written

UNIT = 1024
#: Bits of a code, and words of 64 bits.
CODE, WORDS = 256, 4
#: Standard deviations of the estimate's error within which a pair is recomputed.
SURE = 3.5
#: Different vector lengths in one table; each has tables of its own.
LENGTHS = 64
SEED = 20_240_101


def rotations(dim: int, n: int) -> np.ndarray:
    """``n`` random rotations, one below the other: (n * dim, dim)."""
    rng = np.random.default_rng(SEED)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def tables(n: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """(bits of a key, number of tables, differing bits at most) for ``n`` distinct vectors.

    Of the pairs at exactly ``cosine``, one in (1 - recall) / 10 may differ in more bits, and the tables find the rest.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(n, 2))) - 5))
    p = max(math.acos(min(1.0, cosine)) / math.pi, 1e-9)
    share = np.array([math.exp(math.lgamma(CODE + 1) - math.lgamma(h + 1) - math.lgamma(CODE - h + 1) + h * math.log(p) + (CODE - h) * math.log1p(-p)) for h in range(CODE + 1)])
    most = int(np.flatnonzero(np.cumsum(share[::-1])[::-1] > (1 - recall) / 10).max())
    hit = np.array([math.prod((CODE - h - k) / (CODE - k) for k in range(bits)) if CODE - h >= bits else 0.0 for h in range(most + 1)])
    count = 1
    while share[: most + 1] @ (1 - (1 - hit) ** count) < recall:
        count += 1
    return bits, count, most


def drawn_bits(bits: int, count: int) -> np.ndarray:
    """The places of the code that make each table's key: (count, bits)."""
    rng = np.random.default_rng(SEED + 1)
    return np.stack([rng.choice(CODE, bits, replace=False) for _ in range(count)])


def _masks(bits: int, count: int) -> np.ndarray:
    on = np.zeros((count, CODE), dtype=bool)
    np.put_along_axis(on, drawn_bits(bits, count), True, axis=1)
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


def encode(reps: DataFrame, dim: int, bits: int, count: int) -> DataFrame:
    """``reps`` (id, m, vec) with its code (``WORDS`` words) and keys (one a table)."""

    def run(batches):
        import pyarrow as pa

        turn, drawn = rotations(dim, -(-CODE // dim))[:CODE], drawn_bits(bits, count)
        for batch in batches:
            sign = _units(_rows(batch.column(2), dim)) @ turn.T > 0
            keys = (sign[:, drawn] @ (1 << np.arange(bits, dtype=np.int64))) | (np.arange(count, dtype=np.int64) << 40)
            code = np.packbits(sign, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(code), _lists(keys)], names=["id", "m", "vec", "code", "keys"])

    kind = reps.schema["vec"].dataType.simpleString()
    return map_batches(reps.select("id", "m", "vec"), run, f"id long, m long, vec {kind}, code array<long>, keys array<long>")


def _rows(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(vec: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is made one first, so that squares neither vanish nor overflow."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def _lists(rows: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(rows).ravel()))


_KEY = ["key", "lo", "hi"]


def screen(coded: DataFrame, bits: int, count: int, most: int) -> DataFrame:
    """(key, lo, hi, blk, id) of the rows that have a pair of at most ``most`` differing bits in their unit."""
    index = split_hot(coded.select("id", "code", F.explode("keys").alias("key")), "key", UNIT)
    names = [*_KEY, "blk", "id", "code"]
    dealt = index.select(*names).repartition(*_KEY).sortWithinPartitions(*_KEY)

    def run(batches):
        import pyarrow as pa

        masks = _masks(bits, count)
        for g in sorted_groups(batches, names, _KEY):
            some = np.zeros(len(g["id"]), dtype=bool)
            for i, j in _close(g, masks, most):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_pydict({k: g[k][some] for k in [*_KEY, "blk", "id"]}, schema=pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("blk", pa.int32()), ("id", pa.int64())]))

    return map_batches(dealt, run, "key long, lo int, hi int, blk int, id long")


def _close(g: dict, masks: np.ndarray, most: int):
    """Pairs (i, j) of one unit with few differing bits that share no earlier table, a chunk at a time."""
    code, total = g["code"].astype(np.int64).view(np.uint64), len(g["id"])
    edge = np.r_[True, (g["key"][1:] != g["key"][:-1]) | (g["lo"][1:] != g["lo"][:-1]) | (g["hi"][1:] != g["hi"][:-1])]
    unit, starts = np.cumsum(edge) - 1, np.r_[np.flatnonzero(edge), total]
    size, whole, table = np.diff(starts), g["lo"] == g["hi"], g["key"] >> 40

    def first(i: np.ndarray, j: np.ndarray):
        ok = whole[i] | (g["blk"][i] != g["blk"][j])
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            differ = code[a] ^ code[b]
            for t, mask in enumerate(masks[: int(table[a].max())]):
                own = (table[a] <= t) | (differ & mask).any(axis=1)
                a, b, differ = a[own], b[own], differ[own]
            yield a, b

    # Short units together, shift by shift; long ones block by block.
    at, d = np.flatnonzero(size[unit] <= 64), 0
    while True:
        d += 1
        at = at[at + d < total]
        at = at[unit[at] == unit[at + d]]
        if not len(at):
            break
        near = np.bitwise_count(code[at] ^ code[at + d]).sum(axis=1) <= most
        yield from first(at[near], at[near] + d)
    for k in np.flatnonzero(size > 64):
        for a in range(starts[k], starts[k + 1], 128):
            b = min(a + 128, starts[k + 1])
            differ = np.zeros((b - a, starts[k + 1] - a), dtype=np.uint16)
            for w in range(code.shape[1]):
                differ += np.bitwise_count(code[a:b, None, w] ^ code[None, a : starts[k + 1], w])
            i, j = np.nonzero(differ <= most)
            later = j > i
            yield from first(i[later] + a, j[later] + a)


def link_units(coded: DataFrame, dim: int, cosine: float, bits: int, count: int, most: int) -> DataFrame:
    """(a, b, n): n links found for vector a (b null), or a link a-b of a spanning forest (n = 0)."""
    left = written(screen(coded, bits, count, most), "screened")
    names = [*_KEY, "blk", "id", "m", "vec", "code"]
    met = coded.select("id", "m", "vec", "code").join(small_side(left), "id")
    dealt = met.select(*names).repartition(*_KEY).sortWithinPartitions(*_KEY)

    def run(batches):
        import pyarrow as pa

        turn, masks = rotations(dim, 1), _masks(bits, count)
        for g in sorted_groups(batches, names, _KEY):
            ids, roots, n = _found(g, turn, dim, cosine, masks, most)
            some = np.flatnonzero(n)
            far = np.flatnonzero(roots != np.arange(len(ids)))
            yield pa.RecordBatch.from_pydict(
                {
                    "a": np.concatenate([ids[some], ids[far]]),
                    "b": pa.array(np.concatenate([ids[some], ids[roots[far]]]), mask=np.r_[np.ones(len(some), bool), np.zeros(len(far), bool)]),
                    "n": np.concatenate([n[some], np.zeros(len(far), dtype=np.int64)]),
                }
            )

    return map_batches(dealt, run, "a long, b long, n long")


def _found(g: dict, turn: np.ndarray, dim: int, cosine: float, masks: np.ndarray, most: int):
    """Ids, forest roots and weighted numbers of links of the rows of one or more whole units."""
    total = len(g["id"])
    unit = _units(g["vec"].astype(np.float64))
    turned = unit @ turn.T
    sign = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dim)
    factor = (sign * turned).sum(axis=1)
    bound = SURE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(dim - 1, 1)) if dim > 1 else np.full(total, np.inf)
    n, forest = np.zeros(total, dtype=np.int64), np.arange(total)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold(forest: np.ndarray) -> np.ndarray:
        far = np.flatnonzero(forest != np.arange(total))
        out = numpy_components(total, np.concatenate([far, *(x for x, _ in held)]), np.concatenate([forest[far], *(y for _, y in held)]))
        held.clear()
        return out

    for a, b in _close(g, masks, most):
        may = np.einsum("ij,ij->i", sign[a], turned[b]) / factor[a] + bound[a] >= cosine
        a, b = a[may], b[may]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        a, b = a[near], b[near]
        np.add.at(n, a, g["m"][b])
        np.add.at(n, b, g["m"][a])
        held.append((a, b))
        if sum(len(x) for x, _ in held) > 500_000:
            forest = fold(forest)
    return g["id"], fold(forest), n


def near_duplicates(vectors: DataFrame, cosine: float, recall: float = 0.99, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = vectors.schema[embedding].dataType.simpleString()
    vec = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = rows.filter("sound").select("vec_id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(SEED), "vec").alias("k2"))
    # Identical vectors are one; 128 hash bits tell vectors apart.
    reps = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    reps = written(reps, "reps")
    parts = []
    sizes = [r["size"] for r in reps.select(F.size("vec").alias("size")).distinct().limit(LENGTHS + 1).collect()]
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    for size in sizes:
        own = reps.filter((F.size("vec") == size) & F.col("id").isNotNull())
        bits, count, most = tables(own.count(), cosine, recall)
        parts.append(written(link_units(written(encode(own, size, bits, count), "codes"), size, cosine, bits, count, most), "found"))
    ids = rows.select("vec_id", F.when(F.col("sound"), F.xxhash64("vec")).alias("k1"), F.when(F.col("sound"), F.xxhash64(F.lit(SEED), "vec")).alias("k2"))
    info = reps.select("k1", "k2", "id", "m")
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
        comps = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id")
        info = info.join(counts, "id", "left").join(comps, "id", "left")
    else:
        info = info.withColumns({"n": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    info = written(info, "vectors")
    joined = written(ids, "ids").join(small_side(info), ["k1", "k2"], "left")
    component = F.coalesce("component", "id", "vec_id")
    links = (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).cast("long")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
