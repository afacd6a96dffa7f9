"""Spans of a text in DataFrame functions alone, in time linear in the text and in its hits.

Places are sums over the pieces between matches, added up in blocks (``running``) instead of folded into an array that is
copied at each step. Parts of a text are cut from an array of its chunks (``cut``) instead of from its beginning.
Overlaps come from a running largest end over sorted spans instead of from all pairs. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one fold goes over, and code points of a chunk (powers of two).
BLOCK, CHUNK = 64, 1024
_BLOCK_BITS, _CHUNK_BITS = BLOCK.bit_length() - 1, CHUNK.bit_length() - 1
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _larger(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def running(values: Column, op, zero: Column) -> Column:
    """For each element what ``op`` makes of all elements before it, from ``zero``; ``op`` is associative.

    Blocks of ``BLOCK`` elements, then blocks of their totals, then those totals: about ``BLOCK`` steps an element.
    """

    def before(a: Column, start: Column) -> Column:
        return F.transform(a, lambda _, k: F.aggregate(F.slice(a, F.lit(1), k), start, op))

    def level(a: Column, depth: int) -> Column:
        if not depth:
            return before(a, zero)
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(a), F.lit(1)) - 1, _BLOCK_BITS)), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, zero, op))
        return let(blocks, lambda bs: let(level(totals(bs), depth - 1), lambda sums: F.flatten(F.zip_with(bs, sums, before))))

    return let(values, lambda a: level(a, 2))


def matches(text: Column, pattern: str, kind: int, check=None) -> Column:
    """The matches of a pattern, leftmost and non-overlapping, as spans; those that fail ``check`` are left out."""

    def placed(pieces: Column, found: Column) -> Column:
        gaps = F.transform(found, lambda _, k: F.length(F.get(pieces, k)))
        steps = lambda g: F.transform(found, lambda m, k: F.get(g, k) + F.length(m))
        add = lambda a, x: a + x

        def spans(g: Column, past: Column) -> Column:
            def one(m, k):
                start = F.get(past, k) + F.get(g, k)
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("match"))

            return F.transform(found, one)

        return let(gaps, lambda g: let(running(steps(g), add, F.lit(0)), lambda past: spans(g, past)))

    every = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: placed(p, m)))
    return F.filter(every, lambda s: check(s["match"])) if check else every


def chunks(text: Column) -> Column:
    """The text in chunks of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text given as ``chunks``."""
    first = F.shiftright(start, _CHUNK_BITS)
    n = F.shiftright(end - 1, _CHUNK_BITS) - first + 1
    return F.when(end > start, F.substr(F.array_join(F.slice(parts, first + 1, n), ""), start % CHUNK + 1, end - start)).otherwise("")


def apart(proposed: Column, taken: Column) -> Column:
    """Of the proposed spans those that overlap none of the taken ones, by start."""
    own = lambda spans, who: F.transform(spans, lambda s, k: F.struct(s["start"].alias("start"), F.lit(who).alias("who"), s["end"].alias("end"), k.alias("k")))
    far = F.lit(2**31 - 1)

    def free(proposed: Column, both: Column, ends: Column, starts: Column) -> Column:
        n = F.size(both)
        good = F.filter(F.transform(both, lambda s, k: F.struct(s["who"].alias("who"), s["k"].alias("k"), ((F.get(ends, k) <= s["start"]) & (F.get(starts, n - 1 - k) >= s["end"])).alias("free"))), lambda s: (s["who"] == 1) & s["free"])
        return F.transform(good, lambda s: F.get(proposed, s["k"]))

    def merged(p: Column, both: Column) -> Column:
        ends = running(F.transform(both, lambda s: F.when(s["who"] == 0, s["end"]).otherwise(0)), _larger, F.lit(0))
        starts = running(F.transform(F.reverse(both), lambda s: F.when(s["who"] == 0, s["start"]).otherwise(far)), lambda a, x: F.least(a, x), far)
        return let(ends, lambda e: let(starts, lambda s: free(p, both, e, s)))

    return let(proposed, lambda p: F.when(F.size(p) == 0, p).otherwise(let(F.array_sort(F.concat(own(taken, 0), own(p, 1))), lambda both: merged(p, both))))


def replaced(text: Column, spans: Column, names: Column) -> Column:
    """The text with each span (sorted by start) replaced by its kind's name in angle brackets.

    A span that begins within one before it goes with that one.
    """

    def joined(parts: Column, spans: Column, past: Column) -> Column:
        def one(s, k):
            name = F.concat(F.lit("<"), F.element_at(names, s["kind"] + 1), F.lit(">"))
            return F.when(s["start"] >= F.get(past, k), F.concat(cut(parts, F.get(past, k), s["start"]), name)).otherwise("")

        last = F.greatest(F.element_at(past, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(spans, one), ""), cut(parts, last, F.length(text)))

    ends = lambda spans: running(F.transform(spans, lambda s: s["end"]), _larger, F.lit(0))
    done = let(spans, lambda s: let(ends(s), lambda past: let(chunks(text), lambda parts: joined(parts, s, past))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
