"""Chunks, line samples, registries of texts, versions and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.shared import written


def metadata_hash(*columns: str) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)


def registry(docs: DataFrame) -> DataFrame:
    """(hash, first_doc, last_doc, uploads) of distinct texts."""
    rows = docs.select(F.sha2("text", 256).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("uploads"))


def match_registry(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads with the job that holds their text: an earlier document, or they themselves."""
    own = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    both = own.join(known.select("hash", "first_doc"), "hash", "left")
    return both.select("doc_id", F.coalesce("first_doc", "doc_id").alias("job"), F.col("first_doc").isNotNull().alias("duplicate"))


def without(rows: DataFrame, doomed: DataFrame, key: str, needed: str) -> DataFrame:
    """Rows whose key is not doomed and whose ``needed`` column holds something."""
    return rows.filter(F.col(needed).isNotNull()).join(doomed, key, "left_anti")


def chunks(docs: DataFrame, size: int, overlap: int, keep: list[str] = []) -> DataFrame:
    """(doc_id, chunk, content): windows of ``size`` words that share ``overlap`` with the one before."""
    step = size - overlap
    own = docs.filter(F.col("text").rlike(r"\S")).select("doc_id", *keep, words(F.col("text")).alias("w"))
    last = F.when(F.size("w") <= size, 0).otherwise(F.ceil((F.size("w") - overlap) / step) - 1)
    # The windows are cut before they are parted, so that a long text's words are not copied into each of them.
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.array_join(F.slice("w", (k * step + 1).cast("int"), F.lit(size)), " "))
    each = own.select("doc_id", *keep, F.posexplode(cut).alias("chunk", "content"))
    return each.select("doc_id", *keep, F.col("chunk").cast("long").alias("chunk"), "content")


def sampled_lines(docs: DataFrame, pattern: str, head: int = 15, tail: int = 10) -> DataFrame:
    """Kept lines of each text: the first and last hundredths, and lines between that hold ``pattern``.

    Array functions alone: lines are neither exploded nor shuffled, whatever their number.
    """
    own = docs.select("doc_id", F.split("text", "\n").alias("l"))
    n = F.size("l")
    first, last = F.floor(n * head / 100) + 1, n - F.floor(n / tail)
    kept = F.filter("l", lambda x, k: (k < first) | (k >= last) | F.lower(x).rlike(pattern))
    return own.select("doc_id", F.size(kept).cast("long").alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("digest"))


def lines_inside(rows: DataFrame, key: str, text: str, opening: str, closing: str) -> DataFrame:
    """Trimmed lines between the marks that are no markup: their number and digest."""
    state = F.struct(F.lit(0).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inside = acc["inside"] + F.when(F.contains(x, F.lit(opening)), 1).when(F.contains(x, F.lit(closing)), -1).otherwise(0)
        good = (inside > 0) & ~F.startswith(F.trim(x), F.lit("<")) & (F.trim(x) != "")
        return F.struct(inside.alias("inside"), F.when(good, F.concat(acc["out"], F.array(F.trim(x)))).otherwise(acc["out"]).alias("out"))

    found = rows.select(key, F.aggregate(F.split(text, "\n"), state, step, lambda acc: acc["out"]).alias("l")).filter(F.size("l") > 0)
    return found.select(key, F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


def uncovered(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes (page, box, x0, y0, x1, y1, area) of which no larger one covers more than ``share``."""
    s, big = boxes.alias("s"), boxes.alias("l")
    wide = F.greatest(F.lit(0.0), F.least("l.x1", "s.x1") - F.greatest("l.x0", "s.x0"))
    high = F.greatest(F.lit(0.0), F.least("l.y1", "s.y1") - F.greatest("l.y0", "s.y0"))
    larger = (F.col("l.area") > F.col("s.area")) | ((F.col("l.area") == F.col("s.area")) & (F.col("l.box") < F.col("s.box")))
    return s.join(big, (F.col("s.page") == F.col("l.page")) & (F.col("s.box") != F.col("l.box")) & larger & (wide * high > share * F.col("s.area")), "left_anti")


def _ranged(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (narrow ones) written by ranges of their key, with the number of the range; rows without a key come first.

    The ranges hold about as many rows each, however the keys lie, so there are no more of them than tasks.
    """
    return written(rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id().cast("long")), "ranges")


def numbered(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Rows numbered from 1 in each group (not null) by key: ranks within a range, and the rows of the ranges before it."""
    own = _ranged(rows, key)
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = own.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(group, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_range").orderBy(key))
    return own.withColumn("_rank", rank).join(sizes, [group, "_range"]).withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_range", "_rank", "_before")


def lagged(rows: DataFrame, group: str, key: str, columns: list[str], name: str) -> DataFrame:
    """Rows with ``columns`` of the row before them in their group as a struct: the last row of each range is carried over."""
    own = _ranged(rows, key).withColumn("_own", F.struct(*columns))
    last = own.groupBy(group, "_range").agg(F.max_by("_own", F.struct(F.col(key))).alias("_last"))
    carried = last.select(F.col(group).alias("_group"), F.col("_range").alias("_r"), F.lag("_last").over(Window.partitionBy(group).orderBy("_range")).alias("_carried"))
    here = F.lag("_own").over(Window.partitionBy(group, "_range").orderBy(key))
    both = own.withColumn("_here", here).join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    return both.withColumn(name, F.coalesce("_here", "_carried")).drop("_range", "_own", "_group", "_r", "_carried", "_here")
