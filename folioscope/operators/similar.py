"""Which rows share most of their words with an earlier row: an exact join by prefixes, without all pairs.

A row q with n different words is held by an earlier row p if more than ``share`` of q's words are p's. Then at least
o = floor(share * n) + 1 of them are, so of q's n - o + 1 rarest words (rarest first, by how many rows hold a word) one is p's.
Only those few words are met with the words of all rows, p needs at least o words, and what is left is counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def held_by_earlier(rows: DataFrame, key: str, place: str, words: str, share: float = 0.7) -> DataFrame:
    """(key, earlier): the rows held by an earlier one, with the earliest place of such a row. ``words`` holds no repeats."""
    own = written(rows.select(key, place, F.array_distinct(words).alias("w")).filter(F.size("w") > 0), "words")
    each = own.select(key, F.explode("w").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(df, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r"))
    need = F.floor(share * F.size("w") + 1e-9).cast("int") + 1
    asking = own.join(ranked, key).withColumn("need", need)
    asking = asking.select(F.col(key), F.col(place).alias("_place"), F.col("w").alias("_w"), "need", F.explode(F.slice("r", F.lit(1), F.size("w") - F.col("need") + 1)).alias("r"))
    asking = asking.select(key, "_place", "_w", "need", F.col("r.word").alias("word"))
    known = own.select(F.col(key).alias("_other"), F.col(place).alias("earlier"), F.col("w").alias("_v"), F.explode("w").alias("word"))
    met = asking.join(known, "word").filter((F.col("earlier") < F.col("_place")) & (F.size("_v") >= F.col("need")) & (F.col(key) != F.col("_other")))
    pairs = met.filter(F.size(F.array_intersect("_w", "_v")) >= F.col("need"))
    return pairs.groupBy(key).agg(F.min("earlier").alias("earlier"))
