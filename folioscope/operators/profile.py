"""What a table holds, column by column, as a description of all columns at once.

Numbers have count, mean, deviation, least and most, and quartiles from mergeable sketches; texts have their different values,
the commonest of them (the smallest of equals) and how often it stands. Moments and sketches come from one pass with partial
sums in the tasks; texts are counted by (column, value), so that no column's values meet in one task before they are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a sketch: quantiles are off by about a hundredth of the rows at most.
SKETCH = 400


def numbers(df: DataFrame) -> DataFrame:
    """(name, n, mean, deviation, least, quarter, half, three_quarters, most) of each numeric column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    value = lambda c: F.col(f"`{c}`").cast("double")
    parts = []
    for k, c in enumerate(names):
        v = value(c)
        parts.append(F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch")).alias(f"c{k}"))
    one = df.agg(*parts)  # one row
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{k}").alias("s")) for k, c in enumerate(names)]))
    at = lambda q: F.when(F.col("s.n") > 0, F.kll_sketch_get_quantile_double(F.col("s.sketch"), F.lit(q)))
    return one.select(rows.alias("r")).select("r.*").select("name", "s.n", "s.mean", "s.deviation", "s.least", at(0.25).alias("quarter"), at(0.5).alias("half"), at(0.75).alias("three_quarters"), "s.most")


def texts(df: DataFrame) -> DataFrame:
    """(name, n, n_unique, top, freq) of each text column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in names])).alias("r")).select("r.*")
    counted = each.filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("k"))
    top = F.min(F.struct((-F.col("k")).alias("k"), "value"))
    return counted.groupBy("name").agg(F.sum("k").alias("n"), F.count("*").alias("n_unique"), top.alias("t")).select("name", "n", "n_unique", F.col("t.value").alias("top"), (-F.col("t.k")).alias("freq"))


def profile(df: DataFrame) -> DataFrame:
    """Both as one table; what a kind of column doesn't have is null."""
    return numbers(df).unionByName(texts(df), allowMissingColumns=True)
