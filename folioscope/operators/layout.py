"""Shapes, texts and values on pages: rows, clusters and the naming of chart values by their place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import END
from ..functions.text import any_of

#: Signs of kinds of charts, in order; a chart without any is a bar chart.
CHART_SIGNS = {
    "bar": ("revenue", "expense", "profit", "income", "quarterly", "annual", "fy", "fiscal year"),
    "line": ("trend", "over time", "growth", "change", "progression"),
    "pie": ("distribution", "breakdown", "composition", "share", "percentage of total"),
    "area": ("cumulative", "stacked", "total over time"),
    "scatter": ("correlation", "relationship", "vs", "compared to"),
}
#: Words of a chart's labels, words that make a chart a financial one, and units as they are written.
LABELLING = ("revenue", "expense", "margin", "profit")
FINANCIAL = ("revenue", "expense", "income", "profit")
UNITS = {"T": "trillion", "B": "billion", "M": "million", "K": "thousand"}
#: From which sum of money, and which end of a scale (financial or not), a unit is taken.
MONEY_UNITS = ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"))
FINANCIAL_UNITS = ((20, "B"), (5, "M"))
SCALE_UNITS = ((1000, "B"), (100, "M"), (10, "K"))


def unit_pattern(sign: str, word: str) -> str:
    return rf"[0-9]+\.?[0-9]*[ \t\n\r\f]*{word}|[0-9]+\.?[0-9]*{sign.lower()}{END}"


def chart_kind(text: Column) -> Column:
    """The kind with most of its signs in the text, the first of equals."""
    low = F.lower(text)
    counts = {k: reduce(lambda a, b: a + b, [F.contains(low, F.lit(s)).cast("int") for s in signs]) for k, signs in CHART_SIGNS.items()}
    best = F.greatest(*counts.values())
    return F.when(best == 0, "bar").otherwise(F.coalesce(*[F.when(c == best, k) for k, c in counts.items()]))


def chart_metadata(text: Column) -> dict[str, Column]:
    """Fiscal years, the ends of the scale (lines that are numbers), the number of label lines and the unit.

    The lower end is the least number over 0 if there is one. The unit is one that is written, else one that the largest
    sum of money asks for, else one by the upper end of the scale. Numbers beyond 18 digits are no scale.
    """
    low = F.lower(text)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), lambda x: x != "")
    spelled = F.transform(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(?i)FY[ \t]*([0-9]{2,4})"), F.lit(1)))), lambda y: F.concat(F.lit("FY"), y))
    years = F.array_sort(F.array_distinct(F.concat(spelled, F.regexp_extract_all(text, F.lit("(?i)FY[0-9]{2,4}"), F.lit(0)))))
    scale = F.transform(F.filter(lines, lambda x: x.rlike("^[0-9]{1,18}$")), lambda x: x.cast("long"))
    top = F.coalesce(F.array_max(scale), F.lit(0).cast("long"))
    sums = F.transform(F.regexp_extract_all(text, F.lit(r"\$[0-9,]+\.?[0-9]*"), F.lit(0)), lambda x: F.regexp_replace(x, "[$,]", "").try_cast("double"))
    money = F.array_max(sums)

    def first(c: Column, table) -> list[Column]:
        return [F.when(c >= least, unit) for least, unit in table]

    by_scale = F.when(any_of(low, list(FINANCIAL)), F.coalesce(*first(top, FINANCIAL_UNITS)))
    unit = F.coalesce(*[F.when(low.rlike(unit_pattern(k, w)), k) for k, w in UNITS.items()], *first(money, MONEY_UNITS), by_scale, *first(top, SCALE_UNITS), F.lit(""))
    return {
        "years": F.array_join(years, ","),
        "scale_min": F.coalesce(F.array_min(F.filter(scale, lambda v: v > 0)), F.lit(0).cast("long")),
        "scale_max": top,
        "n_labels": F.size(F.filter(lines, lambda x: any_of(F.lower(x), list(LABELLING)))).cast("long"),
        "unit": unit,
    }


def rows_by_gap(blocks: DataFrame, page: str, gap: float) -> DataFrame:
    """(page, row, text): blocks in the order they were found fall into rows; a block further than ``gap`` from the
    first block of the row begins the next. Within a row texts stand from left to right.

    A page holds what fits on paper, so its blocks are gathered; ``ord`` gives the order.
    """
    kind = "struct<ord:int,x:double,y:double,text:string>"
    own = blocks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "text"))).alias("b"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast(f"array<array<{kind}>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["y"].isNotNull() & (F.abs(x["y"] - acc["y"]) < gap)
        n = F.size(acc["rows"])
        longer = F.concat(F.slice(acc["rows"], 1, n - 1), F.array(F.concat(F.element_at(acc["rows"], -1), F.array(x))))
        return F.struct(F.when(same, acc["y"]).otherwise(x["y"]).alias("y"), F.when(same, longer).otherwise(F.concat(acc["rows"], F.array(F.array(x)))).alias("rows"))

    rows = own.select(page, F.posexplode(F.aggregate("b", start, step, lambda acc: acc["rows"])).alias("row", "r"))
    order = F.array_sort("r", lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(F.when(a["ord"] < b["ord"], -1).otherwise(1)))
    return rows.select(page, F.col("row").cast("long").alias("row"), F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))


def near_labels(items: DataFrame, labels: DataFrame, legends: DataFrame, reach: float) -> DataFrame:
    """(page, label, legend, value): values within ``reach`` of a label across, named by the legend nearest in height."""
    at = items.join(labels.select("page", F.col("x").alias("lx"), F.col("text").alias("label")), "page").filter(F.abs(F.col("x") - F.col("lx")) < reach)
    named = at.join(legends.select("page", F.col("y").alias("gy"), F.col("text").alias("legend")), "page", "left")
    nearest = F.min_by("legend", F.struct(F.abs(F.col("gy") - F.col("y")), "gy"))
    return named.groupBy("page", "label", "text", "x", "y").agg(nearest.alias("legend")).select("page", "label", "legend", F.col("text").alias("value"))


def cluster_confidence(elements: DataFrame, cluster: str) -> DataFrame:
    """Half, and more for two font sizes at most, a column under 100 wide, and two to four elements; 0 for one."""
    own = elements.groupBy(cluster).agg(F.count("*").alias("n"), F.countDistinct("size").alias("sizes"), (F.max("x") - F.min("x")).alias("width"))
    more = F.when(F.col("sizes") <= 2, 0.2).otherwise(0.0) + F.when(F.col("width") < 100, 0.2).otherwise(0.0) + F.when(F.col("n").between(2, 4), 0.1).otherwise(0.0)
    return own.select(cluster, "n", F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + more)), 4).alias("confidence"))


def proximity_clusters(elements: DataFrame, page: str, radius: float, most: int) -> DataFrame:
    """(page, cluster, id): greedily, from the top and left, an element takes the nearest free ones within ``radius``.

    Distance is shorter within a column and longer within a row. Each choice depends on those before, so a page, which
    holds what fits on paper, is handled as a whole; pages are spread over the tasks.
    """

    def run(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["y", "x", "id"], ascending=[False, True, True]).reset_index(drop=True)
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        free, out = np.ones(len(rows), dtype=bool), np.full(len(rows), -1)
        for i in range(len(rows)):
            if not free[i]:
                continue
            dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
            column = np.where(dy < 25, dy * 0.3, np.where(dy < 60, dy * 0.6, dy * 1.2))
            d = np.where(dx < 40, column, np.where(dy < 15, dx * 3.0, np.hypot(dx, dy) * 1.1))
            d[i] = -1
            near = np.flatnonzero(free & (d <= radius))
            own = near[np.argsort(d[near], kind="stable")][:most]
            free[own], out[own] = False, out.max() + 1
        return pd.DataFrame({page: key[0], "cluster": out.astype("int64"), "id": rows["id"]})

    kind = elements.schema[page].dataType.simpleString()
    return elements.select(page, "id", "x", "y").groupBy(page).applyInPandas(run, f"{page} {kind}, cluster long, id long")
