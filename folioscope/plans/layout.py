"""Pages and charts: values named by place, rows, clusters and binned points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import layout
from ..sources.tables import literal, load, values
from .registry import query

#: Elements of charts: page, kind, x, y, text. Values at the limits of 50 across, two legends equally near, none near.
CHART = [
    (1, "label", 100.0, 0.0, "FY2022"), (1, "label", 200.0, 0.0, "FY2023"), (1, "legend", 10.0, 40.0, "Revenue"), (1, "legend", 10.0, 80.0, "Expense"),
    (1, "value", 149.0, 45.0, "$5B"), (1, "value", 150.0, 90.0, "$3B"), (1, "value", 210.0, 60.0, "12%"), (1, "value", 260.0, 10.0, "7"), (2, "label", 50.0, 0.0, "FY2024"), (2, "value", 60.0, 5.0, "9"),
]
_CHART = values(CHART, "page, kind, x, y, text")


@query(f"""
    WITH c AS (SELECT * FROM {_CHART}), v AS (SELECT * FROM c WHERE kind = 'value'), l AS (SELECT page, x AS lx, text AS label FROM c WHERE kind = 'label'), g AS (SELECT page, y AS gy, text AS legend FROM c WHERE kind = 'legend'),
    j AS (SELECT v.page, label, v.text AS value, legend, row_number() OVER (PARTITION BY v.page, label, v.text, v.x, v.y ORDER BY abs(gy - v.y), gy) AS rn
          FROM v JOIN l ON v.page = l.page AND abs(v.x - lx) < 50 LEFT JOIN g ON g.page = v.page)
    SELECT page, label, legend, value FROM j WHERE rn = 1""")
def chart_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a chart by the year they stand over and the legend nearest in height."""
    c = literal(spark, CHART, "page int, kind string, x double, y double, text string")
    part = lambda k: c.filter(F.col("kind") == k)  # noqa: E731
    return layout.near_labels(part("value"), part("label"), part("legend"), 50.0)


#: Text blocks as they were found: page, order, x, y, text. The third stays in the row of the first, the fourth doesn't.
BLOCKS = [(1, 0, 0.5, 0.10, "b"), (1, 1, 0.1, 0.115, "a"), (1, 2, 0.9, 0.105, "c"), (1, 3, 0.2, 0.121, "d"), (1, 4, 0.1, 0.135, "e"), (2, 0, 0.3, 0.5, "f")]


@query("SELECT * FROM (VALUES (1, 0, 'a b c'), (1, 1, 'e d'), (2, 0, 'f')) AS t(page, row, text)")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in rows by their distance from the row's first; the SQL states the rows worked out by hand."""
    return layout.rows_by_gap(literal(spark, BLOCKS, "page int, ord int, x double, y double, text string"), "page", 0.02)


@query("""
    WITH e AS (SELECT user_id, round_even(value / 50, 0)::BIGINT AS bin, value FROM events)
    SELECT user_id, bin, count(*) AS n, round(avg(value), 4) AS mean FROM e GROUP BY user_id, bin""")
def scatter_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in bins of their rounded place, halves to even, with the mean of each."""
    own = load(spark, sf_dir, "events").groupBy("user_id", F.bround(F.col("value") / 50).cast("long").alias("bin"))
    return own.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


#: Elements of clusters: cluster, font size, x.
ELEMENTS = [(1, 10, 5.0), (1, 12, 50.0), (2, 10, 0.0), (2, 11, 20.0), (2, 12, 150.0), (3, 9, 1.0), (4, 9, 1.0), (4, 9, 2.0), (4, 9, 3.0), (4, 9, 4.0), (4, 9, 5.0)]


@query(f"""
    WITH c AS (SELECT cluster, count(*) AS n, count(DISTINCT size) AS s, max(x) - min(x) AS w FROM {values(ELEMENTS, 'cluster, size, x')} GROUP BY cluster)
    SELECT cluster, n, CASE WHEN n < 2 THEN 0 ELSE least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN s <= 2 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN w < 100 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN n BETWEEN 2 AND 4 THEN 0.1 ELSE 0 END::DOUBLE) END::DOUBLE AS confidence FROM c""")
def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_confidence(literal(spark, ELEMENTS, "cluster int, size int, x double"), "cluster")


#: Shapes: page, id, x, y. Two columns of three lines, a wide row, and one apart.
SHAPES = [(1, 1, 0.0, 100.0), (1, 2, 5.0, 85.0), (1, 3, 0.0, 70.0), (1, 4, 200.0, 100.0), (1, 5, 205.0, 80.0), (1, 6, 400.0, 10.0), (2, 7, 0.0, 0.0)]


@query("SELECT * FROM (VALUES (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 4), (1, 1, 5), (1, 2, 6), (2, 0, 7)) AS t(page, cluster, id)")
def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that stand together; the SQL states the clusters worked out by hand."""
    return layout.proximity_clusters(literal(spark, SHAPES, "page int, id long, x double, y double"), "page", 60.0, 4)


#: Texts read off charts: written units, sums of money, scales alone, years in several spellings, none of these.
CHART_TEXTS = [
    (-1, "Revenue by year\nFY 22\nFY23\nfy2024\n0\n20\n90\nProfit margin"), (-2, "Cumulative share\n 12 \n1500"), (-3, "$1,250,000.50 and $3 of expense\n4"), (-4, "Growth over time, 3.5 million\n7"),
    (-5, "a trend vs the breakdown, 5t"), (-6, "income 6\n5\n6"), (-7, ""), (-8, "scale\n0\n99999999999999999999"), (-9, "5tons of it\n100"),
]
_TEXTS = f"(SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM {values(CHART_TEXTS, 'doc_id, text')})"


def _chart_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null").unionByName(literal(spark, CHART_TEXTS, "doc_id long, text string"))


_COUNTS = ", ".join(f"{sql.count_of('lower(text)', signs)} AS n_{k}" for k, signs in layout.CHART_SIGNS.items())
_BEST = f"greatest({', '.join(f'n_{k}' for k in layout.CHART_SIGNS)})"


@query(f"SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'bar' {' '.join(f'WHEN n_{k} = {_BEST} THEN {sql.quoted(k)}' for k in layout.CHART_SIGNS)} END AS kind FROM (SELECT doc_id, {_COUNTS} FROM {_TEXTS})")
def chart_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of chart a text speaks of."""
    return _chart_texts(spark, sf_dir).select("doc_id", layout.chart_kind(F.col("text")).alias("kind"))


def _steps(c: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {c} >= {least} THEN '{unit}'" for least, unit in table) + " END"


@query(rf"""
    WITH l AS (SELECT doc_id, text, lower(text) AS low, [trim(x, E' 	') FOR x IN string_split(text, E'
') IF trim(x, E' 	') <> ''] AS lines FROM {_TEXTS}),
    s AS (SELECT *, [CAST(x AS BIGINT) FOR x IN lines IF regexp_full_match(x, '[0-9]{{1,18}}')] AS scale,
        list_sort(list_distinct(['FY' || y FOR y IN flatten([regexp_extract_all(x, '(?i)FY[ 	]*([0-9]{{2,4}})', 1) FOR x IN lines])] || regexp_extract_all(text, '(?i)FY[0-9]{{2,4}}'))) AS years,
        list_max([TRY_CAST(regexp_replace(x, '[$,]', '', 'g') AS DOUBLE) FOR x IN regexp_extract_all(text, '\$[0-9,]+\.?[0-9]*')]) AS money FROM l),
    t AS (SELECT *, coalesce(list_max(scale), 0) AS scale_max FROM s)
    SELECT doc_id, array_to_string(years, ',') AS years, coalesce(list_min([x FOR x IN scale IF x > 0]), 0)::BIGINT AS scale_min, scale_max::BIGINT AS scale_max, len([x FOR x IN lines IF {sql.any_of('lower(x)', layout.LABELLING)}]) AS n_labels,
        coalesce({', '.join(f"CASE WHEN regexp_matches(low, {sql.quoted(layout.unit_pattern(k, w))}) THEN '{k}' END" for k, w in layout.UNITS.items())},
            {_steps('money', layout.MONEY_UNITS)}, CASE WHEN {sql.any_of('low', layout.FINANCIAL)} THEN {_steps('scale_max', layout.FINANCIAL_UNITS)} END, {_steps('scale_max', layout.SCALE_UNITS)}, '') AS unit FROM t""")
def chart_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, scale, labels and unit of the texts read off charts."""
    return _chart_texts(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in layout.chart_metadata(F.col("text")).items()])
