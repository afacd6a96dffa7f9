"""Layout of the documents themselves: lines and paragraphs set on sheets of fifty lines, as boxes, points and elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest, layout
from ..sources.tables import load
from .registry import query

#: Lines of a sheet, height of a line, width of a sign.
LINES, HIGH, WIDE = 50, 12.0, 6.0
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"

#: ln: lines with their sheet and box; pa: paragraphs, runs of lines that aren't blank, sheet by sheet; nu: numbers at their place.
_SHEETS = f"""
    ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
    ln AS (SELECT doc_id, n, line, doc_id || '-' || (n // {LINES}) AS page, {WIDE}::DOUBLE * (length(line) - length(ltrim(line, ' '))) AS x0, {WIDE}::DOUBLE * length(line) AS x1, {HIGH}::DOUBLE * (n % {LINES}) AS y0,
        {HIGH}::DOUBLE * (n % {LINES}) + {HIGH}::DOUBLE AS y1, sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM ls),
    tx AS (SELECT * FROM ln WHERE trim(line, ' ') <> ''),
    pa AS (SELECT page, min(n) AS first, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM tx GROUP BY page, para),
    nt AS (SELECT page, n, y0, line, unnest(regexp_extract_all(line, '{_NUMBER}')) AS text, generate_subscripts(regexp_extract_all(line, '{_NUMBER}'), 1) - 1 AS k FROM tx),
    nu AS (SELECT page, n || '.' || k AS point, {WIDE}::DOUBLE * (instr(line, text) - 1) AS x, y0 + {HIGH / 2}::DOUBLE AS y, text FROM nt)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't blank, with their sheet, their box and the number of their paragraph."""
    each = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    blank = F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("n"))
    top = HIGH * (F.col("n") % LINES)
    own = each.select("doc_id", "n", "line", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.floor(F.col("n") / LINES).cast("string")).alias("page"), (WIDE * (F.length("line") - F.length(F.ltrim("line")))).alias("x0"), (WIDE * F.length("line")).alias("x1"), top.alias("y0"), (top + HIGH).alias("y1"), blank.alias("para"))
    return own.filter(F.trim("line") != "")


def _paragraphs(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page", "para").agg(F.min("n").alias("first"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("para")


def _numbers(lines: DataFrame) -> DataFrame:
    own = lines.select("page", "n", "y0", "line", F.posexplode(F.regexp_extract_all("line", F.lit(_NUMBER), F.lit(0))).alias("k", "text"))
    return own.select("page", F.concat(F.col("n").cast("string"), F.lit("."), F.col("k").cast("string")).alias("point"), (WIDE * (F.instr("line", F.col("text")) - 1)).alias("x"), (F.col("y0") + HIGH / 2).alias("y"), "text")


@query(f"WITH {_SHEETS} SELECT page, point, min(first) AS box FROM nu JOIN pa USING (page) WHERE x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5 GROUP BY page, point")
def point_in_box_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph of its sheet that each number stands in, widened by five."""
    lines = _lines(spark, sf_dir)
    near = F.col("x").between(F.col("x0") - 5, F.col("x1") + 5) & F.col("y").between(F.col("y0") - 5, F.col("y1") + 5)
    return _numbers(lines).join(_paragraphs(lines), "page").filter(near).groupBy("page", "point").agg(F.min("first").alias("box"))


@query(f"""
    WITH {_SHEETS}, b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM (SELECT page, 2 * n + 1 AS box, x0, y0, x1, y1 FROM tx UNION ALL SELECT page, 2 * first, x0, y0, x1, y1 FROM pa))
    SELECT page, box FROM b s WHERE NOT EXISTS (SELECT 1 FROM b l WHERE l.page = s.page AND l.box <> s.box AND (l.area > s.area OR (l.area = s.area AND l.box < s.box))
        AND greatest(0, least(l.x1, s.x1) - greatest(l.x0, s.x0)) * greatest(0, least(l.y1, s.y1) - greatest(l.y0, s.y0)) > 0.5 * s.area)""")
def box_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines and paragraphs those that no larger box of the sheet covers by more than half."""
    lines = _lines(spark, sf_dir)
    place = ["x0", "y0", "x1", "y1"]
    b = lines.select("page", (2 * F.col("n") + 1).alias("box"), *place).unionByName(_paragraphs(lines).select("page", (2 * F.col("first")).alias("box"), *place))
    return ingest.uncovered(b.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).select("page", "box")


@query(f"""
    WITH {_SHEETS}, v AS (SELECT * FROM nu WHERE NOT regexp_matches(text, '^(19|20)[0-9]{{2}}$')), l AS (SELECT page, x AS lx, text AS label FROM nu WHERE regexp_matches(text, '^(19|20)[0-9]{{2}}$')),
    g AS (SELECT page, y0 AS gy, regexp_extract(line, '[^ ]+') AS legend FROM tx),
    j AS (SELECT v.page, label, v.text AS value, legend, row_number() OVER (PARTITION BY v.page, label, v.text, v.x, v.y ORDER BY abs(gy - v.y), gy) AS rn FROM v JOIN l ON v.page = l.page AND abs(v.x - lx) < 50 LEFT JOIN g ON g.page = v.page)
    SELECT page, label, legend, value FROM j WHERE rn = 1""")
def chart_values_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by the year that stands within 50 of them across the sheet, named by the line nearest in height."""
    lines = _lines(spark, sf_dir)
    numbers, year = _numbers(lines), F.col("text").rlike("^(19|20)[0-9]{2}$")
    legends = lines.select("page", F.col("y0").alias("y"), F.regexp_extract("line", "[^ ]+", 0).alias("text"))
    return layout.near_labels(numbers.filter(~year), numbers.filter(year), legends, 50.0)


@query(f"""
    WITH {_SHEETS}, e AS (SELECT page || '/' || para AS cluster, CASE WHEN upper(line) = line AND lower(line) <> line THEN 12 WHEN regexp_matches(line, '^[0-9]+[.]') THEN 11 ELSE 10 END AS size, x0 AS x FROM tx),
    c AS (SELECT cluster, count(*) AS n, count(DISTINCT size) AS s, max(x) - min(x) AS w FROM e GROUP BY cluster)
    SELECT cluster, n, CASE WHEN n < 2 THEN 0 ELSE least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN s <= 2 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN w < 100 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN n BETWEEN 2 AND 4 THEN 0.1 ELSE 0 END::DOUBLE) END::DOUBLE AS confidence FROM c""")
def cluster_confidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as clusters of lines; headings in capitals and numbered lines count as larger type."""
    lines = _lines(spark, sf_dir)
    size = F.when((F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line")), 12).when(F.col("line").rlike("^[0-9]+[.]"), 11).otherwise(10)
    own = lines.select(F.concat("page", F.lit("/"), F.col("para").cast("string")).alias("cluster"), size.alias("size"), F.col("x0").alias("x"))
    return layout.cluster_confidence(own, "cluster")


_TOKEN = r"[^ \t]*[0-9%$][^ \t]*"
_CLASS = "CASE WHEN regexp_matches(token, '^(19|20)[0-9]{2}$') THEN 'year' WHEN contains(token, '%') THEN 'percent' WHEN contains(token, '$') THEN 'currency' WHEN regexp_matches(token, '[0-9]') THEN 'number' ELSE 'legend' END"


@query(f"""
    WITH {_SHEETS}, t AS (SELECT page, n, y0, line, unnest(regexp_extract_all(line, '{_TOKEN}')) AS token, generate_subscripts(regexp_extract_all(line, '{_TOKEN}'), 1) - 1 AS k FROM tx)
    SELECT page, n, k, {WIDE}::DOUBLE * (instr(line, token) - 1) + {WIDE / 2}::DOUBLE * length(token) AS cx, y0 + {HIGH / 2}::DOUBLE AS cy, {_CLASS} AS class FROM t WHERE length(regexp_replace(token, '[^A-Za-z0-9.,%$-]', '', 'g')) >= 0.6 * length(token)""")
def ocr_token_classes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with figures or signs of money: centre and class. The share of plain signs stands for the reader's confidence."""
    t = _lines(spark, sf_dir).select("page", "n", "y0", "line", F.posexplode(F.regexp_extract_all("line", F.lit(_TOKEN), F.lit(0))).alias("k", "token"))
    t = t.filter(F.length(F.regexp_replace("token", "[^A-Za-z0-9.,%$-]", "")) >= 0.6 * F.length("token"))
    kind = F.when(F.col("token").rlike("^(19|20)[0-9]{2}$"), "year").when(F.contains("token", F.lit("%")), "percent").when(F.contains("token", F.lit("$")), "currency").when(F.col("token").rlike("[0-9]"), "number").otherwise("legend")
    across = WIDE * (F.instr("line", F.col("token")) - 1) + WIDE / 2 * F.length("token")
    return t.select("page", "n", "k", across.alias("cx"), (F.col("y0") + HIGH / 2).alias("cy"), kind.alias("class"))


@query("""
    WITH o AS (SELECT o_custkey AS id, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders
               WHERE o_orderpriority = '1-URGENT' AND strftime(o_orderdate, '%Y') >= '1995')
    SELECT id, form, filed FROM o WHERE rn <= 10""")
def filings_zip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of a customer's orders, newest first, as rows by kind and year; ten at most."""
    o = load(spark, sf_dir, "orders")
    lists = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))), asc=False)
    own = o.groupBy(F.col("o_custkey").alias("id")).agg(lists.alias("l"))
    own = own.select("id", F.transform("l", lambda x: x["o_orderpriority"]).alias("forms"), F.transform("l", lambda x: x["filed"]).alias("dates"))
    rows = F.filter(F.arrays_zip(F.col("forms").alias("form"), F.col("dates").alias("filed")), lambda z: (z["form"] == "1-URGENT") & (F.substring(z["filed"], 1, 4) >= "1995"))
    return own.select("id", F.inline(F.slice(rows, 1, 10)))
