"""Long texts cut down to a budget: their beginning, key parts of the middle, their end; as array functions, row by row.

A text within the budget stays. Of others, the first 15 hundredths of the lines and the last 10 stay. Between them, lines that
hold a keyword (general ones, and those of every framework that the text names) bring the line before and three after;
lines that look like headings do so too, but come after. Each line once, as many as 15 hundredths of all; where these are
fewer, other lines fill up, drawn in an order that a hash of the document's length and of the line fixes. If all that is still
longer than the budget, each of the four parts is cut at a quarter of it.

Lines are neither exploded nor shuffled. A text with fewer than ten lines has no last tenth: all of it then stands as its end,
as in the rule that this follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords of frameworks, general keywords, and lines that look like headings.
FRAMEWORKS = {
    "usstat": ("usstat", "statutory", "naic", "reserve", "rbc"),
    "ifrs": ("ifrs", "international", "ias", "fair value"),
    "gaap": ("gaap", "generally accepted", "accounting principles"),
    "actuarial": ("mortality", "morbidity", "lapse", "policyholder", "benefit"),
    "valuation": ("valuation", "methodology", "assumption", "discount rate"),
    "regulatory": ("regulation", "compliance", "requirement", "standard"),
}
GENERAL = ("methodology", "calculation", "framework", "standard", "requirement", "principle")
HEADING = r"^(?:[A-Z][A-Z\s]{10,}$|[0-9]+\.|[IVXLC]+\.|Table [0-9]+|Section [0-9]+|Appendix)"
MARKS = ("=== DOCUMENT BEGINNING ===", "\n=== DOCUMENT MIDDLE (KEY SECTIONS) ===", "\n=== DOCUMENT ENDING ===")
CUT, TRIMMED = "=== DOCUMENT", "...[TRIMMED]"


def _names(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def sampled(docs: DataFrame, key: str, text: str, target: int = 120_000) -> DataFrame:
    """(key, sample) of every text. Steps are columns of their own, so that each is worked out once."""
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumns({"l": F.split("t", "\n"), "low": F.lower("t")})
    n = F.size("l")
    rows = rows.withColumns({"b": F.floor(n * 0.15).cast("int"), "e": F.floor(n * 0.10).cast("int"), "m": F.floor(n * 0.15).cast("int")})
    middle = F.slice("l", F.col("b") + 1, F.greatest(n - F.col("e") - F.col("b"), F.lit(0)))
    wanted = F.array_distinct(F.concat(F.array(*map(F.lit, GENERAL)), *[F.when(_names(F.col("low"), ws), F.array(*map(F.lit, ws))).otherwise(F.array().cast("array<string>")) for ws in FRAMEWORKS.values()]))
    rows = rows.withColumns({"mid": middle, "wanted": wanted})
    clean = F.transform("mid", lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = rows.withColumn("kind", F.transform(clean, lambda x: F.when(F.exists("wanted", lambda w: F.contains(F.lower(x), w)), 2).when(x.rlike(HEADING), 1).otherwise(0)))

    def around(kind: int) -> Column:
        first = lambda k: F.greatest(k - 1, F.lit(0))
        parts = F.transform("kind", lambda x, k: F.when(x == kind, F.slice("mid", first(k) + 1, k + 4 - first(k))).otherwise(F.array().cast("array<string>")))
        return F.flatten(parts)

    rows = rows.withColumn("key_lines", F.array_distinct(F.concat(around(2), around(1))))
    seed = F.concat(F.length("t").cast("string"), F.lit(":"))
    drawn = F.transform(F.array_sort(F.transform(F.array_except("mid", "key_lines"), lambda x: F.struct(F.md5(F.concat(seed, x)).alias("h"), x.alias("x")))), lambda s: s["x"])
    rows = rows.withColumn("chosen", F.slice(F.when(F.size("key_lines") < F.col("m"), F.concat("key_lines", drawn)).otherwise(F.col("key_lines")), F.lit(1), F.col("m")))
    ending = F.when(F.col("e") == 0, F.col("l")).otherwise(F.slice("l", n - F.col("e") + 1, F.greatest(F.col("e"), F.lit(1))))
    whole = F.array_join(F.concat(F.array(F.lit(MARKS[0])), F.slice("l", F.lit(1), F.col("b")), F.array(F.lit(MARKS[1])), F.col("chosen"), F.array(F.lit(MARKS[2])), ending), "\n")
    rows = rows.withColumn("whole", whole).withColumn("parts", F.split("whole", CUT))
    part = F.floor(F.lit(target) / F.size("parts")).cast("int")
    trimmed = F.array_join(F.transform("parts", lambda p: F.when(F.length(p) > part, F.concat(F.substr(p, F.lit(1), part), F.lit(TRIMMED))).otherwise(p)), CUT)
    return rows.select(key, F.when(F.length("t") <= target, F.col("t")).when(F.length("whole") > target, trimmed).otherwise(F.col("whole")).alias("sample"))
