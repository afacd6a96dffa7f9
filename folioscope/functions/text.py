"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Runs of anything but white space; none for an empty text."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def terms(c: Column) -> Column:
    """Distinct lower-cased runs of at least four ASCII word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{4,}"), F.lit(0)))


def sentences(c: Column, longer_than: int = 0) -> Column:
    """Trimmed parts between ends of sentences."""
    parts = F.transform(F.split(c, "[.!?]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > longer_than)


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs, as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def count_of(c: Column, parts: list[str]) -> Column:
    """How many of the parts occur, as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(p)).cast("long") for p in parts])


def labels_where(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in conditions.items()]))


def normalised(c: Column) -> Column:
    """Content as it is hashed: lower case, single spaces, no special signs, numbers as such."""
    out = F.trim(F.lower(c))
    for pattern, to in NORMALISING:
        out = F.regexp_replace(out, pattern, to)
    return out


#: Steps of ``normalised``; decimals lose their point before numbers are replaced.
NORMALISING = ((r"[ \t\n\r\f]+", " "), (r"[^a-z0-9_ -]", ""), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "DATE"), (r"[0-9]+\.[0-9]+", "NUMBER"))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(normalised(c), 256), 1, 16)


def structure(c: Column) -> Column:
    """The kinds of a text's lines in order, joined."""

    def kind(x: Column) -> Column:
        upper = (F.upper(x) == x) & (F.lower(x) != x)
        return (
            F.when(upper & (F.length(x) > 5), "HEADER")
            .when(x.rlike(r"^[0-9]+\.?[ \t]"), "NUMBERED_ITEM")
            .when(x.rlike(r"^[•*-][ \t]"), "BULLET_ITEM")
            .when((F.length(x) < 50) & F.contains(x, F.lit(":")), "LABEL")
            .otherwise("")
        )

    return F.array_join(F.transform(F.split(c, "\n"), lambda x: kind(F.trim(x))), "")


def structure_hash(c: Column) -> Column:
    return F.substring(F.md5(structure(c)), 1, 12)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of floats in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
