"""Phrases and concepts of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phrases
from ..sources.tables import load
from .registry import query

CONCEPTS = ["the", "der", "les", "que", "license", "and", "un"]
_STOP = ", ".join(f"'{w}'" for w in phrases.STOP)
_TOKENS = f"t AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(text), '[a-z0-9]+') IF length(x) > 2 AND x NOT IN ({_STOP})] AS t FROM documents)"


@query(f"""
    WITH {_TOKENS}, g AS (SELECT doc_id, unnest([t[k] || ' ' || t[k + 1] FOR k IN range(1, len(t))]) AS phrase FROM t WHERE len(t) >= 2)
    SELECT phrase, count(*) AS freq, count(DISTINCT doc_id) AS n_docs, round(least(1, count(*) / ((SELECT count(*) FROM documents) * 0.1)), 6) AS confidence FROM g GROUP BY phrase HAVING count(*) >= 3""")
def ngram_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word phrases, with a confidence by their share of a tenth of the documents."""
    d = load(spark, sf_dir, "documents")
    n = d.agg(F.count("*").alias("n"))  # one row
    return phrases.ngrams(d, 2).crossJoin(F.broadcast(n)).select("phrase", "freq", "n_docs", F.round(F.least(F.lit(1.0), F.col("freq") / (F.col("n") * 0.1)), 6).alias("confidence"))


@query(f"""
    WITH {_TOKENS}, g AS (SELECT doc_id, unnest([t[k] || ' ' || t[k + 1] || ' ' || t[k + 2] FOR k IN range(1, len(t) - 1)]) AS phrase FROM t WHERE len(t) >= 3)
    SELECT phrase, count(*) AS freq FROM g GROUP BY phrase ORDER BY freq DESC, phrase LIMIT 5""")
def top_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.ngrams(load(spark, sf_dir, "documents"), 3).select("phrase", "freq").orderBy(F.desc("freq"), "phrase").limit(5)


_IN = ", ".join(f"'{c}'" for c in CONCEPTS)
APART = ("and", "the", "that", "der", "und", "die", "les", "une", "pour", "que", "los", "para")
_FLAGS = f"f AS (SELECT doc_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9]+') IF x IN ({_IN})]) AS found FROM documents)"


@query(f"""
    WITH {_FLAGS}, e AS (SELECT doc_id, unnest(found) AS c FROM f)
    SELECT x.c AS a, y.c AS b, count(*) AS n FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.c < y.c GROUP BY 1, 2""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.pair_counts(phrases.concept_flags(load(spark, sf_dir, "documents"), CONCEPTS))


@query(f"""
    WITH {_FLAGS}, c AS (SELECT unnest([{_IN}]) AS c), n AS (SELECT count(*) AS n FROM f),
    p AS (SELECT x.c AS a, y.c AS b FROM c x, c y WHERE x.c < y.c),
    k AS (SELECT a, b, (SELECT n FROM n)::DOUBLE AS n, CAST(count_if(list_contains(found, a)) AS DOUBLE) AS na, CAST(count_if(list_contains(found, b)) AS DOUBLE) AS nb,
                 CAST(count_if(list_contains(found, a) AND list_contains(found, b)) AS DOUBLE) AS nab FROM p, f GROUP BY a, b),
    s AS (SELECT *, n * pow(greatest(0, abs(nab * (n - na - nb + nab) - (na - nab) * (nb - nab)) - n / 2), 2) / (na * nb * (n - na) * (n - nb)) AS chi,
                 greatest(0, na * nb / n - nab) / greatest(1, na * nb / n) AS ratio FROM k WHERE na > 0 AND nb > 0 AND na < n AND nb < n)
    SELECT a, b, CAST(nab AS BIGINT) AS observed, round(na * nb / n, 4) AS expected, round(chi, 4) AS chi_square, round(CASE WHEN chi >= 3.84 THEN ratio ELSE ratio * 0.5::DOUBLE END, 4) AS exclusion FROM s""")
def mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.exclusion(phrases.concept_flags(load(spark, sf_dir, "documents"), CONCEPTS), CONCEPTS)


_LF = lambda x: f"lgamma(({x}) + 1)"
_CHANCE = lambda k: f"exp({_LF('na')} + {_LF('n - na')} + {_LF('nb')} + {_LF('n - nb')} - {_LF('n')} - {_LF(k)} - {_LF(f'na - {k}')} - {_LF(f'nb - {k}')} - {_LF(f'n - na - nb + {k}')})"


@query(f"""
    WITH w AS (SELECT doc_id, source, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z]{{3,}}') IF x IN ({', '.join(f"'{c}'" for c in APART)})]) AS f FROM documents WHERE source IS NOT NULL),
    t AS (SELECT source, count(*) AS n FROM w GROUP BY source), e AS (SELECT source, doc_id, unnest(f) AS c FROM w), o AS (SELECT source, c, count(*) AS k FROM e GROUP BY ALL),
    h AS (SELECT x.source, x.c AS a, y.c AS b, count(*) AS nab FROM e x JOIN e y ON x.source = y.source AND x.doc_id = y.doc_id AND x.c < y.c GROUP BY ALL),
    p AS (SELECT source, x.c AS a, y.c AS b, n, x.k AS na, y.k AS nb, coalesce(nab, 0) AS nab FROM o x JOIN o y USING (source) JOIN t USING (source) LEFT JOIN h ON h.source = t.source AND h.a = x.c AND h.b = y.c WHERE x.c < y.c),
    s AS (SELECT *, na * nb / n::DOUBLE AS expected, CASE WHEN n < 50 THEN 0 ELSE n::DOUBLE * pow(greatest(0, abs(nab * (n - na - nb + nab) - (na - nab) * (nb - nab))::DOUBLE - n / 2), 2) / (na::DOUBLE * nb * (n - na) * (n - nb)) END AS chi,
            CASE WHEN n < 50 THEN least(1, list_sum([{_CHANCE('k')} FOR k IN range(greatest(0, na + nb - n), least(na, nb) + 1) IF {_CHANCE('k')} <= {_CHANCE('nab')} * (1 + 1e-7)])) END AS p FROM p WHERE na + nb - nab >= 5 AND na < n AND nb < n),
    x AS (SELECT *, least(1, greatest(0, expected - nab) / greatest(1, expected) * CASE WHEN CASE WHEN n < 50 THEN p < 0.05 ELSE chi >= 3.84 END THEN 1 ELSE 0.5::DOUBLE END) AS exclusion FROM s)
    SELECT source, a, b, nab AS observed, round(expected, 4) AS expected, round(chi::DOUBLE, 4) AS chi_square, round(p::DOUBLE, 6) AS p, round(exclusion::DOUBLE, 4) AS exclusion FROM x WHERE exclusion > 0.1""")
def exclusion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four languages that keep apart within a source: Fisher's exact test below 50 documents, else chi-square."""
    d = load(spark, sf_dir, "documents").filter("source is not null")
    held = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), F.array(*map(F.lit, APART)))
    return phrases.exclusion_within(d.select("source", held.alias("f")), "source", "f")


@query("""
    WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM n)
    SELECT source, count(*) AS n_values, round(CASE WHEN count(*) > 1 THEN -sum(n / total * log2(n / total)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM t GROUP BY source""")
def concept_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.entropy(load(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


@query(f"""
    WITH {_FLAGS}, e AS (SELECT doc_id, lang, unnest(found) AS c FROM f JOIN documents USING (doc_id)), w AS (SELECT lang, c, CAST(count(*) AS DOUBLE) AS s FROM e GROUP BY ALL)
    SELECT lang, c AS concept, round(s / max(s) OVER (PARTITION BY lang), 6) AS weight FROM w""")
def category_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each concept by language, over the largest of the language."""
    from pyspark.sql import Window

    d = load(spark, sf_dir, "documents")
    own = F.explode(F.array_intersect(phrases.tokens(F.col("text")), F.array(*map(F.lit, CONCEPTS))))
    n = d.select("lang", own.alias("concept")).groupBy("lang", "concept").agg(F.count("*").alias("s"))
    return n.select("lang", "concept", F.round(F.col("s") / F.max("s").over(Window.partitionBy("lang")), 6).alias("weight"))


@query("SELECT lang, count(DISTINCT term) AS n_terms FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,15}')[1:50]) AS term FROM documents) GROUP BY lang")
def domain_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms among the first fifty of each document, by language."""
    own = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,15}"), F.lit(0)), 1, 50)
    return load(spark, sf_dir, "documents").select("lang", F.explode(own).alias("term")).distinct().groupBy("lang").agg(F.count("*").alias("n_terms"))
