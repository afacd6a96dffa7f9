"""Ingest, fingerprints, duplicates, versions, chunks and clean-up over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..operators import ingest, profile, sampling, search
from ..sources.tables import literal, load, values
from . import registry
from .registry import query

_NORM = "trim(lower(text))"
for _p, _to in tx.NORMALISING:
    _NORM = f"regexp_replace({_NORM}, '{_p}', '{_to}', 'g')"
_L = "trim(x)"
_STRUCT = f"""array_to_string([CASE WHEN upper({_L}) = {_L} AND lower({_L}) <> {_L} AND length({_L}) > 5 THEN 'HEADER'
    WHEN regexp_matches({_L}, '^[0-9]+\\.?[ \\t]') THEN 'NUMBERED_ITEM' WHEN regexp_matches({_L}, '^[•*-][ \\t]') THEN 'BULLET_ITEM'
    WHEN length({_L}) < 50 AND contains({_L}, ':') THEN 'LABEL' ELSE '' END FOR x IN string_split(text, chr(10))], '')"""
_META = "left(md5(coalesce(source, '') || '|' || coalesce(lang, '')), 8)"
_PRINTS = f"SELECT doc_id, left(sha256({_NORM}), 16) AS content_hash, left(md5({_STRUCT}), 12) AS structure_hash, {_META} AS metadata_hash FROM documents"


def _prints(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.structure_hash(F.col("text")).alias("structure_hash"), ingest.metadata_hash("source", "lang").alias("metadata_hash"))


@query(f"WITH p AS ({_PRINTS}) SELECT *, left(sha256(content_hash || structure_hash || metadata_hash), 32) AS fingerprint FROM p")
def composite_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of content, structure and metadata, and of all three."""
    p = _prints(load(spark, sf_dir, "documents"))
    return p.withColumn("fingerprint", F.substring(F.sha2(F.concat("content_hash", "structure_hash", "metadata_hash"), 256), 1, 32))


@query(f"""
    WITH p AS ({_PRINTS}), v AS (SELECT p.*, source, lag(p.doc_id) OVER w AS before, lag(content_hash) OVER w AS c, lag(structure_hash) OVER w AS s, lag(metadata_hash) OVER w AS m
        FROM p JOIN documents d ON d.doc_id = p.doc_id WINDOW w AS (PARTITION BY source ORDER BY p.doc_id))
    SELECT doc_id, before, CASE WHEN structure_hash <> s THEN 'major' WHEN content_hash <> c THEN 'moderate' WHEN metadata_hash <> m THEN 'minor' ELSE 'none' END AS severity
    FROM v WHERE before IS NOT NULL""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a document changed against the one before it of the same source."""
    d = load(spark, sf_dir, "documents")
    own = d.select("doc_id", "source", tx.content_hash(F.col("text")).alias("content_hash"), tx.structure_hash(F.col("text")).alias("structure_hash"), ingest.metadata_hash("source", "lang").alias("metadata_hash"))
    hashes = ["content_hash", "structure_hash", "metadata_hash"]
    v = ingest.lagged(own, "source", "doc_id", ["doc_id", *hashes], "old").select("*", F.col("old.doc_id").alias("before"), *[F.col(f"old.{c}").alias(f"old_{c}") for c in hashes])
    severity = F.when(F.col("structure_hash") != F.col("old_structure_hash"), "major").when(F.col("content_hash") != F.col("old_content_hash"), "moderate").when(F.col("metadata_hash") != F.col("old_metadata_hash"), "minor").otherwise("none")
    return v.filter("before is not null").select("doc_id", "before", severity.alias("severity"))


@query("""
    WITH h AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1)
    SELECT count(*) AS n_unique, CAST(count_if(n > 1) AS BIGINT) AS n_repeated, CAST(sum(n) AS BIGINT) AS n_uploads, CAST(sum(n - 1) AS BIGINT) AS saved, max(n) AS largest FROM h""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return h.agg(F.count("*").alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("n").alias("n_uploads"), F.sum(F.col("n") - 1).alias("saved"), F.max("n").alias("largest"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS uploads FROM documents GROUP BY 1")
def dedup_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct text: first and last document, number of uploads."""
    return ingest.registry(load(spark, sf_dir, "documents"))


@query("""
    WITH r AS (SELECT sha256(text) AS hash, min(doc_id) AS first_doc FROM documents GROUP BY 1)
    SELECT d.doc_id, coalesce(r.first_doc, d.doc_id) AS job, coalesce(d.doc_id > r.first_doc, false) AS duplicate FROM documents d LEFT JOIN r ON r.hash = sha256(d.text)""")
def duplicate_uploads_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload against all earlier ones, which are those with a smaller id."""
    d = load(spark, sf_dir, "documents")
    job = ingest.match_registry(d, ingest.registry(d))
    return job.select("doc_id", "job", (F.col("doc_id") > F.col("job")).alias("duplicate"))


@query(registry.ORACLE["duplicate_uploads_all"])
def duplicate_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``duplicate_uploads_all``, under the name it was first asked for by."""
    return duplicate_uploads_all(spark, sf_dir)


@query("SELECT source, any_value(prefix) AS prefix, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT source, left(text, 100) AS prefix, doc_id FROM documents) GROUP BY source, prefix")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of the documents of a source that begin alike."""
    return load(spark, sf_dir, "documents").groupBy("source", F.substring("text", 1, 100).alias("prefix")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def best_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record with the highest value of each user: partial aggregation instead of a sort of all rows."""
    top = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(top.alias("t")).select("user_id", "t.event_id", "t.value")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n FROM documents d WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY source")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, by source, once rows of doomed keys and orphans are gone."""
    doomed = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return ingest.without(load(spark, sf_dir, "documents").select("doc_id", "source"), doomed, "doc_id", "source").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id", "source", "lang").orderBy("doc_id").limit(1)


@query("SELECT doc_id, coalesce(nullif(trim(text), ''), nullif(source, 'Unknown'), '{}') AS content, CASE WHEN lang <> 'en' THEN lang ELSE coalesce(source, 'none') END AS filename FROM documents")
def text_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field that holds something."""
    name = F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), "source", F.lit("none"))
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif("source", F.lit("Unknown")), F.lit("{}")).alias("content"), name.alias("filename"))


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY user_id")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON payload, filtered and added up."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select("user_id", k.alias("k")).filter("k >= 50").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'plain' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New metadata over old, the last wins."""
    own = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    new = F.map_from_arrays(F.array(F.lit("status")), F.array(F.when(F.col("toxic") == 1, "flagged").otherwise("plain")))
    both = F.map_concat(F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("status"), F.lit("new")), lambda k, v: ~F.map_contains_key(new, k)), new)
    return own.withColumn("m", both).select("doc_id", F.col("m")["lang"].alias("lang"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("m")["status"].alias("status"))


_CHUNKS = """
    c AS (SELECT doc_id, unnest(range(0, CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 50) / 150.0) AS BIGINT) END)) AS chunk, w
          FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) WHERE len(w) > 0),
    k AS (SELECT doc_id, chunk, array_to_string(w[chunk * 150 + 1 : chunk * 150 + 200], ' ') AS content FROM c)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk, length(content) AS n_chars, md5(content) AS digest FROM k")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 words, 50 shared with the one before."""
    k = ingest.chunks(load(spark, sf_dir, "documents"), 200, 50)
    return k.select("doc_id", "chunk", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query(f"""
    WITH {_CHUNKS}, n AS (SELECT a.doc_id, a.chunk, b.chunk AS other, CASE WHEN a.chunk = b.chunk THEN '>>> ' || b.content ELSE b.content END AS part
        FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.chunk BETWEEN a.chunk - 2 AND a.chunk + 2)
    SELECT doc_id, chunk, md5(string_agg(part, chr(10) || '---' || chr(10) ORDER BY other)) AS digest FROM n GROUP BY doc_id, chunk""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk between its two neighbours on either side."""
    k = ingest.chunks(load(spark, sf_dir, "documents"), 200, 50)
    return search.neighbours(k, "doc_id", "chunk", "content").select("doc_id", "chunk", F.md5("context").alias("digest"))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk, CAST(greatest(1, (chunk * 1000) // 2000 + 1) AS BIGINT) AS page, lang, source FROM k JOIN documents USING (doc_id)")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with an estimated page and their document's metadata."""
    k = ingest.chunks(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), 200, 50, keep=["lang", "source"])
    return k.select("doc_id", "chunk", F.greatest(F.lit(1), F.floor(F.col("chunk") * 1000 / 2000) + 1).cast("long").alias("page"), "lang", "source")


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    p AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l)
    SELECT doc_id, count(*) AS n_kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM p
    WHERE pos < n * 15 // 100 + 1 OR pos >= n - n // 10 OR contains(lower(line), 'license') OR regexp_matches(line, '[0-9]{4}') GROUP BY doc_id""")
def line_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of the lines, the last, and those in between that hold a keyword or a long number."""
    return ingest.sampled_lines(load(spark, sf_dir, "documents"), "license|[0-9]{4}")


_HELD = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_WANTED = "list_distinct([" + ", ".join(f"'{w}'" for w in sampling.GENERAL) + "]" + "".join(f" || CASE WHEN {_HELD('low', ws)} THEN [{', '.join(repr(w) for w in ws)}] ELSE [] END" for ws in sampling.FRAMEWORKS.values()) + ")"


@query(f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    b AS (SELECT *, CAST(floor(len(l) * 0.15::DOUBLE) AS INT) AS b, CAST(floor(len(l) * 0.10::DOUBLE) AS INT) AS e, {_WANTED} AS wanted FROM a),
    c AS (SELECT *, l[b + 1:len(l) - e] AS mid FROM b),
    d AS (SELECT *, [CASE WHEN len([w FOR w IN wanted IF contains(lower(x), w)]) > 0 THEN 2 WHEN regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '{sampling.HEADING}') THEN 1 ELSE 0 END FOR x IN mid] AS kind FROM c),
    k AS (SELECT *, flatten([mid[greatest(i - 1, 1):i + 3] FOR i IN range(1, len(mid) + 1) IF kind[i] = 2]) || flatten([mid[greatest(i - 1, 1):i + 3] FOR i IN range(1, len(mid) + 1) IF kind[i] = 1]) AS near FROM d),
    f AS (SELECT *, {sql.first_seen('near')} AS key_lines FROM k),
    g AS (SELECT *, [s.x FOR s IN list_sort([{{'h': md5(length(t) || ':' || x), 'x': x}} FOR x IN list_distinct(mid) IF NOT list_contains(key_lines, x)])] AS drawn FROM f),
    h AS (SELECT *, array_to_string(['{sampling.MARKS[0]}'] || l[1:b] || [chr(10) || '{sampling.MARKS[1].strip()}'] || (CASE WHEN len(key_lines) < b THEN key_lines || drawn ELSE key_lines END)[1:b]
        || [chr(10) || '{sampling.MARKS[2].strip()}'] || CASE WHEN e = 0 THEN l ELSE l[len(l) - e + 1:] END, chr(10)) AS whole FROM g),
    p AS (SELECT *, string_split(whole, '{sampling.CUT}') AS parts FROM h),
    o AS (SELECT doc_id, CASE WHEN length(t) <= 2000 THEN t WHEN length(whole) > 2000 THEN array_to_string([CASE WHEN length(x) > 2000 // len(parts) THEN left(x, 2000 // len(parts)) || '{sampling.TRIMMED}' ELSE x END FOR x IN parts], '{sampling.CUT}') ELSE whole END AS sample FROM p)
    SELECT doc_id, length(sample)::BIGINT AS n_chars, md5(sample) AS digest FROM o""")
def budgeted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text within 2,000 signs: beginning, key lines of the middle with their context, a seeded fill, the end."""
    got = sampling.sampled(load(spark, sf_dir, "documents"), "doc_id", "text", 2000)
    return got.select("doc_id", F.length("sample").cast("long").alias("n_chars"), F.md5("sample").alias("digest"))


@query("""
    WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>[^<]*</script>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(t, '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM t""")
def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts and tags, squeezed."""
    t = F.regexp_replace(F.regexp_replace("html", "<script[^>]*>[^<]*</script>", " "), "<[^>]*>", " ")
    return load(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " ")).alias("body"))


@query("""
    WITH l AS (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS l FROM pages),
    p AS (SELECT page_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l),
    f AS (SELECT *, sum(CASE WHEN contains(line, '<body') THEN 1 WHEN contains(line, '</body>') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS inside FROM p)
    SELECT page_id, count(*) AS n_lines, md5(string_agg(trim(line), chr(10) ORDER BY pos)) AS digest FROM f
    WHERE inside > 0 AND NOT starts_with(trim(line), '<') AND trim(line) <> '' GROUP BY page_id""")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between an opening and a closing mark, without lines of markup."""
    return ingest.lines_inside(load(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit(">"), F.lit(">\n"))), "page_id", "html", "<body", "</body>")


@query("SELECT source, CAST(count_if(contains(lower(text), 'license')) AS BIGINT) AS n_license, CAST(count_if(contains(text, '@')) AS BIGINT) AS n_mail, bool_or(contains(lower(text), 'license')) AND bool_or(contains(text, '@')) AS both FROM documents GROUP BY source")
def term_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of a file hold each term, and whether it holds all."""
    a, b = F.contains(F.lower("text"), F.lit("license")), F.contains("text", F.lit("@"))
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(a).alias("n_license"), F.count_if(b).alias("n_mail"), (F.bool_or(a) & F.bool_or(b)).alias("both"))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM l)
    SELECT doc_id, no AS line_no, regexp_extract(line, '[0-9]{5,}') AS hit FROM p WHERE regexp_matches(line, '[0-9]{5,}')""")
def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of a pattern's hits."""
    p = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike("[0-9]{5,}"))
    return p.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), F.regexp_extract("line", "[0-9]{5,}", 0).alias("hit"))


@query("SELECT event_type, max(ts) AS last_ts, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY event_type")
def series_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


_FILINGS = [(1, "10-K,10-Q,8-K", "2022-02-01,2022-05-01,2023-01-05"), (2, "10-Q,10-K", "2021-08-01,2023-02-03")]


@query(f"""
    SELECT id, form, filed FROM (SELECT id, unnest(string_split(forms, ',')) AS form, unnest(string_split(dates, ',')) AS filed FROM {values(_FILINGS, 'id, forms, dates')})
    WHERE form = '10-K' AND left(filed, 4) >= '2022'""")
def filings_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists as rows, by form and year."""
    z = literal(spark, _FILINGS, "id int, forms string, dates string").select("id", F.inline(F.arrays_zip(F.split("forms", ",").alias("form"), F.split("dates", ",").alias("filed"))))
    return z.filter((F.col("form") == "10-K") & (F.substring("filed", 1, 4) >= "2022"))


@query("SELECT 'value' AS name, count(value) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT event_type) AS kinds FROM events")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table's summary says of a column."""
    return load(spark, sf_dir, "events").agg(F.lit("value").alias("name"), F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("event_type").alias("kinds")).select("name", "n", "mean", "least", "most", "kinds")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_WORDS = ("l_returnflag", "l_linestatus")


@query(" UNION ALL ".join(
    [f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS deviation, min({c}::DOUBLE) AS least, max({c}::DOUBLE) AS most, NULL::BIGINT AS n_unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM lineitem" for c in _NUMBERS]
    + [f"SELECT '{c}', sum(k)::BIGINT, NULL, NULL, NULL, NULL, count(*), arg_min({c}, (-k, {c})), max(k) FROM (SELECT {c}, count(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})" for c in _WORDS]))
def table_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a table described at once; quartiles come from sketches and are tested, not compared."""
    p = profile.profile(load(spark, sf_dir, "lineitem"))
    return p.select("name", "n", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "least", "most", "n_unique", "top", "freq")


_BOXES = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 4.0, 0.0, 12.0, 9.0), (1, 3, 30.0, 30.0, 40.0, 40.0), (2, 4, 0.0, 0.0, 5.0, 5.0), (2, 5, 1.0, 1.0, 4.0, 4.0)]
_POINTS = [(1, 1, 2.0, 2.0), (1, 2, 14.0, 5.0), (1, 3, 36.0, 44.0), (2, 4, 3.0, 3.0), (2, 5, 90.0, 90.0)]


@query(f"""
    SELECT point, box FROM (SELECT point, box, row_number() OVER (PARTITION BY point ORDER BY box) AS rn FROM {values(_POINTS, 'page, point, x, y')}
        JOIN {values(_BOXES, 'page, box, x0, y0, x1, y1').replace('AS t(', 'AS u(')} USING (page) WHERE x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5) WHERE rn = 1""")
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within boxes widened by five; the first box wins."""
    p, b = literal(spark, _POINTS, "page int, point int, x double, y double"), literal(spark, _BOXES, "page int, box int, x0 double, y0 double, x1 double, y1 double")
    near = (F.col("x").between(F.col("x0") - 5, F.col("x1") + 5)) & (F.col("y").between(F.col("y0") - 5, F.col("y1") + 5))
    return p.join(b, "page").filter(near).groupBy("point").agg(F.min("box").alias("box"))


@query(f"""
    WITH b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM {values(_BOXES, 'page, box, x0, y0, x1, y1')})
    SELECT box FROM b s WHERE NOT EXISTS (SELECT 1 FROM b l WHERE l.page = s.page AND l.box <> s.box AND (l.area > s.area OR (l.area = s.area AND l.box < s.box))
        AND greatest(0, least(l.x1, s.x1) - greatest(l.x0, s.x0)) * greatest(0, least(l.y1, s.y1) - greatest(l.y0, s.y0)) > 0.5 * s.area)""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no larger box of the page covers by more than half."""
    b = literal(spark, _BOXES, "page int, box int, x0 double, y0 double, x1 double, y1 double").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return ingest.uncovered(b).select("box")
