"""The stored corpus as tables: scans, listings, payloads, lookups of sources, samples, caches and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..operators import ingest, search, usage
from ..sources.tables import load
from . import registry
from .analytics import NOW
from .corpus import _PRINTS, _prints
from .metadata import _CHECKED, _checked, _found, _of_documents
from .registry import query
from .retrieval import _BM25, _LISTS_ALL, TERMS, _lists_all


@query("SELECT doc_id, source, length(trim(text, ' ')) AS n_chars FROM documents WHERE length(trim(text, ' ')) > 10 AND source IS NOT NULL AND source <> ''")
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a source and more than ten signs of text."""
    own = load(spark, sf_dir, "documents").filter("length(trim(text)) > 10 and source is not null and source <> ''")
    return own.select("doc_id", "source", F.length(F.trim("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id, source, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview, length(text) AS n_chars FROM documents")
def collection_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first hundred signs of its text."""
    preview = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", "source", preview.alias("preview"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY source")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "documents").groupBy("source")
    return own.agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""
    SELECT l.doc_id AS ref, coalesce(d.doc_id, f.doc_id) AS doc_id, coalesce(d.source, f.source) AS source
    FROM (SELECT doc_id FROM labels UNION ALL VALUES (-1), (NULL)) l LEFT JOIN documents d ON d.doc_id = l.doc_id, (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents) f""")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that each reference means; the first document where none has that id."""
    refs = load(spark, sf_dir, "labels").select("doc_id").unionByName(spark.createDataFrame([(-1,), (None,)], "doc_id long"))
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    first = d.agg(F.min("doc_id").alias("first_id"), F.min_by("source", "doc_id").alias("first_source"))  # one row
    own = refs.withColumnRenamed("doc_id", "ref").join(d, F.col("ref") == F.col("doc_id"), "left").crossJoin(F.broadcast(first))
    return own.select("ref", F.coalesce("doc_id", "first_id").alias("doc_id"), F.coalesce("source", "first_source").alias("source"))


@query(f"""
    WITH {_CHECKED} SELECT doc_id, string_agg(name, '|' ORDER BY name, title) AS names, string_agg(title, '|' ORDER BY name, title) AS titles, string_agg(DISTINCT department, '|' ORDER BY department) AS departments,
        count(*) AS n_entities, bool_or(authority IS NOT NULL) AS has_authority FROM v GROUP BY doc_id""")
def payload_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload that is stored with a document: arrays over the people found in it, and their number."""
    return _payload(_checked(spark, sf_dir))


@query(_of_documents("payload_assembly"))
def payload_assembly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payload_assembly`` of the people that the documents themselves name."""
    return _payload(_found(spark, sf_dir))


def _payload(checked: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("name", F.coalesce("title", F.lit("~")).alias("o"), "title")))  # people of one document
    part = lambda f: F.array_join(F.transform(rows, lambda x: x[f]), "|")
    own = checked.groupBy("doc_id")
    return own.agg(part("name").alias("names"), part("title").alias("titles"), F.nullif(F.array_join(F.array_sort(F.collect_set("department")), "|"), F.lit("")).alias("departments"), F.count("*").alias("n_entities"), F.bool_or(F.col("authority").isNotNull()).alias("has_authority"))


@query("""
    SELECT doc_id, source, length(text) AS n_chars, sha256(text) AS hash FROM (SELECT doc_id, source, text FROM documents
        UNION ALL SELECT -c_custkey, 'customer', c_name || ': ' || c_mktsegment || ', nation ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def connector_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a connector (customers with their nation) as documents, beside those that are there."""
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))  # 25 nations
    text = F.concat("c_name", F.lit(": "), "c_mktsegment", F.lit(", nation "), "n_name")
    own = load(spark, sf_dir, "documents").select("doc_id", "source", "text").unionByName(c.select((-F.col("c_custkey")).alias("doc_id"), F.lit("customer").alias("source"), text.alias("text")))
    return own.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("hash"))


_ASSISTING = ("how can i assist you today", "feel free to share", "what can i help you with")


@query(_BM25 + f""",
    hits AS (SELECT r.doc_id, round(score / (SELECT max(score) FROM r), 4) AS confidence, source, text FROM (SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 100) r JOIN documents USING (doc_id)),
    f AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, doc_id) AS id, regexp_extract(text, 'Source: Page ([0-9]+)', 1) AS page FROM hits
          WHERE confidence >= 0.1 AND source IS NOT NULL AND source NOT IN ('', 'None') AND NOT {sql.any_of('lower(text)', _ASSISTING)})
    SELECT doc_id, id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS excerpt, source || CASE WHEN page NOT IN ('', '0') THEN ', Page ' || page ELSE '' END AS label, confidence FROM f""")
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered citations of the best hits: those with a name, no talk of an assistant, and a tenth of the best score."""
    d = load(spark, sf_dir, "documents")
    best = search.top(search.bm25(d, TERMS), 100, "doc_id").select("doc_id", "score")
    every = Window.partitionBy(F.lit(0))  # a hundred rows at most
    t = d.join(F.broadcast(best), "doc_id").withColumn("confidence", F.round(F.col("score") / F.max("score").over(every), 4))
    f = t.filter((F.col("confidence") >= 0.1) & F.col("source").isNotNull() & ~F.col("source").isin("", "None") & ~tx.any_of(F.lower("text"), list(_ASSISTING)))
    page = F.regexp_extract("text", "Source: Page ([0-9]+)", 1)
    excerpt = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    label = F.concat("source", F.when(page.isin("", "0"), "").otherwise(F.concat(F.lit(", Page "), page)))
    return f.select("doc_id", F.row_number().over(every.orderBy(F.desc("confidence"), "doc_id")).cast("long").alias("id"), excerpt.alias("excerpt"), label.alias("label"), "confidence")


@query(_LISTS_ALL + " SELECT query_id, doc_id, score, 'vector' AS search_type FROM v UNION ALL SELECT query_id, doc_id, score, 'keyword' FROM k")
def union_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hit lists one after the other, repeats included."""
    v, k = _lists_all(spark, sf_dir)
    return v.withColumn("search_type", F.lit("vector")).unionByName(k.withColumn("search_type", F.lit("keyword")))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *, len(l) AS n, len(l) * 15 // 100 AS head, len(l) - len(l) // 10 AS tail FROM l),
    m AS (SELECT doc_id, n, [x FOR x, i IN l IF i > head AND i <= tail] AS mid FROM n),
    s AS (SELECT doc_id, n, list_sort([md5('7|' || doc_id || '|' || i || '|' || x) || lpad(CAST(i AS VARCHAR), 9, '0') FOR x, i IN mid])[1:CAST(n * 15 // 100 AS BIGINT)] AS pick FROM m)
    SELECT doc_id, n AS n_lines, len(pick) AS n_sampled, md5(array_to_string(pick, '')) AS digest FROM s""")
def line_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen hundredths of each document's lines, drawn from its middle by a seeded hash, the same each time."""
    own = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    n = F.size("l")
    mid = F.filter("l", lambda x, i: (i >= F.floor(n * 15 / 100)) & (i < n - F.floor(n / 10)))
    keyed = F.transform("mid", lambda x, i: F.concat(F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"), (i + 1).cast("string"), x)), F.lpad((i + 1).cast("string"), 9, "0")))
    pick = F.slice(F.array_sort(keyed), F.lit(1), F.floor(F.col("n") * 15 / 100).cast("int"))
    own = own.select("doc_id", n.alias("n"), mid.alias("mid")).select("doc_id", F.col("n").cast("long").alias("n_lines"), pick.alias("pick"))
    return own.select("doc_id", "n_lines", F.size("pick").cast("long").alias("n_sampled"), F.md5(F.array_join("pick", "")).alias("digest"))


@query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 20) / 180.0) AS BIGINT) END)) AS chunk FROM t WHERE len(w) > 0),
    s AS (SELECT doc_id, chunk, CASE WHEN chunk = 0 THEN 0 ELSE length(array_to_string(w[1 : chunk * 180], ' ')) + 1 END AS start FROM c)
    SELECT doc_id, chunk, start, greatest(1, start // 2000 + 1) AS page FROM s""")
def page_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which each chunk begins, at 2000 signs a page."""
    w = tx.words(F.col("text"))
    own = load(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", w.alias("w"))
    last = F.when(F.size("w") <= 200, 0).otherwise(F.ceil((F.size("w") - 20) / 180) - 1)
    at = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: F.struct(k.alias("chunk"), F.when(k == 0, 0).otherwise(F.length(F.array_join(F.slice("w", F.lit(1), (k * 180).cast("int")), " ")) + 1).cast("long").alias("start")))
    each = own.select("doc_id", F.inline(at))
    return each.select("doc_id", "chunk", "start", F.greatest(F.lit(1).cast("long"), F.floor(F.col("start") / 2000) + 1).alias("page"))


@query(f"""
    WITH p AS ({_PRINTS}), j AS (SELECT a.doc_id AS a, b.doc_id AS b, a.structure_hash = b.structure_hash AS s, a.metadata_hash = b.metadata_hash AS m,
        list_sum([(substr(a.content_hash, i::INT, 1) = substr(b.content_hash, i::INT, 1))::INT FOR i IN range(1, 17)]) / 16 AS c FROM p a JOIN p b ON b.doc_id = a.doc_id + 1)
    SELECT a, b, round(CASE WHEN s THEN 0.3 ELSE 0 END::DOUBLE + c * 0.6::DOUBLE + CASE WHEN m THEN 0.1 ELSE 0 END::DOUBLE, 6) AS similarity,
           round(CASE WHEN s THEN 0.3 ELSE 0 END::DOUBLE + c * 0.6::DOUBLE + CASE WHEN m THEN 0.1 ELSE 0 END::DOUBLE, 6) >= 0.95 AS similar FROM j""")
def fingerprint_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the fingerprints of a document and of the next one are."""
    p = _prints(load(spark, sf_dir, "documents"))
    a, b = p.select(*[F.col(c).alias("a_" + c) for c in p.columns]), p.select(*[F.col(c).alias("b_" + c) for c in p.columns])
    j = a.join(b, F.col("b_doc_id") == F.col("a_doc_id") + 1)
    same = F.zip_with(F.split("a_content_hash", ""), F.split("b_content_hash", ""), lambda x, y: (x == y).cast("int"))
    share = F.aggregate(F.slice(same, 1, 16), F.lit(0), lambda s, x: s + x) / 16
    total = F.when(F.col("a_structure_hash") == F.col("b_structure_hash"), 0.3).otherwise(0.0) + share * 0.6 + F.when(F.col("a_metadata_hash") == F.col("b_metadata_hash"), 0.1).otherwise(0.0)
    return j.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), F.round(total, 6).alias("similarity"), (F.round(total, 6) >= 0.95).alias("similar"))


@query("""
    WITH k AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
    SELECT hash, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(*) AS n FROM k GROUP BY hash""")
def dedup_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of texts rebuilt after jobs were removed (here those of toxic documents)."""
    gone = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    left = ingest.without(load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), gone, "doc_id", "doc_id")
    return left.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))


@query("""
    SELECT count(*) AS total, round(count_if(event_type = 'view') / count(*), 6) AS cache_hit_rate, round(count_if(event_type = 'click') / count(*), 6) AS pattern_rate, round(count_if(event_type = 'signup') / count(*), 6) AS light_rate,
           round(count_if(event_type = 'purchase') / count(*), 6) AS full_rate, round(count_if(event_type = 'error') / count(*), 6) AS failure_rate FROM events""")
def routing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of requests by the route that served them, and of failures; types of events stand for routes."""
    kinds = {"cache_hit_rate": "view", "pattern_rate": "click", "light_rate": "signup", "full_rate": "purchase", "failure_rate": "error"}
    return load(spark, sf_dir, "events").agg(F.count("*").alias("total"), *[usage.share(F.count_if(F.col("event_type") == v), F.count("*"), 6).alias(k) for k, v in kinds.items()])


@query(f"""
    WITH u AS (SELECT user_id, event_type, max(ts) AS last_used, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id, event_type)
    SELECT * FROM u WHERE last_used >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR ORDER BY last_used DESC, user_id, event_type LIMIT 100""")
def cache_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 24 hours and a hundred entries holds at a moment: the entries used last."""
    now = F.to_timestamp_ntz(F.lit(NOW))
    own = load(spark, sf_dir, "events").filter(F.col("ts") <= now).groupBy("user_id", "event_type").agg(F.max("ts").alias("last_used"), F.count("*").alias("n"))
    return own.filter(F.col("last_used") >= now - F.expr("INTERVAL 24 HOURS")).orderBy(F.desc("last_used"), "user_id", "event_type").limit(100)


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, count(*) AS n_compressed, max(event_id) AS last_compressed, any_value(n) - count(*) AS n_kept FROM r WHERE n >= 15 AND rn <= CAST(floor(n * 0.3) AS BIGINT) GROUP BY user_id""")
def compression_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From fifteen messages on the oldest three tenths are summed up; users' events stand for messages."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id")
    own = usage.oldest_share(e, "user_id", "event_id", 15, 0.3).groupBy("user_id").agg(F.count("*").alias("n_compressed"), F.max("event_id").alias("last_compressed"))
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return own.join(n, "user_id").select("user_id", "n_compressed", "last_compressed", (F.col("n") - F.col("n_compressed")).alias("n_kept"))


@query("""
    SELECT user_id, count(*) AS n_events, count_if(event_type = 'error') AS n_high, count_if(event_type IN ('purchase', 'signup')) AS n_medium, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id""")
def audit_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by risk, and when they began and ended."""
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(kind == "error").alias("n_high"), F.count_if(kind.isin("purchase", "signup")).alias("n_medium"), F.min("ts").alias("first"), F.max("ts").alias("last"))


_SCORE = registry.ORACLE["importance_score"]


@query(f"""
    WITH i AS ({_SCORE}), m AS (SELECT c.*, importance, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations c JOIN i USING (conv_id, turn)),
    o AS (SELECT *, lower(text) AS low FROM m WHERE n >= 4 AND rn <= CAST(floor(n * 0.5) AS BIGINT)),
    f AS (SELECT conv_id, rn, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS fact, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS nth FROM o WHERE importance > 1.2 AND (contains(text, '?') OR importance > 1.5)),
    g AS (SELECT conv_id, string_agg(fact, '|' ORDER BY nth) AS facts FROM f WHERE nth <= 5 GROUP BY conv_id)
    SELECT conv_id, count(*) AS n_messages, bool_or(importance > 1.2 AND contains(low, 'reserve')) AS reserves, bool_or(importance > 1.2 AND contains(low, 'premium')) AS premiums, bool_or(importance > 1.2 AND contains(low, 'ul')) AS universal_life,
           bool_or(importance > 1.2 AND contains(low, 'calculation')) AS calculations, any_value(facts) AS facts FROM o LEFT JOIN g USING (conv_id) GROUP BY conv_id""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of each longer conversation in short: topics of messages that matter, and up to five facts."""
    i = registry.QUERIES["importance_score"](spark, sf_dir)
    o = usage.oldest_share(load(spark, sf_dir, "conversations"), "conv_id", "turn", 4, 0.5).join(i, ["conv_id", "turn"])
    matters, low = F.col("importance") > 1.2, F.lower("text")
    topics = {"reserves": "reserve", "premiums": "premium", "universal_life": "ul", "calculations": "calculation"}
    fact = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    f = o.filter(matters & (F.contains("text", F.lit("?")) | (F.col("importance") > 1.5))).select("conv_id", "turn", fact.alias("fact")).withColumn("nth", nth).filter("nth <= 5")
    f = f.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fact"))), lambda x: x["fact"]), "|").alias("facts"))  # five at most
    own = o.groupBy("conv_id").agg(F.count("*").alias("n_messages"), *[F.bool_or(matters & F.contains(low, F.lit(w))).alias(n) for n, w in topics.items()])
    return own.join(f, "conv_id", "left")
