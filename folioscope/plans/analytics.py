"""Usage, feedback, audit, tiers, thresholds and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest, tags, usage
from ..sources.tables import QUESTIONS, load, values
from . import registry
from .registry import query
from .tagging import entities_of

#: The moment from which trailing windows look back.
NOW = "2024-01-25 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


@query("""
    SELECT CAST(count_if(event_type <> 'purchase') AS BIGINT) AS n_queries, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_uploads, count(DISTINCT user_id) AS n_sessions,
           round(avg(value), 3) AS mean_confidence, CAST(count_if(value < 10) AS BIGINT) AS n_low FROM events""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf_dir).agg(F.count_if(kind != "purchase").alias("n_queries"), F.count_if(kind == "purchase").alias("n_uploads"), F.countDistinct("user_id").alias("n_sessions"), F.round(F.avg("value"), 3).alias("mean_confidence"), F.count_if(F.col("value") < 10).alias("n_low"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(count(*) / 30, 4) AS per_day FROM events GROUP BY 1")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.count("*") / 30, 4).alias("per_day"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 1")
def peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count_if(event_type = 'purchase') AS BIGINT) AS up, CAST(count_if(event_type = 'error') AS BIGINT) AS down FROM events GROUP BY 1)
    SELECT *, CASE WHEN up + down = 0 THEN 0 ELSE round(100.0::DOUBLE * up / (up + down), 1) END AS satisfaction FROM d""")
def feedback_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))
    return d.withColumn("satisfaction", usage.share(F.col("up"), F.col("up") + F.col("down"), 1, 100.0))


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10")
def feedback_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type = 'error'").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).filter("event_type in ('error', 'signup') and ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20'")
    return own.select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_recent_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred audit events of all users."""
    own = _events(spark, sf_dir).filter("event_type in ('error', 'signup') and ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-20'")
    return own.select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT event_id, user_id FROM events WHERE contains(lower(event_type || ' ' || props), 'up {\"k\": 7') ")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase in the text of an event."""
    return _events(spark, sf_dir).filter(F.contains(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit('up {"k": 7'))).select("event_id", "user_id")


@query(f"""
    SELECT event_type, CAST(count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{NOW}') AS BIGINT) AS last_day,
           CAST(count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}') AS BIGINT) AS last_week,
           CAST(count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{NOW}') AS BIGINT) AS last_month FROM events GROUP BY event_type""")
def audit_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trailing(_events(spark, sf_dir), NOW)


@query(f"SELECT event_type, CAST(count_if(ts < TIMESTAMP '{NOW}' - to_days(CAST(days AS INTEGER))) AS BIGINT) AS expired, count(*) AS n FROM events JOIN (VALUES ('error', 20), ('view', 5), ('click', 10)) r(event_type, days) USING (event_type) GROUP BY event_type")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events past the days that their type is kept; the rules are a small literal table."""
    rules = spark.createDataFrame([("error", 20), ("view", 5), ("click", 10)], "event_type string, days int")
    old = F.col("ts") < F.to_timestamp_ntz(F.lit(NOW)) - F.make_dt_interval(F.col("days"))
    return _events(spark, sf_dir).join(F.broadcast(rules), "event_type").groupBy("event_type").agg(F.count_if(old).alias("expired"), F.count("*").alias("n"))


@query(f"SELECT user_id, max(ts) AS last_seen, max(ts) < TIMESTAMP '{NOW}' - INTERVAL 8 HOUR AS expired FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit(NOW))
    own = _events(spark, sf_dir).filter(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return own.withColumn("expired", F.col("last_seen") < now - F.expr("INTERVAL 8 HOURS"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(_events(spark, sf_dir), 2)


@query("""
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'click') ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, min(event_id) AS first, count(*) AS n FROM w WHERE event_type IN ('error', 'click') GROUP BY user_id, k HAVING count(*) >= 3""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three and more failures of a key."""
    return usage.islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "click"), 3)


@query("""
    SELECT CASE WHEN value < 20 THEN 'fast' WHEN value < 60 THEN 'cached' ELSE 'full' END AS tier, count(*) AS n, round(avg(value), 4) AS mean_latency,
           round(CAST(count_if(event_type = 'view') AS DOUBLE) / count(*), 4) AS hit_rate FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("value") < 20, "fast").when(F.col("value") < 60, "cached").otherwise("full")
    own = _events(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-20'").groupBy(tier.alias("tier"))
    return own.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_latency"), usage.share(F.count_if(F.col("event_type") == "view"), F.count("*"), 4).alias("hit_rate"))


@query("SELECT user_id, round_even(value / 20, 0) * 20 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded to twenties, halves to even."""
    return _events(spark, sf_dir).groupBy("user_id", (F.bround(F.col("value") / 20) * 20).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
    SELECT round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS mean_passed, round(avg(CASE WHEN quality = 0 THEN n_chars END), 4) AS mean_failed,
           round(greatest(100, least(2000, (avg(CASE WHEN quality = 1 THEN n_chars END) + avg(CASE WHEN quality = 0 THEN n_chars END)) / 2))::DOUBLE, 4) AS threshold
    FROM labels JOIN documents USING (doc_id)""")
def threshold_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midway between the means of passed and failed, within bounds."""
    own = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    good, bad = (F.avg(F.when(F.col("quality") == k, F.col("n_chars"))) for k in (1, 0))
    return own.agg(F.round(good, 4).alias("mean_passed"), F.round(bad, 4).alias("mean_failed"), F.round(F.greatest(F.lit(100.0), F.least(F.lit(2000.0), (good + bad) / 2)), 4).alias("threshold"))


@query("SELECT user_id, round(avg(value), 4) AS mean_last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50 GROUP BY user_id")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last fifty values of each user."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return _events(spark, sf_dir).withColumn("rn", rn).filter("rn <= 50").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("mean_last"), F.count("*").alias("n"))


@query("SELECT event_type, user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type, user_id ORDER BY n DESC, event_type, user_id LIMIT 10")
def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")).orderBy(F.desc("n"), "event_type", "user_id").limit(10)


@query("""
    WITH v AS (SELECT conv_id, turn, text, 1.0::DOUBLE + CASE WHEN contains(text, '?') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN contains(lower(text), 'calculate') OR contains(lower(text), 'formula') OR contains(lower(text), 'equation') THEN 0.4 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(text, '[0-9]+(?:\\.[0-9]+)?%') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(section|vm-|ldti|gaap)') THEN 0.2 ELSE 0 END::DOUBLE AS s FROM conversations)
    SELECT conv_id, count(*) AS n_messages, count(DISTINCT left(text, 20)) AS n_openings, round(avg(least(2.0::DOUBLE, CASE WHEN length(text) < 50 THEN s * 0.8::DOUBLE ELSE s END)), 2) AS importance FROM v GROUP BY conv_id""")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "conversations").select("conv_id", F.substring("text", 1, 20).alias("opening"), tags.importance(F.col("text")).alias("i"))
    return own.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.countDistinct("opening").alias("n_openings"), F.round(F.avg("i"), 2).alias("importance"))


_FOUND = registry.ORACLE["message_entities"].replace(values(QUESTIONS, "qid, query"), "(SELECT conv_id, text FROM conversations) AS t(qid, query)")


@query(f"""
    WITH v AS (SELECT conv_id, turn, text, 1.0::DOUBLE + CASE WHEN contains(text, '?') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN contains(lower(text), 'calculate') OR contains(lower(text), 'formula') OR contains(lower(text), 'equation') THEN 0.4 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(text, '[0-9]+(?:\\.[0-9]+)?%') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(section|vm-|ldti|gaap)') THEN 0.2 ELSE 0 END::DOUBLE AS s FROM conversations),
    e AS (SELECT qid AS conv_id, count(DISTINCT e) AS n_entities FROM (SELECT qid, unnest(string_split(entities, ',')) AS e FROM ({_FOUND})) WHERE e <> '' GROUP BY qid)
    SELECT conv_id, count(*) AS n_messages, coalesce(any_value(n_entities), 0) AS n_entities, round(avg(least(2.0::DOUBLE, CASE WHEN length(text) < 50 THEN s * 0.8::DOUBLE ELSE s END)), 2) AS importance
    FROM v LEFT JOIN e USING (conv_id) GROUP BY conv_id""")
def session_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, distinct entities of whole texts and mean importance of each conversation."""
    c = load(spark, sf_dir, "conversations")
    own = c.select("conv_id", tags.importance(F.col("text")).alias("i"))
    own = own.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.round(F.avg("i"), 2).alias("importance"))
    found = c.select("conv_id", F.explode(entities_of(F.col("text"))).alias("e")).groupBy("conv_id").agg(F.countDistinct("e").alias("n_entities"))
    return own.join(found, "conv_id", "left").select("conv_id", "n_messages", F.coalesce("n_entities", F.lit(0).cast("long")).alias("n_entities"), "importance")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    SELECT conv_id, string_agg(left(text, 300), chr(10) ORDER BY turn) AS context FROM r WHERE rn <= 5 GROUP BY conv_id""")
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", last=5)


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
    SELECT conv_id, string_agg(left(text, 300), chr(10) ORDER BY turn) AS context FROM r WHERE rn <= 10 GROUP BY conv_id""")
def recent_context_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages of each conversation."""
    return usage.recent(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, turn, role, length(text) AS n_chars FROM r WHERE n >= 6 AND rn <= floor(n * 0.3)""")
def compression_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest third of long conversations, to be summarised."""
    own = usage.oldest_share(load(spark, sf_dir, "conversations"), "conv_id", "turn", 6, 0.3)
    return own.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, count(*) AS n, CAST(count_if(role = 'user') AS BIGINT) AS n_user, array_to_string(list(role ORDER BY turn), '>') AS flow FROM conversations GROUP BY conv_id HAVING count(*) >= 3")
def role_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at least three rows as ordered lists."""
    flow = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), flow.alias("flow")).filter("n >= 3")


@query("SELECT c_mktsegment, r_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance, min(c_name) AS first_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name")
def group_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by department and level; the two small dimensions are joined first."""
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    own = load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.min("c_name").alias("first_name"))


@query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY o_orderstatus, o_orderpriority""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status histogram with totals over a join of two large tables."""
    l = load(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    own = load(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return own.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
    WITH e AS (SELECT *, CASE WHEN value < 20 THEN 'fast' WHEN value < 60 THEN 'cached' ELSE 'full' END AS tier, ts > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS recent FROM events),
    r AS (SELECT count(*) AS total, avg(value) AS mean, count_if(event_type = 'view') / count(*) AS hits FROM e WHERE recent)
    SELECT tier, count(*) AS n, count_if(recent) AS n_recent, total AS total_recent, round(mean, 4) AS mean_latency, round(hits::DOUBLE, 4) AS hit_rate FROM e, r GROUP BY tier, total, mean, hits""")
def tier_stats_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of the tiers in all, and of the last hour the requests, their mean latency and the share of hits."""
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("_last"))  # one row
    tier = F.when(F.col("value") < 20, "fast").when(F.col("value") < 60, "cached").otherwise("full")
    own = e.crossJoin(F.broadcast(last)).select(tier.alias("tier"), "value", "event_type", (F.col("ts") > F.col("_last") - F.expr("interval 1 hour")).alias("recent"))
    r = own.filter("recent").agg(F.count("*").alias("total_recent"), F.round(F.avg("value"), 4).alias("mean_latency"), usage.share(F.count_if(F.col("event_type") == "view"), F.count("*"), 4).alias("hit_rate"))
    return own.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("recent").alias("n_recent")).crossJoin(F.broadcast(r))


@query("SELECT o_orderkey, o_orderstatus, n FROM orders JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) USING (o_orderstatus) WHERE o_orderstatus IN ('O', 'P')")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are waiting or at work, each with the number of jobs in its state."""
    o = load(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus").join(F.broadcast(o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))), "o_orderstatus")  # a row a state


@query("""
    WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    k AS (SELECT *, CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END AS kept FROM o)
    SELECT event_type, kept, min(i) AS first, round(avg(value), 4) AS mean FROM k WHERE i > n - kept GROUP BY event_type, kept""")
def trimmed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a history that is cut to its last 500 entries whenever it holds more than 1,000."""
    e = _events(spark, sf_dir)
    sizes = e.groupBy("event_type").agg(F.count("*").alias("n"))
    kept = F.when(F.col("n") <= 1000, F.col("n")).otherwise(500 + (F.col("n") - 1001) % 501)
    own = ingest.numbered(e.select("event_type", "event_id", "value"), "event_type", "event_id", "i").join(F.broadcast(sizes.withColumn("kept", kept)), "event_type")  # a row a type
    return own.filter(F.col("i") > F.col("n") - F.col("kept")).groupBy("event_type", "kept").agg(F.min("i").alias("first"), F.round(F.avg("value"), 4).alias("mean"))


@query("""
    WITH r AS (SELECT user_id, value >= 50 AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    s AS (SELECT user_id, count(*) AS n, count_if(good AND rn <= 50) / count_if(rn <= 50) AS rate FROM r GROUP BY user_id)
    SELECT user_id, round(rate::DOUBLE, 6) AS rate, round(greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.7::DOUBLE + CASE WHEN n < 50 THEN 0 WHEN rate < 0.6 THEN -0.05 WHEN rate > 0.9 THEN 0.05 ELSE 0 END::DOUBLE)), 4) AS threshold FROM s""")
def threshold_by_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's similarity threshold: lower after many failures among the last fifty, higher after few, from 0.5 to 0.9."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    own = _events(spark, sf_dir).select("user_id", (F.col("value") >= 50).alias("good"), rn.alias("rn")).groupBy("user_id")
    s = own.agg(F.count("*").alias("n"), (F.count_if(F.col("good") & (F.col("rn") <= 50)) / F.count_if(F.col("rn") <= 50)).alias("r"))
    move = F.when(F.col("n") < 50, 0.0).when(F.col("r") < 0.6, -0.05).when(F.col("r") > 0.9, 0.05).otherwise(0.0)
    return s.select("user_id", F.round("r", 6).alias("rate"), F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.7 + move)), 4).alias("threshold"))


@query("""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
    p AS (SELECT conv_id, chr(10) || '## Recent Conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END, chr(10) ORDER BY turn) AS c FROM m WHERE rn <= 10 GROUP BY conv_id)
    SELECT conv_id, CASE WHEN length(c) > 800 THEN left(c, 700) || chr(10) || '... (context truncated)' ELSE c END AS context FROM p""")
def budgeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten messages of a conversation, 300 signs of each, within 200 tokens of four signs."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    m = load(spark, sf_dir, "conversations").withColumn("rn", rn).filter("rn <= 10")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("..."))).otherwise(F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])  # ten at most
    c = m.groupBy("conv_id").agg(F.concat(F.lit("\n## Recent Conversation:\n"), F.array_join(lines, "\n")).alias("c"))
    cut = F.concat(F.substring("c", 1, 700), F.lit("\n... (context truncated)"))
    return c.select("conv_id", F.when(F.length("c") > 800, cut).otherwise(F.col("c")).alias("context"))
