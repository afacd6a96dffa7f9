"""Streams over the event files, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import streams
from .registry import ORACLE, query


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = streams.daily_counts(streams.read_events(spark, sf_dir, "events.parquet"))
    return streams.finished(own, shared_folder(spark), "complete").select(F.to_date("start").alias("day"), "event_type", "n")


@query(ORACLE["session_windows"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = streams.session_counts(streams.read_events(spark, sf_dir, "events.parquet"))
    return streams.finished(own, shared_folder(spark), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('error', 'click') ORDER BY ts, event_id) AS k,
                      max((ts, event_id)) OVER (PARTITION BY user_id) AS last FROM events)
    SELECT user_id, min(event_id) AS first, count(*) AS n FROM w WHERE event_type IN ('error', 'click') GROUP BY user_id, k HAVING count(*) >= 3 AND max((ts, event_id)) < max(last)""")
def stream_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended runs of failures, by state of one open run a user."""
    return streams.finished(streams.run_state(streams.read_events(spark, sf_dir, "events.parquet")), shared_folder(spark))


@query("""
    WITH e AS (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS start FROM events)
    SELECT start, event_type, count(*) AS n FROM e GROUP BY ALL""")
def stream_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day, told every hour."""
    own = streams.trailing_counts(streams.read_events(spark, sf_dir, "events.parquet"))
    return streams.finished(own, shared_folder(spark), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT event_type, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS k FROM events WHERE value >= 50")
def stream_learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns learned in micro-batches from events of value: type and key."""
    own = streams.read_events(spark, sf_dir, "events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return streams.finished(streams.learned(own, ["event_type", "k"], 50.0), shared_folder(spark))


@query("""
    WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, (i - 1) // 4 + 1 AS k, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r WHERE n >= 15 AND (i - 1) // 4 <= (n - 15) // 4 GROUP BY ALL""")
def stream_compressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of fifteen messages compressed whenever a user holds so many."""
    return streams.finished(streams.compressions(streams.read_events(spark, sf_dir, "events.parquet")), shared_folder(spark))


@query("""
    WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT *, ts AS put, false AS hit FROM o WHERE i = 1
          UNION ALL SELECT o.*, CASE WHEN o.ts - r.put <= INTERVAL 24 HOUR THEN r.put ELSE o.ts END, o.ts - r.put <= INTERVAL 24 HOUR FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.i = r.i + 1)
    SELECT event_id, hit FROM r""")
def stream_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request finds an answer put within a day, by state with a time to live."""
    return streams.finished(streams.cached_requests(streams.read_events(spark, sf_dir, "events.parquet"), ["user_id", "event_type"]), shared_folder(spark))


@query("""
    WITH RECURSIVE o AS (SELECT event_id, user_id, ts, event_type NOT IN ('error', 'click') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, user_id, i, CASE WHEN ok THEN 0 ELSE 1 END AS n, ts AS last, 'CLOSED' AS state, false AS blocked FROM o WHERE i = 1
          UNION ALL
          SELECT o.event_id, o.user_id, o.i,
                 CASE WHEN r.state = 'OPEN' AND o.ts - r.last <= INTERVAL 1 DAY THEN r.n WHEN NOT o.ok THEN r.n + 1 WHEN r.state = 'OPEN' THEN 0 ELSE r.n END,
                 CASE WHEN r.state = 'OPEN' AND o.ts - r.last <= INTERVAL 1 DAY THEN r.last WHEN NOT o.ok THEN o.ts ELSE r.last END,
                 CASE WHEN r.state = 'OPEN' AND o.ts - r.last <= INTERVAL 1 DAY THEN 'OPEN' WHEN NOT o.ok AND r.n + 1 >= 3 THEN 'OPEN' ELSE 'CLOSED' END,
                 r.state = 'OPEN' AND o.ts - r.last <= INTERVAL 1 DAY
          FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
    SELECT user_id, event_id, state, blocked FROM r""")
def stream_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circuit breaker a user: open after three failures, tried again after a day. It never rests half open after a call:
    that call closes it, or opens it again.
    """
    own = streams.breaker_states(streams.read_events(spark, sf_dir, "events.parquet"), ["error", "click"], 3, "1 day")
    return streams.finished(own, shared_folder(spark))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(CAST(ts AS DATE)) + 1 > (SELECT max(ts) - INTERVAL 1 DAY FROM events) AS open FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written once the watermark has passed them, to files by day, beside the days that are still open."""
    own = streams.daily_counts(streams.read_events(spark, sf_dir, "events.parquet")).withColumn("day", F.to_date("start"))
    closed, state = streams.closed_and_open(own, shared_folder(spark), "day")
    left = state.select(F.to_date("key.window.start").alias("day"), F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n"), F.lit(True).alias("open"))
    return closed.select("day", "event_type", "n", F.lit(False).alias("open")).unionByName(left)
