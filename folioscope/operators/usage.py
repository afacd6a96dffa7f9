"""Usage, feedback, audit and conversation analytics over event and message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int, times: float = 1.0) -> Column:
    """A rounded ratio, 0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(F.round(times * part / whole, digits))


def trailing(events: DataFrame, now: str, ts: str = "ts") -> DataFrame:
    """Events by type in the last 24 hours, 7 days and 30 days before ``now``."""
    at = F.to_timestamp_ntz(F.lit(now))
    since = lambda days: F.count_if((F.col(ts) >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= at))
    return events.groupBy("event_type").agg(since(1).alias("last_day"), since(7).alias("last_week"), since(30).alias("last_month"))


def islands(rows: DataFrame, key: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` failures in a row of each key: (key, first, n); what opens a circuit breaker."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_bad", failed).withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    return marked.filter("_bad").groupBy(key, "_run").agg(F.min(order[-1]).alias("first"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_run")


def sessions(events: DataFrame, gap_hours: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, start, n): events of a user no further apart than the gap."""
    own = F.session_window(ts, f"{gap_hours} hours")
    return events.groupBy(user, own.alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")


def recent(messages: DataFrame, key: str, turn: str, text: str, last: int = 10, cut: int = 300) -> DataFrame:
    """The last messages of each conversation, cut and joined in order; only those are gathered."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(turn)))
    own = messages.select(key, turn, F.substring(text, 1, cut).alias("t")).withColumn("_rn", rn).filter(F.col("_rn") <= last)
    parts = F.array_sort(F.collect_list(F.struct(turn, "t")))
    return own.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("context"))


def oldest_share(messages: DataFrame, key: str, turn: str, from_messages: int, share_of: float) -> DataFrame:
    """The oldest share of the messages of conversations that have at least ``from_messages``."""
    w = Window.partitionBy(key)
    own = messages.withColumns({"_n": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy(turn))})
    return own.filter((F.col("_n") >= from_messages) & (F.col("_rn") <= F.floor(F.col("_n") * share_of))).drop("_n", "_rn")
