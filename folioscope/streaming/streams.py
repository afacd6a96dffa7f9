"""The same analytics over streams: windows with watermarks, sessions, and state of one's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream, with ``ts`` as a timestamp."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    own = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return own.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; days close once the watermark has passed them."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user, closed after the gap."""
    own = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", own.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_state(events: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, first, n) of runs of at least ``least`` failures, told when a run ends: state is one open run a user."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (-1, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event, bad in zip(rows["event_id"], rows["event_type"].isin(["error", "click"])):
            if bad:
                first, n = (int(event) if n == 0 else first), n + 1
            else:
                if n >= least:
                    out.append((key[0], first, n))
                first, n = -1, 0
        state.update((first, n))
        yield pd.DataFrame(out, columns=["user_id", "first", "n"])

    return events.groupBy("user_id").applyInPandasWithState(runs, "user_id long, first long, n long", "first long, n long", "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into Parquet files under ``folder`` (shared), and read them.

    In complete mode each batch replaces the table; in append mode the file sink keeps each row once, whatever is
    tried again.
    """
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        done = writer.outputMode("append").format("parquet").option("path", f"{at}/rows").start()
    else:
        done = writer.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/rows")).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def closed_and_open(stream: DataFrame, folder: str, part: str) -> tuple[DataFrame, DataFrame]:
    """Run a windowed count in append mode into files parted by ``part``; (rows of closed windows, state of open ones).

    A window is written once, when the watermark has passed it, and then leaves the state; files of a day are never
    written again. What is still open when the input ends is read from the state's own files: columns ``key`` and ``value``.
    """
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    writer.outputMode("append").partitionBy(part).format("parquet").option("path", f"{at}/rows").start().awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(f"{at}/rows")
    return closed, spark.read.format("statestore").load(f"{at}/checkpoint").select("key", "value")


def trailing_counts(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type in windows of ``width`` that begin every ``slide``."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("window.start").alias("start"), "event_type", "n")


def learned(events: DataFrame, keys: list[str], least: float, ttl: str | None = None) -> DataFrame:
    """Patterns (``keys``) of events worth at least ``least``, each told once, or again once ``ttl`` has passed.

    Without ``ttl`` the state holds every pattern there is. Run it with a trigger by processing time, some files a batch.
    """
    own = events.filter(F.col("value") >= least)
    own = own.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys) if ttl else own.dropDuplicates(keys)
    return own.select(*keys)


def compressions(events: DataFrame, most: int = 15, share: float = 0.3) -> DataFrame:
    """(user_id, k, first, last, n): when a user holds ``most`` messages, the oldest ``share`` of them are compressed.

    Messages are taken in the order of event_id within a batch of files. State: the ids held, fewer than ``most`` a user.
    """
    import pandas as pd

    n = int(most * share)

    def run(key, batches, state):
        held, k = state.get if state.exists else ([], 0)
        held, out = list(held), []
        for event in sorted(int(e) for batch in batches for e in batch["event_id"]):
            held.append(event)
            if len(held) >= most:
                k += 1
                out.append((key[0], k, held[0], held[n - 1], n))
                held = held[n:]
        state.update((held, k))
        yield pd.DataFrame(out, columns=["user_id", "k", "first", "last", "n"])

    own = events.select("user_id", "event_id").groupBy("user_id")
    return own.applyInPandasWithState(run, "user_id long, k long, first long, last long, n long", "held array<long>, k long", "append", "NoTimeout")


def cached_requests(events: DataFrame, keys: list[str], ttl_hours: float = 24, late: str = "1 day") -> DataFrame:
    """(event_id, hit) of requests for ``keys``: a hit if an entry was put within the time to live, else one is put.

    A hit doesn't renew its entry. Entries leave the state once the watermark has passed their end, so it holds the keys
    of about a day, not all there ever were. Requests of a batch are taken in order of time.
    """
    import pandas as pd

    ttl = int(ttl_hours * 3_600_000_000)

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool")})
            return
        put = state.get[0] if state.exists else None
        rows = sorted((int(t), int(e)) for batch in batches for t, e in zip(batch["at"], batch["event_id"]))
        out = []
        for at, event in rows:
            hit = put is not None and at - put <= ttl
            put = put if hit else at
            out.append((event, hit))
        state.update((put,))
        state.setTimeoutTimestamp(max((put + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "hit"])

    own = events.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("at"), "event_id", *keys).groupBy(*keys)
    return own.applyInPandasWithState(run, "event_id long, hit boolean", "put long", "append", "EventTimeTimeout")


def breaker_states(events: DataFrame, bad: list[str], threshold: int = 5, timeout: str = "60 seconds", late: str = "1 day") -> DataFrame:
    """(user_id, event_id, state, blocked): a circuit breaker a user, with its state after each call.

    CLOSED lets calls through and counts failures; at ``threshold`` it is OPEN and blocks. Once ``timeout`` has passed since the
    last failure a timer of event time makes it HALF_OPEN, or the first call after that does: a success then closes it and
    clears the count, a failure opens it again. Calls are taken in order of time within a batch, and calls later than the
    watermark are dropped. State is kept only for users with failures on their count.
    """
    import pandas as pd

    wait = int(pd.Timedelta(timeout).total_seconds() * 1_000_000)

    def run(key, batches, state):
        if state.hasTimedOut:  # the timer of an open breaker
            _, n, last = state.get
            state.update(("HALF_OPEN", n, last))
            yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "state": pd.Series(dtype="str"), "blocked": pd.Series(dtype="bool")})
            return
        now, n, last = state.get if state.exists else ("CLOSED", 0, 0)
        calls = sorted((int(t), int(e), bool(ok)) for batch in batches for t, e, ok in zip(batch["at"], batch["event_id"], batch["ok"]))
        out = []
        for at, event, ok in calls:
            if now == "OPEN" and at - last <= wait:
                out.append((key[0], event, now, True))
                continue
            now = "HALF_OPEN" if now == "OPEN" else now
            if ok:
                now, n = ("CLOSED", 0) if now == "HALF_OPEN" else (now, n)
            else:
                n, last = n + 1, at
                now = "OPEN" if n >= threshold else now
            out.append((key[0], event, now, False))
        if n or now != "CLOSED":
            state.update((now, n, last))
            if now == "OPEN":
                state.setTimeoutTimestamp(max((last + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state", "blocked"])

    own = events.withWatermark("ts", late).select("ts", F.unix_micros("ts").alias("at"), "event_id", (~F.col("event_type").isin(*bad)).alias("ok"), "user_id")
    schema = "user_id long, event_id long, state string, blocked boolean"
    return own.groupBy("user_id").applyInPandasWithState(run, schema, "state string, n long, last long", "append", "EventTimeTimeout")
