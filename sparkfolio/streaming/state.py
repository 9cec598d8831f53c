"""Ordered state machines, in batch and as streams.

Batch folds stream over sorted partitions: a key's rows are never collected, so
a key of any size costs constant memory. Streams hold a key's rows of one batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Visit rules and limiter rules.
TTL_SECONDS, RETAINED = 21_600, 2_000
OK_PER_PERMIT = 4


def micros(at: Column | str) -> Column:
    """Microseconds since 1970 of a time with or without a zone (the session's, then)."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def ordered_fold(rows: DataFrame, key: str, order: list[str], columns: list[str], init: Callable, step: Callable, kinds: str) -> DataFrame:
    """Rows of (key, columns…) with what ``step(state, row) -> (state, values)`` makes of
    each, in ``order`` within a key. ``kinds``: names and types of the values."""
    names = [x.split()[0] for x in kinds.split(",")]
    picked = rows.select(key, *dict.fromkeys([*order, *columns]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields) + ", " + kinds

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if state is None or row[key] != at:
                    at, state = row[key], init()
                state, values = step(state, row)
                out.append(values)
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    return picked.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def first_seen_ttl(visits: DataFrame, key: str, at: str, order: list[str], ttl: int = TTL_SECONDS) -> DataFrame:
    """Visits that are recorded: the first of a key, then the first at least ``ttl``
    seconds after the last recorded one. Dropped visits do not extend the wait."""
    seconds = visits.withColumn("_us", micros(at))

    def step(last, row):
        if last is None or row["_us"] - last >= ttl * 1_000_000:
            return row["_us"], (True,)
        return last, (False,)

    # the state of a fresh key is None, which ordered_fold reads as "begin": wrap it
    wrapped = lambda s, r: (lambda t, v: ((t,), v))(*step(s[0], r))
    return ordered_fold(seconds, key, ["_us", *order], [], lambda: (None,), wrapped, "recorded boolean").where("recorded")


def adaptive_limiter(events: DataFrame, key: str, order: list[str], throttled: str, permits: int) -> DataFrame:
    """Permitted concurrency after each event: halved by a throttle (at least one),
    one more after four clean answers in a row, up to ``permits``."""

    def step(state, row):
        allowed, ok, hits = state
        if row[throttled]:
            state = (max(1, allowed // 2), 0, hits + 1)
        elif ok + 1 >= OK_PER_PERMIT and allowed < permits:
            state = (allowed + 1, 0, hits)
        else:
            state = (allowed, ok + 1, hits)
        return state, state

    return ordered_fold(events, key, order, [throttled], lambda: (permits, 0, 0), step, "permitted bigint, consecutive_ok bigint, throttles bigint")


def rate_gate(events: DataFrame, key: str, at: str, order: list[str], interval: float) -> DataFrame:
    """When each request may start (microseconds): now, or one interval after the last start."""
    gap = F.lit(round(interval * 1_000_000)).cast("bigint")
    w = W.partitionBy(key).orderBy("_us", *order)
    placed = events.withColumn("_us", micros(at)).withColumn("_ahead", gap * (F.row_number().over(w) - 1))
    # the start is the latest of: an earlier request's time, and one interval for each request since
    start = F.col("_ahead") + F.max(F.col("_us") - F.col("_ahead")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.withColumn("start_us", start).withColumn("waited_us", F.col("start_us") - F.col("_us")).drop("_ahead")


def newest(rows: DataFrame, keep: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The newest ``keep`` rows, of each key if ``by`` is given (a report's limit)."""
    if not by:
        return rows.orderBy(*order).limit(keep)
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= keep).drop("_rn")


def daily_counts(visits: DataFrame, at: str) -> DataFrame:
    return visits.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("visits"))


def job_states(events: DataFrame, by: list[str], offset: str, kind: str, failed: list[str], done: list[str]) -> DataFrame:
    """Latest event of each pass and its status; a failure outlives later events."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by(kind, offset).alias("last_event"),
        F.max(offset).alias("next_offset"),
        F.when(F.bool_or(F.col(kind).isin(*failed)), "failed").when(F.bool_or(F.col(kind).isin(*done)), "done").otherwise("running").alias("status"),
    )


def replay(events: DataFrame, by: list[str], order: list[str], after: Column) -> DataFrame:
    """Events at or after an offset clamped to [0, n], with the next offset."""
    w = W.partitionBy(*by)
    placed = events.withColumn("offset", F.row_number().over(w.orderBy(*order)) - 1).withColumn("next_offset", F.count(F.lit(1)).over(w))
    start = F.greatest(F.lit(0), F.least(after, F.col("next_offset")))
    return placed.where(F.col("offset") >= start)


def quota_skips(passes: DataFrame, by: list[str], order: list[str], quota: Column) -> DataFrame:
    """Marks passes after the first quota error of their batch as skipped."""
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    hit = F.coalesce(F.max(quota.cast("int")).over(before), F.lit(0))
    return passes.withColumn("skipped", hit == 1)


def liveness(jobs: DataFrame, now: Column, timeout: float) -> DataFrame:
    """Jobs (status, heartbeat): queued or running ones without a recent heartbeat are interrupted."""
    stale = F.col("status").isin("queued", "running") & (micros("heartbeat") < micros(now) - round(timeout * 1_000_000))
    return jobs.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``, or a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, timeout: int = 600, folder: str | None = None) -> DataFrame:
    """Runs an append stream over what is there now and returns its rows; with a ``folder`` of an
    earlier run it goes on where that one ended and returns the rows of both."""
    spark, folder = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def stream_daily_counts(events: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """Tumbling UTC days in event time; a day is told once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("visits")).select(F.to_date("w.start").alias("day"), "visits")


def stream_first_seen(visits: DataFrame, key: str, at: str, order: str, ttl: int = TTL_SECONDS, late: str = "1 day") -> DataFrame:
    """``first_seen_ttl`` on a stream: the last recorded time of a key is its state. It is
    dropped once the watermark, ``late`` behind, is ``ttl`` past it, as any later visit is recorded then."""
    picked = visits.withWatermark(at, late).select(key, at, micros(at).alias("_us"), order)
    schema = picked.drop(at).schema

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat([f.drop(columns=[at]) for f in frames]).sort_values(["_us", order])
        keep = []
        for us in frame["_us"]:
            keep.append(last is None or us - last >= ttl * 1_000_000)
            last = us if keep[-1] else last
        ends = last // 1000 + ttl * 1000
        state.update((last,))
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        yield frame[keep]

    return picked.groupBy(key).applyInPandasWithState(fold, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


class VisitStore(StatefulProcessor):
    """A key's last recorded visit (set if absent, with an expiry), its newest recorded
    visits (pushed and trimmed) and its counters by day, all kept in the state store:
    two values a key, as each call of the store is a round trip to the executor's JVM.

    Rows in: ``us``, ``id``. A row out for each batch that records visits. Of a batch, a key's times and ids are held, 16 bytes a row.
    """

    def __init__(self, ttl: int, keep: int):
        self.ttl, self.keep = ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us bigint")
        self.held = handle.getValueState("held", "total bigint, newest_us array<bigint>, newest_id array<bigint>, days array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        visits = np.concatenate([f[["us", "id"]].to_numpy("int64") for f in rows])
        visits = visits[np.lexsort((visits[:, 1], visits[:, 0]))]
        seen = self.seen.get()
        last = before = seen[0] if seen else None
        recorded, at = [], 0
        while at < len(visits):
            if last is not None:  # the first visit that is far enough from the last recorded one
                at += int(np.searchsorted(visits[at:, 0], last + self.ttl * 1_000_000))
                if at >= len(visits):
                    break
            last = int(visits[at, 0])
            recorded.append((last, int(visits[at, 1])))
            at += 1
        if not recorded:
            return
        self.seen.update((last,))
        if before is not None:  # its timer, which has not expired
            self.handle.deleteTimer(before // 1000 + self.ttl * 1000)
        self.handle.registerTimer(last // 1000 + self.ttl * 1000)
        total, newest_us, newest_id, days, counts = self.held.get() or (0, [], [], [], [])
        total += len(recorded)
        newest = sorted([*zip(newest_us, newest_id), *recorded], reverse=True)[: self.keep]
        daily = Counter(dict(zip(days, counts)))
        daily.update(us // 86_400_000_000 for us, _ in recorded)
        days = sorted(daily.items())
        self.held.update((total, [us for us, _ in newest], [i for _, i in newest], [d for d, _ in days], [n for _, n in days]))
        told = {"total": [total], "recorded": [[i for _, i in recorded]], "newest": [[i for _, i in newest]], "days": [[d for d, _ in days]], "counts": [[n for _, n in days]]}
        yield pd.DataFrame({"key": [key[0]], **told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        return


def stream_visit_store(visits: DataFrame, key: str, at: str, order: str, ttl: int = TTL_SECONDS, keep: int = RETAINED, late: str = "1 day") -> DataFrame:
    """Recorded visits of a stream (``first_seen_ttl``), with each key's newest ``keep`` and its counts by UTC day.

    Rows: the key, total (recorded so far), recorded (``order`` values of this batch), newest (of all so far),
    days (since 1970) and counts. A key's row of the greatest total is its present state: ``visit_store_now``. ``order`` must be
    integral; rows with a null time or order are left out. Batches are taken to follow each other in time: a visit before the last recorded one counts
    as seen. A key's last visit is forgotten once the watermark, ``late`` behind, is ``ttl`` past it. State lies in RocksDB,
    which the session must name as its provider; ``with_rocksdb`` does.
    """
    picked = visits.where(F.col(at).isNotNull() & F.col(order).isNotNull()).withWatermark(at, late)
    picked = picked.select(F.col(key).alias("key"), F.col(at).alias("at"), micros(at).alias("us"), F.col(order).cast("bigint").alias("id"))
    schema = f"key {picked.schema['key'].dataType.simpleString()}, total bigint, recorded array<bigint>, newest array<bigint>, days array<bigint>, counts array<bigint>"
    told = picked.groupBy("key").transformWithStateInPandas(VisitStore(ttl, keep), schema, "append", "EventTime")
    return told.withColumnRenamed("key", key)


def visit_store_now(told: DataFrame, key: str) -> DataFrame:
    """The present state of each key of ``stream_visit_store``."""
    return told.groupBy(key).agg(F.max_by(F.struct("total", "newest", "days", "counts"), "total").alias("s")).select(key, "s.*")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own settings, beside this one, whose streams keep state in RocksDB."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session
