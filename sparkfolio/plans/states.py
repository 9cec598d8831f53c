"""Queries over events as visits, job logs and limiter feedback, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state as S
from .catalog import query, table

_FIRST_SEEN = """WITH RECURSIVE ordered AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
fold AS (SELECT user_id, event_id, k, us AS last, true AS recorded FROM ordered WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.us - f.last >= 21600000000 THEN o.us ELSE f.last END, o.us - f.last >= 21600000000 FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id FROM fold WHERE recorded"""


@query("visits_first_seen_ttl", _FIRST_SEEN)
def visits_first_seen_ttl(spark: SparkSession, folder: str) -> DataFrame:
    return S.first_seen_ttl(table(spark, folder, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_id")


@query("visits_daily_counts", "SELECT ts::DATE::VARCHAR AS day, count(*) AS visits FROM events GROUP BY 1")
def visits_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.daily_counts(table(spark, folder, "events"), "ts").withColumn("day", F.col("day").cast("string"))


@query("visits_latest_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def visits_latest_n(spark: SparkSession, folder: str) -> DataFrame:
    return S.newest(table(spark, folder, "events"), S.RETAINED, [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("job_events_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def job_events_latest(spark: SparkSession, folder: str) -> DataFrame:
    return S.newest(table(spark, folder, "events"), 20, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query("job_state_reduce", """SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS events, arg_max(event_type, event_id) AS last_event, max(event_id) AS next_offset,
CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'running' END AS status FROM events GROUP BY user_id, ts::DATE""")
def job_state_reduce(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts").cast("string"))
    return S.job_states(events, ["user_id", "day"], "event_id", "event_type", ["error"], ["purchase"])


_REPLAY = """SELECT user_id, event_id, "offset", next_offset FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS "offset", count(*) OVER (PARTITION BY user_id) AS next_offset FROM events)
WHERE "offset" >= greatest(0, least(user_id % 90 - 3, next_offset))"""


@query("event_replay_offset", _REPLAY)
def event_replay_offset(spark: SparkSession, folder: str) -> DataFrame:
    return S.replay(table(spark, folder, "events"), ["user_id"], ["event_id"], F.col("user_id") % 90 - 3).select("user_id", "event_id", "offset", "next_offset")


@query("quota_skip", "SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM events")
def quota_skip(spark: SparkSession, folder: str) -> DataFrame:
    return S.quota_skips(table(spark, folder, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_id", "skipped")


@query("step_durations", "SELECT user_id, event_type, event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1000000.0::DOUBLE, 6) AS seconds FROM events")
def step_durations(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    us = S.micros("ts")
    first = F.first(us).over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return table(spark, folder, "events").select("user_id", "event_type", "event_id", F.round((us - first) / 1_000_000.0, 6).alias("seconds"))


_JOBS = "jobs AS (SELECT user_id, max(ts) AS heartbeat, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'queued' ELSE 'running' END, event_id) AS status FROM events GROUP BY user_id)"


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "queued").otherwise("running")
    return table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by(status, "event_id").alias("status"))


@query("job_liveness", f"WITH {_JOBS}, clock AS (SELECT max(ts) AS t FROM events) SELECT user_id, CASE WHEN status IN ('queued', 'running') AND epoch_us(heartbeat) < epoch_us(t) - 43200000000 THEN 'interrupted' ELSE status END AS status FROM jobs, clock")
def job_liveness(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    clock = jobs.agg(F.max("heartbeat").alias("t"))  # one row
    return S.liveness(jobs.crossJoin(F.broadcast(clock)), F.col("t"), 43_200).select("user_id", "status")


@query("active_job_guard", f"WITH {_JOBS} SELECT count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status IN ('queued', 'running')) = 0 AS may_start FROM jobs")
def active_job_guard(spark: SparkSession, folder: str) -> DataFrame:
    return _jobs(spark, folder).agg(F.count_if(F.col("status").isin("queued", "running")).alias("active")).withColumn("may_start", F.col("active") == 0)


_ORDERED = "ordered AS (SELECT user_id, event_id, event_type = 'error' AS hit, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("adaptive_limiter_fold", f"""WITH RECURSIVE {_ORDERED}, steps AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 8::BIGINT AS permitted, 0::BIGINT AS ok, 0::BIGINT AS throttles FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN hit THEN greatest(1, permitted // 2) WHEN ok + 1 >= 4 AND permitted < 8 THEN permitted + 1 ELSE permitted END,
    CASE WHEN hit OR (ok + 1 >= 4 AND permitted < 8) THEN 0 ELSE ok + 1 END, throttles + hit::BIGINT FROM steps s JOIN ordered o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, event_id, permitted, ok AS consecutive_ok, throttles FROM steps WHERE k > 0""")
def adaptive_limiter_fold(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("hit", F.col("event_type") == "error").withColumn("us", S.micros("ts"))
    return S.adaptive_limiter(events, "user_id", ["us", "event_id"], "hit", 8).select("user_id", "event_id", "permitted", "consecutive_ok", "throttles")


@query("rate_gate_fold", f"""WITH RECURSIVE {_ORDERED}, steps AS (SELECT user_id, k, event_id, us, us AS start FROM ordered WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.event_id, o.us, greatest(o.us, s.start + 43200000000) FROM steps s JOIN ordered o ON o.user_id = s.user_id AND o.k = s.k + 1)
SELECT user_id, event_id, start - us AS waited_us FROM steps""")
def rate_gate_fold(spark: SparkSession, folder: str) -> DataFrame:
    return S.rate_gate(table(spark, folder, "events"), "user_id", "ts", ["event_id"], 43_200).select("user_id", "event_id", "waited_us")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return S.stream_of(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# The watermark tells a day once an event at least a day later than its end has come.
@query("stream_tumbling_daily", "SELECT ts::DATE::VARCHAR AS day, count(*) AS visits FROM events WHERE ts::DATE + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) GROUP BY 1")
def stream_tumbling_daily(spark: SparkSession, folder: str) -> DataFrame:
    told = S.stream_daily_counts(_stream(spark, folder), "ts")
    return S.run_available(told.withColumn("day", F.col("day").cast("string")))


@query("stream_first_seen_ttl", _FIRST_SEEN)
def stream_first_seen_ttl(spark: SparkSession, folder: str) -> DataFrame:
    return S.run_available(S.stream_first_seen(_stream(spark, folder), "user_id", "ts", "event_id").select("user_id", "event_id"))


@query("stream_offset_replay", _REPLAY)
def stream_offset_replay(spark: SparkSession, folder: str) -> DataFrame:
    landed = S.run_available(_stream(spark, folder).select("user_id", "event_id"))
    return S.replay(landed, ["user_id"], ["event_id"], F.col("user_id") % 90 - 3).select("user_id", "event_id", "offset", "next_offset")


@query("stream_visit_store", f"""{_FIRST_SEEN.rsplit("SELECT user_id, event_id FROM fold", 1)[0]}, told AS (SELECT f.user_id, f.event_id, f.last AS us, row_number() OVER (PARTITION BY f.user_id ORDER BY f.last DESC, f.event_id DESC) AS back FROM fold f WHERE recorded),
days AS (SELECT user_id, us // 86400000000 AS day, count(*) AS n FROM told GROUP BY 1, 2), by_day AS (SELECT user_id, string_agg(day || ':' || n, ' ' ORDER BY day) AS daily FROM days GROUP BY 1)
SELECT t.user_id, count(*) AS total, string_agg(t.event_id::VARCHAR, ' ' ORDER BY t.back) FILTER (t.back <= 20) AS newest, any_value(d.daily) AS daily FROM told t JOIN by_day d ON d.user_id = t.user_id GROUP BY t.user_id""")
def stream_visit_store(spark: SparkSession, folder: str) -> DataFrame:
    session = S.with_rocksdb(spark)
    told = S.run_available(S.stream_visit_store(_stream(session, folder), "user_id", "ts", "event_id", keep=20))
    daily = F.array_join(F.zip_with("days", "counts", lambda d, n: F.concat_ws(":", d, n)), " ")
    return S.visit_store_now(told, "user_id").select("user_id", "total", F.array_join("newest", " ").alias("newest"), daily.alias("daily"))
