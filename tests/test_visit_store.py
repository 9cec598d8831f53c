"""The visit store: first sightings, newest visits and counts by day, over batches and a restart."""

import datetime as dt
import random
from collections import Counter

from sparkfolio.streaming import state

HOUR = 3600


def store(spark, folder, out, ttl, keep):
    session = state.with_rocksdb(spark)
    stream = session.readStream.schema("user string, ts timestamp, id bigint").option("maxFilesPerTrigger", 1).parquet(folder)
    return state.run_available(state.stream_visit_store(stream, "user", "ts", "id", ttl, keep), folder=out)


def brute(rows, ttl, keep):
    last, recorded = {}, {}
    for ts, i, user in sorted((ts, i, u) for u, ts, i in rows if ts is not None):
        if user not in last or (ts - last[user]).total_seconds() >= ttl:
            last[user] = ts
            recorded.setdefault(user, []).append((ts, i))
    day = lambda ts: (ts - dt.datetime(1970, 1, 1)).days
    for user, visits in recorded.items():
        days = sorted(Counter(day(ts) for ts, _ in visits).items())
        yield user, len(visits), [i for _, i in visits[::-1][:keep]], [d for d, _ in days], [n for _, n in days]


def test_equals_batch_over_batches_and_a_restart(spark, tmp_path):
    r = random.Random(2)
    begin = dt.datetime(2024, 1, 1)
    rows = [(f"u{r.randrange(6)}", begin + dt.timedelta(seconds=3 * k * HOUR // 4 + r.randrange(HOUR // 2)), k) for k in range(240)]
    rows += [("u0", None, 999)]
    parts = [rows[k : k + 40] for k in range(0, 240, 40)]
    parts[0] = parts[0] + rows[240:]
    put = lambda k: spark.createDataFrame(parts[k], "user string, ts timestamp, id bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for k in range(3):
        put(k)
    half = store(spark, str(tmp_path / "in"), out, 6 * HOUR, 5)
    key = lambda rows: sorted((x[0], *x[1:]) for x in map(tuple, rows))
    assert key(state.visit_store_now(half, "user").collect()) == key(brute([x for p in parts[:3] for x in p], 6 * HOUR, 5))
    for k in range(3, 6):
        put(k)
    told = store(spark, str(tmp_path / "in"), out, 6 * HOUR, 5)
    assert key(state.visit_store_now(told, "user").collect()) == key(brute(rows, 6 * HOUR, 5))
    recorded = [i for x in told.collect() for i in x.recorded]
    batch = state.first_seen_ttl(spark.createDataFrame([x for x in rows if x[1]], "user string, ts timestamp, id bigint"), "user", "ts", ["id"], 6 * HOUR)
    assert sorted(recorded) == sorted(x.id for x in batch.collect())
