"""Numbered snapshots: concurrent writers, pinned readers, broken hints."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.sources import snapshots

KIND = T.StructType([T.StructField("sha", T.StringType()), T.StructField("n", T.LongType())])


def added(spark, *rows):
    return lambda now: now.unionByName(spark.createDataFrame([*rows], KIND))


def held(spark, folder, version=None):
    return sorted(tuple(r) for r in snapshots.read(spark, folder, KIND, version).collect())


def test_versions_and_pins(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert snapshots.latest(spark, folder) == 0 and held(spark, folder) == []
    assert snapshots.commit(spark, folder, KIND, added(spark, ("a", 1))) == 1
    pinned = snapshots.read(spark, folder, KIND)
    assert snapshots.commit(spark, folder, KIND, added(spark, ("b", 2))) == 2
    assert snapshots.commit(spark, folder, KIND, lambda now: now.where("sha <> 'a'").withColumn("more", F.lit(1))) == 3
    assert [tuple(r) for r in pinned.collect()] == [("a", 1)]
    assert held(spark, folder, 2) == [("a", 1), ("b", 2)] and held(spark, folder) == [("b", 2)]
    assert snapshots.vacuum(spark, folder, keep=1, older_than=0) == [1, 2]
    assert held(spark, folder) == [("b", 2)] and len(list((tmp_path / "t/data").iterdir())) == 1


@pytest.mark.parametrize("hint", [None, "1", "77", "nonsense"])
def test_the_hint_may_be_missing_or_wrong(spark, tmp_path, hint):
    folder = str(tmp_path / "t")
    for k in range(3):
        snapshots.commit(spark, folder, KIND, added(spark, (str(k), k)))
    for old in tmp_path.glob("t/*latest*"):
        old.unlink()
    for crc in tmp_path.glob("t/.latest*"):
        crc.unlink()
    if hint:
        (tmp_path / "t/latest").write_text(hint)
    assert snapshots.latest(spark, folder) == 3
    assert snapshots.commit(spark, folder, KIND, added(spark, ("x", 9))) == 4 and len(held(spark, folder)) == 4


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")

    def write(k):
        for j in range(3):
            snapshots.commit(spark, folder, KIND, added(spark, (f"{k}-{j}", k)))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert [s for s, _ in held(spark, folder)] == sorted(f"{k}-{j}" for k in range(4) for j in range(3))
    told = [json.loads(p.read_text()) for p in sorted(tmp_path.glob("t/versions/*.json"))]
    assert [(t["version"], t["base"]) for t in told] == [(k + 1, k) for k in range(12)]
    assert {p.name for p in (tmp_path / "t/data").iterdir()} == {t["data"] for t in told}


def test_readers_see_whole_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(str(k), k) for k in range(50)]
    snapshots.commit(spark, folder, KIND, added(spark, *rows))

    def write(_):
        return snapshots.commit(spark, folder, KIND, lambda now: now.withColumn("n", F.col("n") + 1))

    with ThreadPoolExecutor(2) as pool:
        writing = pool.submit(lambda: [write(k) for k in range(4)])
        while not writing.done():
            now = held(spark, folder)
            assert len(now) == 50 and len({n - int(s) for s, n in now}) == 1
    assert held(spark, folder)[0][1] == 4


def test_only_one_creates_a_file(spark, tmp_path):
    f = snapshots.Folder(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: f.create(f.at("one.json"), str(k)), range(16)))
    assert sum(made) == 1 and f.read(f.at("one.json")) == str(made.index(True))


def test_a_failing_change_publishes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(Exception, match="no_such"):
        snapshots.commit(spark, folder, KIND, lambda now: now.where("no_such = 1"))
    assert snapshots.latest(spark, folder) == 0
