"""Scraped links, markers, source verification and guarded deletion on small inputs."""

import random
import re

import pytest

from sparkfolio.operators import corpus as C
from sparkfolio.operators import verification as V
from sparkfolio.sources import files, snapshots


def scrape(markdown, links):
    """Links of one page by a plain loop over matches."""
    seen, out = set(), []
    for m in re.finditer(r"\[([^\]]+)\]\((https?://[^)\s]+)", markdown or ""):
        title, url = m.group(1).strip(), m.group(2).strip()
        years = re.findall(r"(20\d{2})(?:年|\b)", markdown[max(0, m.start() - 180) : m.start()])
        if years and years[-1] not in title:
            title = f"{years[-1]} {title}".strip()
        if url not in seen:
            seen.add(url)
            out.append((url, title))
    for url, text in links or []:
        if url and url not in seen:
            seen.add(url)
            out.append((url, text or ""))
    return [(k, *x) for k, x in enumerate(out)]


def test_links_keep_their_own_places(spark):
    r = random.Random(3)
    some = ["2021年度 ", "FY2023 ", "12022x ", "2020年", "20225 ", "x" * 90, "[a](http://x/1) ", "[a](http://x/1) ", "[報告書 2021](https://y/2 \"t\") ", "[ ](http://z)", "\n\n", "[b\nc](https://w/é) ", "[broken](ftp://q) ", "](", "[d](http://x/3)[e](http://x/4)"]
    pages = [(k, "".join(r.choice(some) for _ in range(r.randint(0, 40))), [(r.choice(["http://x/1", "http://raw/1", "", None]), r.choice(["t", None])) for _ in range(r.randint(0, 4))]) for k in range(60)]
    pages += [(100, None, None), (101, "", []), (102, "[a](http://x/1)" * 30, None), (103, "2021 [a](http://x/1) 2023 [a](http://x/1) 2023 [b](http://x/2)", None)]
    frame = spark.createDataFrame(pages, "doc int, markdown string, links array<struct<url: string, text: string>>")
    got = {}
    for x in sorted(C.scraped_links(frame).collect(), key=lambda x: (x.doc, x.seq)):
        got.setdefault(x.doc, []).append((x.seq, x.url, x.title))
    want = {k: scrape(m, links) for k, m, links in pages}
    assert got == {k: v for k, v in want.items() if v}
    assert got[103] == [(0, "http://x/1", "2021 a"), (1, "http://x/2", "2023 b")]


@pytest.mark.parametrize("block", [1 << 24, 30])
def test_markers_of_all_blocks(spark, block):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab漢") for _ in range(r.randint(1, 3)))
    texts = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(40)] + [(99, None), (98, ""), (0, "a second text of an id")]
    markers = [(" ".join(word() for _ in range(r.randint(1, 4))),) for _ in range(50)] + [(None,), ("a b",), ("ab",), (" ",)]
    got = V.markers_in(spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(markers, "marker string"), id_col="doc", block=block)
    pack = lambda t: re.sub(r"\s+", "", t)
    want = {(k, m) for k, t in texts if t is not None for (m,) in markers if m is not None and pack(m) in pack(t)}
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert V.markers_in(spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame([], "marker string"), id_col="doc").count() == 0


def test_gates_of_sources(spark):
    sources = [("a", "s", 3, "s", 3, "1 234 x", "1\n234 x"), ("b", "s", 3, "t", 3, "", ""), ("c", "s", 3, "s", 4, "", ""), ("d", "s", 3, "s", 3, "12", "9"), ("e", "s", 3, "s", 3, "9", "12"), ("f", None, 3, None, 3, "", ""), ("g", "s", 3, "s", 3, None, None)]
    frame = spark.createDataFrame(sources, "k string, sha256 string, pages int, registered_sha256 string, registered_pages int, text_a string, text_b string")
    markers = spark.createDataFrame([("a", "1234"), ("a", "234 x"), ("d", "12"), ("e", "12"), ("e", None)], "k string, marker string")
    got = {x.k: (x.verified, x.reason, x.markers) for x in V.verify_sources(frame, markers, id_col="k").collect()}
    assert got == {"a": (True, None, 2), "b": (False, "digest", 0), "c": (False, "pages", 0), "d": (False, "second text", 1), "e": (False, "first text", 1), "f": (False, "digest", 0), "g": (True, None, 0)}


def test_guarded_deletion(spark, tmp_path):
    folder = str(tmp_path / "runs")
    rows = [("mine", "w-1", "Acme"), ("busy", "w-1", "Acme"), ("other", "w-2", "Acme"), ("public", None, "Beta")]
    runs = spark.createDataFrame(rows, "run_id string, workspace_id string, company string")
    files.write_runs(runs.withColumn("fiscal_year", C.F.lit("2022")), folder)
    snapshots.commit(spark, str(tmp_path / "t"), runs.schema, lambda now: runs)
    busy = spark.createDataFrame([("busy",)], "run_id string")
    told = files.delete_runs(spark, folder, ["mine", "mine", "busy", "other", "public", "none"], "w-1", busy)
    assert {x.run_id: x.outcome for x in told.collect()} == {"mine": "deleted", "busy": "running", "other": "foreign", "public": "foreign", "none": "missing"}
    assert sorted(x.run_id for x in files.read_runs(spark, folder).collect()) == ["busy", "other", "public"]
    assert [x.run_id for x in files.deleted_runs(spark, folder).collect()] == ["mine"]
    snapshots.commit(spark, str(tmp_path / "t"), runs.schema, lambda now: V.without(now, told))
    assert sorted(x.run_id for x in snapshots.read(spark, str(tmp_path / "t"), runs.schema).collect()) == ["busy", "other", "public"]
    assert {x.outcome for x in files.delete_runs(spark, folder, ["mine", "public"], "legacy-public").collect()} == {"missing", "deleted"}
    assert {x.outcome for x in files.delete_runs(spark, str(tmp_path / "nothing"), ["x"], "w-1").collect()} == {"missing"}
