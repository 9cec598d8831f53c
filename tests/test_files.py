"""Readers and writers on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.functions.udfs import salvaged
from sparkfolio.operators import documents as D
from sparkfolio.operators import ranking as R
from sparkfolio.operators import scoring as S
from sparkfolio.sources import files
from sparkfolio.streaming import state


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_runs(spark, tmp_path):
    run = {"run_id": "S1_x", "company": "Acme", "fiscal_year": "2022", "rows": [{"item": "Land", "answer_m_usd": 3.5, "confidence": 0.9}]}
    put(tmp_path / "a/FY2022/r1/prediction.json", run)
    put(tmp_path / "a/FY2022/r1/request.json", {"run_id": "shadowed"})
    put(tmp_path / "a/_pending/r2/request.json", {"run_id": "S2_y", "company": None})
    put(tmp_path / "a/_pending/r3/prediction.json", "{not json")
    put(tmp_path / "a/_pending/r3/notes.json", run)
    runs = files.read_runs(spark, str(tmp_path / "a"))
    assert sorted(r.run_id for r in runs.collect()) == ["S1_x", "S2_y"]
    assert [tuple(r) for r in files.explode_runs(runs).collect()] == [("S1_x", 0, "Land", 3.5, 0.9, None)]
    assert files.find_run(runs, "S2_y").count() == 1


def test_runs_come_back(spark, tmp_path):
    kind = "run_id string, company string, fiscal_year string, strategy string"
    rows = [("S1_z", "Acme / Co", "FY2022", "s1"), ("S2 é=1", "日本商事", "2021", "s2"), (None, "Acme", "2022", "s3"), (" ", "Acme", "2022", "s4"), ("S5", None, None, "s5")]
    assert files.write_runs(spark.createDataFrame(rows, kind), str(tmp_path / "runs")) == 5
    assert files.write_runs(spark.createDataFrame([("S1_z", "Acme / Co", "FY2022", "again"), ("S1_w", "Acme", "2022", "s6")], kind), str(tmp_path / "runs")) == 2
    runs = files.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(r.strategy for r in runs.collect()) == ["again", "s2", "s3", "s4", "s5", "s6"]
    for run_id, strategy in (("S1_z", "again"), ("S2 é=1", "s2"), ("S5", "s5")):
        assert files.find_run(runs, run_id).first().strategy == strategy
    assert runs.where("run_id like 'unnamed_%'").select("run_id").distinct().count() == 2
    assert {p.parent.parent.name for p in tmp_path.glob("runs/*/*/*/prediction.json")} == {"FY2021", "FY2022", "FY-unknown"}
    assert (tmp_path / "runs/日本商事/FY2021/S2_é_1/prediction.json").exists()
    deep = tmp_path / "deep/a/b/c/d/e/prediction.json"
    put(deep, {"run_id": "far"})
    assert files.read_runs(spark, str(tmp_path / "deep")).first().run_id == "far"


def test_attempts_come_back(spark, tmp_path):
    kind = "run_id string, company string, fiscal_year string, kind string, repair int, content string"
    rows = [("r1", "Acme", "2022", "request", 0, '{"n": 1}'), ("r1", "Acme", "2022", "request", 2, "{not\njson"), ("r1", "Acme", "2022", "raw_response", None, "é"), ("r2", None, None, "request", 0, None)]
    assert files.write_attempts(spark.createDataFrame(rows, kind), str(tmp_path)) == 4
    got = sorted((r.directory.rsplit("/", 3)[1:], r.kind, r.repair, r.content.removesuffix("\n")) for r in files.read_attempts(spark, str(tmp_path)).collect())
    assert got == [(["Acme", "FY2022", "r1"], "raw_response", 0, "é"), (["Acme", "FY2022", "r1"], "request", 0, '{"n": 1}'), (["Acme", "FY2022", "r1"], "request", 2, "{not\njson"), (["Unknown_Company", "FY-unknown", "r2"], "request", 0, "")]
    with pytest.raises(Exception, match="kind must be"):
        files.write_attempts(spark.createDataFrame([("r", "A", "2022", "prediction", 0, "x")], kind), str(tmp_path))


def test_approvals_reach_the_manifest(spark, tmp_path):
    from sparkfolio.functions import dims
    from sparkfolio.operators import results as RS
    from sparkfolio.sources import snapshots

    columns = "sha256 string, local_path string, currency string, status string, source_sha256 string, approved_path string, approved_at string, note string"
    documents = spark.createDataFrame([("a", "x/a.pdf", None, "open", None, None, None, "n1"), ("b", "x/b.pdf", "usd", "open", None, None, None, "n2"), ("c", "", "jpy", "open", None, None, None, "n3")], columns)
    rows = [(d, k, item, " " if k == 1 else str(k), "string") for d in "abcz" for k, item in enumerate(dims.ITEMS) if (d, k) != ("b", 4)]
    rows = spark.createDataFrame(rows, "sha256 string, ord int, item string, answer string, kind string")
    folder = str(tmp_path / "manifest")
    snapshots.commit(spark, folder, documents.schema, lambda now: documents)
    at = F.lit("2024-05-01T00:00:00Z")
    snapshots.commit(spark, folder, documents.schema, lambda now: RS.approve(now, rows, dims.schema_dim(spark), at)[0])
    now = {r.sha256: r for r in snapshots.read(spark, folder, documents.schema).collect()}
    assert (now["a"].status, now["a"].source_sha256, now["a"].approved_path, now["a"].approved_at, now["a"].note) == ("human_verified", "a", "x/verification/approved_answers.json", "2024-05-01T00:00:00Z", "n1")
    assert now["b"].status == now["c"].status == "open" and now["b"].approved_at is None
    _, keys, outcomes = RS.approve(documents, rows, dims.schema_dim(spark), at)
    assert {r.sha256: r.error for r in outcomes.collect()} == {"a": None, "b": "the 27 schema rows in their order are needed", "c": "the stored file is missing", "z": "document not found"}
    assert [(r.answer_m_usd, r.currency, r.reviewer) for r in keys.orderBy("ord").collect()][:3] == [(0.0, "USD", "human"), (None, "USD", "human"), (2.0, "USD", "human")]


def test_manifest(spark, tmp_path):
    document = spark.createDataFrame([], "sha string, company string").schema
    put(tmp_path / "m.json", {"version": 1, "documents": [{"sha": "a", "company": "A", "more": 1}, {"sha": "b"}]})
    put(tmp_path / "bad.json", "{")
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.json"), document).collect()] == [("a", "A"), ("b", None)]
    assert files.read_manifest(spark, str(tmp_path / "bad.json"), document).count() == 0
    assert files.read_manifest(spark, str(tmp_path / "none.json"), document).count() == 0


def test_manifest_snapshot(spark, tmp_path):
    documents = spark.createDataFrame([("b", "beta"), ("a", "Acme"), ("c", None)], "sha string, company string")
    for docs in (documents.limit(1), documents):
        files.write_manifest(docs, str(tmp_path / "m.json"))
    back = files.read_manifest(spark, str(tmp_path / "m.json"), documents.schema)
    assert [r.sha for r in back.where("company IS NOT NULL").collect()] == ["a", "b"] and back.count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m.json"]
    files.write_manifest(documents.limit(0), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"version": 1, "documents": []}


def test_discover_keeps_filings_that_name_the_company(spark):
    from sparkfolio.operators import corpus as C

    rows = [
        (0, "search", "https://disclosure2.edinet-fsa.go.jp/a.pdf", "Annual Report 2022 Ａｃｍｅ co."),
        (1, "search", "https://disclosure2.edinet-fsa.go.jp/b.pdf", "Annual Report 2022 Beta"),
        (2, "search", "https://other.example/c.pdf", "Annual Report 2022 Acme"),
        (3, "map", "https://cdn.example/d.pdf", "Annual Report 2022"),
        (4, "deep_search", "https://ir.acme.example/e.pdf", "Annual Report 2022"),
        (5, "map", "https://acme.example/f.pdf", "Annual Report 2022 Ｑuarterly"),
    ]
    results = spark.createDataFrame([("Acme", *r, "") for r in rows], "company string, seq int, discovery string, url string, title string, description string")
    companies = spark.createDataFrame([("Acme", "acme.example")], "company string, domain string")
    got = {r.seq: r.source_verified for r in C.discover(results, companies, [2022]).collect()}
    assert got == {0: True, 3: True, 4: True}
    told = C.found_years(results, spark.createDataFrame([("Acme", [2021, 2022])], "company string, years array<int>")).first()
    assert (told.found, told.missing) == ([2022], [2021])


def test_pages_sent_as_numbers(spark):
    from sparkfolio.functions import dims
    from sparkfolio.operators import contract as K

    reply = '{"rows": [{"item": "Ｌａｎｄ", "answer_m_usd": "（１，２３４）", "confidence": 1, "source_page": -5}, {"item": "Land", "answer_m_usd": 1, "confidence": 1, "source_page": 3.7}, {"item": "Land", "answer_m_usd": 1, "confidence": 1, "source_page": 4.0}]}'
    read = K.read_replies(spark.createDataFrame([("r", reply)], "run_id string, content string"))
    rows = K.repair_rows(K.explode_rows(read, ["run_id"]), dims.names_dim(spark)).orderBy("ord").collect()
    assert [(r["item"], r.value, r.page_no, r.page_kind) for r in rows] == [("Land", -1234.0, None, "null"), ("Land", 1.0, None, "fraction"), ("Land", 1.0, 4, "number")]


def test_attempts_jobs_and_ledgers(spark, tmp_path):
    put(tmp_path / "a/FY2022/r1/request.json", {"n": 1})
    put(tmp_path / "a/FY2022/r1/request_repair_1.json", {"n": 2})
    put(tmp_path / "a/_pending/r2/raw_response.json", "{not json")
    got = sorted((r.directory[-2:], r.kind, r.repair) for r in files.read_attempts(spark, str(tmp_path / "a")).collect())
    assert got == [("r1", "request", 0), ("r1", "request", 1), ("r2", "raw_response", 0)]
    schema = "job string, status string, updated_at string"
    for rows in ([("ab1", "queued", "2024-01-01"), ("cd2", "done", "2024-01-03")], [("ab1", "running", "2024-01-02")]):
        files.write_job_states(spark.createDataFrame(rows, schema), str(tmp_path / "jobs"))
    assert [(r.job, r.status) for r in files.read_job_states(spark, str(tmp_path / "jobs"), schema).collect()] == [("cd2", "done"), ("ab1", "running")]
    with pytest.raises(Exception, match="not a job id"):
        files.write_job_states(spark.createDataFrame([("../x", "done", "")], schema), str(tmp_path / "jobs"))
    ledger = spark.createDataFrame([("Acme", 2.5, True), ("Beta", 3.5, False)], "company string, answer double, accepted boolean").coalesce(1)
    files.write_ledger(ledger, str(tmp_path / "ledger"))
    assert next((tmp_path / "ledger/md").glob("*.txt")).read_text().splitlines()[:3] == ["| company | answer | accepted |", "| --- | --- | --- |", "| Acme | 2.5 | true |"]
    files.write_csv(ledger, str(tmp_path / "blank"), blank_unless={"answer": "accepted"})
    assert next((tmp_path / "blank").glob("*.csv")).read_text().splitlines()[1:] == ["Acme,2.5,true", "Beta,,false"]


def test_events(spark, tmp_path):
    lines = ['{"event": "batch_start", "data": {"n": 1}, "at": "2024-01-01T00:00:00Z"}', "{bad", '{"event": "file_done", "at": "2024-01-01T00:00:01Z"}']
    put(tmp_path / "e.jsonl", "\n".join(lines))
    assert [(r.offset, r.event) for r in files.read_events(spark, str(tmp_path / "e.jsonl"), 1).collect()] == [(1, "file_done")]
    assert files.read_events(spark, str(tmp_path / "e.jsonl"), -5).count() == 2


def test_offsets_across_splits_and_files(spark, tmp_path):
    n = 400
    for k in range(3):
        put(tmp_path / f"log/{k}.jsonl", "\n".join("{bad" if i % 7 == 0 else json.dumps({"event": f"e{k}_{i}"}) for i in range(n)))
        os.utime(tmp_path / f"log/{k}.jsonl", (1000 - k, 1000 - k))  # the last file is the oldest
    want = [f"e{k}_{i}" for k in (2, 1, 0) for i in range(n) if i % 7]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for after in (0, 5, len(want) - 1):
            events, total = files.events_from(spark, str(tmp_path / "log"), after)
            assert total == len(want) and [r.event for r in sorted(events.collect(), key=lambda r: r.offset)] == want[after:]
            assert "Window" not in events._jdf.queryExecution().toString()
        events, total = files.events_from(spark, str(tmp_path / "log"), 10**6)
        assert total == len(want) and events.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_seeds_gold_csv(spark, tmp_path):
    put(tmp_path / "s.csv", "company_name,official_website,country\nAcme,https://a.example,us\n,https://b.example,\nBeta,,\n")
    assert [tuple(r) for r in files.read_seeds(spark, str(tmp_path / "s.csv")).collect()] == [("Acme", "https://a.example", "US"), ("Beta", None, "JP")]
    key = {"company": "Acme", "fiscal_year": "2022", "currency": "USD", "source_value_quantum": 1.0, "answers": {"Land": 2.0}}
    put(tmp_path / "g1.json", {"documents": {"aa": key}})
    put(tmp_path / "g2.json", {"documents": {"bb": key}})
    put(tmp_path / "g3.json", {"documents": {"aa": key}})
    paths = [str(tmp_path / f"g{k}.json") for k in (1, 2)]
    assert {(r.sha, r.item, r.gold) for r in files.read_gold(spark, paths).collect()} == {("aa", "Land", 2.0), ("bb", "Land", 2.0)}
    with pytest.raises(Exception, match="two gold files"):
        files.read_gold(spark, [*paths, str(tmp_path / "g3.json")]).collect()
    rows = spark.createDataFrame([('say "hi"', [1, 2])], "a string, b array<int>")
    files.write_csv(rows.coalesce(1), str(tmp_path / "csv"), quote_all=True)
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == '"a","b"\n"say ""hi""","[1,2]"\n'
    assert files.markdown_rows(rows.select("a")).first().line == '| say "hi" |'


def test_pdfs_and_pages(spark, tmp_path):
    put(tmp_path / "b/a.pdf", "%PDF-1.7 x")
    put(tmp_path / "b/b.pdf", "no")
    put(tmp_path / "t/d.txt", "one\ftwo")
    binary = spark.read.format("binaryFile").load(str(tmp_path / "b"))
    assert {(r.path[-5:], r.admitted) for r in files.admissible_pdfs(binary).collect()} == {("a.pdf", True), ("b.pdf", False)}
    assert sorted((r.doc, r.page, r.text) for r in files.read_page_texts(spark, str(tmp_path / "t")).collect()) == [("d.txt", 1, "one"), ("d.txt", 2, "two")]


def test_pages_of_long_files_in_splits(spark, tmp_path):
    files_ = {"a b+1.txt": [f"page {k}\nof é {'x' * (k % 90)}" for k in range(300)], "short.txt": ["only"], "ends.txt": ["one", "", "three"]}
    for name, pages in files_.items():
        put(tmp_path / "t" / name, "\f".join(pages) + ("\f" if name == "ends.txt" else ""))
    put(tmp_path / "t/none.txt", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        told = files.read_page_texts(spark, str(tmp_path / "t"))
        assert told.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, told.collect())) == sorted((name, k + 1, p) for name, pages in files_.items() for k, p in enumerate(pages))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_salvage():
    assert salvaged('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert salvaged('Sure {x}: {"a": "}"} ok') == '{"a": "}"}'
    assert salvaged('list [1, 2] here') == "[1, 2]"
    assert salvaged("nothing") is None and salvaged(None) is None


def test_text_functions(spark):
    text = "a b−c ﬁx​  \nd\x0ce\n\n\n\n\nf"
    row = spark.createDataFrame([(text, "\x01" * 20 + "ab", "a1b " * 30)], "t string, g string, m string").select(
        T.normalize_text(F.col("t")).alias("t"), T.garble_ratio(F.col("g")).alias("g"), T.mixed_token_ratio(F.col("m")).alias("m"), T.run_stamp(F.lit("S1_20240102T030405Z_001")).alias("s"), T.safe_filename(F.lit("../a b?.pdf")).alias("f")
    ).first()
    assert row.t == "a b-c fix\nd\ne\n\n\nf"
    assert round(row.g, 3) == round(20 / 22, 3) and row.m == 1.0 and row.s.hour == 3 and row.f == "a_b_.pdf"


def test_statement_pages(spark):
    pages = [("d", 1, "proxy statement by the board of directors"), ("d", 2, "Consolidated Balance Sheets\ncurrent assets 1,000 total assets 2,000\ncash and cash equivalents 12"), ("d", 3, "notes on weather"), ("d", 4, "連結貸借対照表 流動資産 資産合計")]
    frame = spark.createDataFrame(pages, "doc string, page int, text string")
    vocabulary = spark.createDataFrame([("assets",), ("cash",), ("balance",)], "term string")
    chosen = R.select_pages(R.score_pages(frame, vocabulary)).orderBy("rank").collect()
    assert [r.page for r in chosen][0] == 2 and chosen[-1].page == 1 and sum(r.selected for r in chosen) == 3
    text = "cover\n--- PAGE 38 ---\nBalance sheet in prose\n--- PAGE 50 ---\nconsolidated balance sheets 2022 2021\ncurrent assets 1\ncash and cash 2\ntotal assets 3\ninventories 4 (yen in millions)"
    split = R.split_pages(spark.createDataFrame([("d", text)], "doc string, text string"))
    told = R.screen_documents(split, spark.createDataFrame([("d", 2022), ("e", 2022)], "doc string, year int")).orderBy("doc").collect()
    assert (told[0].verdict, told[0].balance_sheet_page, told[0].currency, told[0].reporting_year) == ("ok", 50, "JPY", 2022)
    assert told[1].verdict == "unreadable" and len(told[1].reasons) == 3


def test_reconcile_and_consensus(spark):
    from sparkfolio.functions import dims

    assert [dims.leaves(t) for t, _ in dims.IDENTITIES] == [3, 4, 8, 6, 3, 11, 20]
    values = spark.createDataFrame([("r", "Quick Assets", 10.0), ("r", "Cash & Cash Equivalents", 4.0), ("r", "Accounts Receivable - Trade", 4.0), ("r", "Other Quick Assets", 4.0)], "run string, item string, value double")
    got = {r.total: r.status for r in S.reconcile(values, dims.edges_dim(spark), ["run"], quantum=1.0).collect()}
    assert got["Quick Assets"] == "ok" and got["Total Assets"] == "skipped" and len(got) == 7
    passes = spark.createDataFrame([("a", 1, 100.0, 0.9, "x"), ("a", 2, 100.0, 0.8, "y"), ("a", 3, 101.0, 0.7, "z"), ("b", 1, None, 0.5, "n")], "item string, pass int, value double, confidence double, evidence string")
    told = {r["item"]: r for r in S.consensus(passes, ["item"], 3).collect()}
    assert (told["a"].answer, told["a"].agreeing, told["a"].stability, told["a"].evidence) == (100.0, 2, "stable", "x")
    assert told["b"].stability == "missing" and told["b"].confidence == 0.0


def test_limiter(spark):
    events = spark.createDataFrame([("e", k, k < 2) for k in range(10)], "endpoint string, seq int, hit boolean")
    got = [r.permitted for r in state.adaptive_limiter(events, "endpoint", ["seq"], "hit", 8).orderBy("seq").collect()]
    assert got == [4, 2, 2, 2, 2, 3, 3, 3, 3, 4]


def test_first_seen_over_batches(spark, tmp_path):
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    batches = [[("a", day(0), 1), ("a", day(0, 1), 2)], [("b", day(5), 3)], [("a", day(5, 1), 4), ("b", day(5, 2), 5), ("b", day(5, 7), 6)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user string, ts timestamp, id int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("user string, ts timestamp, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = state.run_available(state.stream_first_seen(stream, "user", "ts", "id").select("user", "id"))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 6]


def test_health_and_ranges(spark):
    pages = spark.createDataFrame([("d", k, "\x01" * 40 if k == 2 else "" if k == 3 else f"page {k}") for k in (1, 2, 3, 6, 7)], "doc string, page int, text string")
    told = D.assemble(pages).first()
    assert told.garbled_pages == [2] and told.empty_pages == 1 and told.readable_pages == 3 and len(told.warnings) == 2
    assert told.text == "--- PAGE 1 ---\npage 1\n\n--- PAGE 6 ---\npage 6\n\n--- PAGE 7 ---\npage 7"
    assert D.page_ranges(pages, ["doc"]).first().pages == "1-3, 6-7"
