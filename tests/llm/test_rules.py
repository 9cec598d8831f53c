"""Rules, licenses, URLs, WARC records and overlaps: against SQL on DuckDB or brute force."""

import gzip
import sys
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
import corpora  # noqa: E402
import parity  # noqa: E402
from sparkfolio.llm import decontamination, license_scan, quality_rules, queries, url_filters, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_whole_tables(spark, name):
    assert parity.differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) is None


def odd_texts():
    good = " ".join(f"Word{i} follows word{i}, then ends." for i in range(20))
    lines = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(9))
    return [
        *corpora.awkward(seed=3),
        (901, good, "a"),
        (902, lines, "a"),
        (903, lines + "\nHome | News | Sport | Weather | Help\n\nAll rights reserved\nDo this!! Now!! Or!! Else!! Go!!", "a"),
        (904, "\n".join(["menu | home | about | login | more"] * 20), "a"),
        (905, "$$ ## word&&\n" * 40 + lines, "a"),
        (906, "no mark at all " * 30, "a"),
        (907, "a b c a b c a b c\n" * 10, "a"),
        (908, "Released under the MIT License. " + lines, "a"),
        (909, "x " * 30 + license_scan.TEMPLATES[2].text.replace("merge", "fuse").upper() + " y" * 40, "a"),
        (910, " ".join(license_scan.TEMPLATES[2].text.split()[:20]), "a"),
        (911, "Licensed, under: the APACHE license (version 2.0)!", "a"),
    ]


def test_quality_of_odd_texts(spark):
    rows = odd_texts()
    frame = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    got = quality_rules.judge(corpora.frame(spark, rows))
    assert parity.differences(got.drop("clean_text"), quality_rules.SQL, SF, {"documents": frame}) is None
    told = {r.doc_id: r for r in got.collect()}
    assert told[901].clean_text == rows[[r[0] for r in rows].index(901)][1]
    assert told[902].kept and told[903].kept and not any(told[i].kept for i in (904, 906, 907))
    assert "Weather" not in told[903].clean_text and "rights" not in told[903].clean_text and "Else" not in told[903].clean_text


def test_licenses_of_odd_texts(spark):
    rows = odd_texts()
    frame = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    got = license_scan.scan_licenses(corpora.frame(spark, rows))
    assert parity.differences(got, license_scan.SQL, SF, {"documents": frame}) is None
    found = {(r.doc_id, r.license) for r in got.collect()}
    assert {(908, "MIT"), (909, "MIT"), (911, "Apache-2.0")} <= found and not any(i == 910 for i, _ in found)


URLS = [
    "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://EXAMPLE.net/en/x", "https://b.example.net/en/?q", "https://example.net/EN/x", "//x.net/", "no scheme", "", None,
    "x://example.com/de/#f", "http://example.com/fr/", "http://notexample.com/de/", "ftp://u.org/fr/a/b?c://d", "http://x.org/fr", "://", "http://", "http:///p", "http://h?x/y", "http://h#f/y",
    "https://casino.example.com/", "https://my-casino.example.com/en", "https://casinos.example.com/en", "http://a.com/login", "http://a.com/x/login.php", "http://a.com/loginx", "http://a.com/?login",
    "http://a.com/wp-admin/x", "http://a.com/wp/admin", "http://É.com/Ü", "http://a.com/cgi-bin/x?y", "http://a.com/\nnew/login",
]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (90, URLS[20]), (90, URLS[20])]
    frame = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id bigint, url string, host string, token string, k string")
    got = url_filters.filter_urls(pages)
    assert parity.differences(got, url_filters.SQL, SF, {"pages": frame}) is None
    told = {r.page_id: r for r in got.collect()}
    assert [told[k].rule for k in (0, 1, 2, 3, 4, 5, 10, 13)] == [None, "net/", "net/", "example.net/en/", "example.net/en/", "net/", "example.com/de/", "org/fr/"]
    assert [told[k].verdict for k in (20, 21, 22, 23, 24, 25, 26, 27, 28)] == ["block", "block", "allow", "block", "block", "allow", "allow", "block", "allow"]
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = "<html><head><title>T &amp; t</title><script>var x='</p>'</script></head><body><p>One  two<br/>three<!-- no --></p><DIV>four &lt;b&gt;</DIV></body>"
    rows = [(1, "http://a/", html), (2, "http://b/", None), (3, None, ""), (3, None, ""), (None, "http://c/", "é" * 10)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, source string")
    sent = warc.responses(pages)
    made = warc.derive(sent, carry=("page_id",)).collect()
    assert len(made) == 2 * len(rows)
    text = {r.page_id: bytes(r.payload).decode() for r in made if r.type == "conversion"}
    assert text[1] == "T & t\nOne two\nthree\nfour <b>" and text[2] == text[3] == ""
    ids = {r.record_id for r in sent.collect()}
    assert all(r.refers_to in ids for r in made)
    meta = next(bytes(r.payload).decode() for r in made if r.page_id == 1 and r.type == "metadata")
    conversion = next(r for r in made if r.page_id == 1 and r.type == "conversion")
    assert f"conversion: {conversion.record_id}\r\n" in meta and "source-http-status: 200\r\n" in meta
    both = sent.drop("page_id").unionByName(warc.derive(sent))
    whole = b"".join(bytes(r.member) for r in warc.members(both).collect())
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(whole)[:-7])  # the last record is cut off
    back = warc.read(spark, str(tmp_path / "a.warc.gz"))
    columns = [c for c in warc.RECORD_COLUMNS]
    assert parity.spark_rows(back.select(columns)) == parity.spark_rows(both.select(columns))
    assert warc.read(spark, str(tmp_path)).count() == 2 * both.count() - 1
    assert warc.derive(sent.limit(0)).count() == 0


def brute_overlaps(docs, items, overlap=13, penalty=3):
    """(doc, item) pairs with a segment, on one diagonal, that holds a seed and
    scores best around it (+1 a match, -penalty a mismatch)."""
    fold = lambda t: decontamination.folded(t)[0].decode().split()
    grown = lambda same: max(((sum(1 if x else -penalty for x in same[: k + 1]), -k) for k in range(len(same))), default=(0, 1))
    items = [(j, fold(u)) for j, u in items]
    found = set()
    for i, t in docs:
        w, where = fold(t), {}
        for p, x in enumerate(w):
            where.setdefault(x, []).append(p)
        for j, x in items:
            diagonals = Counter(p - k for k, y in enumerate(x) for p in where.get(y, ()))
            for shift, n in diagonals.items():
                same = [0 <= k + shift < len(w) and x[k] == w[k + shift] for k in range(len(x))] if n >= 6 else []
                for m in decontamination.MASKS:
                    for a in range(len(same) - len(m) + 1):
                        if all(same[a + o] for o, c in enumerate(m) if c == "1"):
                            right, left = grown(same[a:]), grown(same[:a][::-1])
                            size = (1 - right[1] if right[0] > 0 else 0) + (1 - left[1] if left[0] > 0 else 0)
                            if size >= min(overlap, len(x)):
                                found.add((i, j))
    return found


def test_overlaps(spark):
    items = [(k, t) for k, (_, t, _) in enumerate(corpora.awkward(seed=11, n=12, vocabulary=5000)) if t and 8 <= len(t.split()) < 200][:8]
    items += [(90, None), (91, ""), (92, "too short"), (93, "one two three four five six seven")]
    docs = corpora.awkward(seed=12, n=25, vocabulary=3000)
    w = items[0][1].split()
    docs += [
        (200, "pre " * 40 + " ".join(w).replace("a", "A").replace("b", "B") + " post" * 40, "s"),
        (201, "pre " * 500 + " ".join(x if k % 7 else "changed" for k, x in enumerate(w[:60])) + " post", "s"),
        (202, " ".join(w[:9]), "s"),
        (203, "One, two: three (four) FIVE six; seven!", "s"),
        (204, " ".join(x if k % 2 else "changed" for k, x in enumerate(w)), "s"),
    ]
    bench = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id bigint, text string, item bigint, seed bigint")
    got = decontamination.find_overlaps(corpora.frame(spark, docs), bench)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == brute_overlaps([(i, t) for i, t, _ in docs], items)
    assert {(200, items[0][0]), (201, items[0][0]), (203, 93)} <= pairs and not any(i in (202, 204) for i, _ in pairs)
    assert decontamination.find_overlaps(corpora.frame(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.find_overlaps(corpora.empty(spark), bench).count() == 0


def test_pipeline_is_its_stages(spark):
    """run() against the stages' contracts by brute force, on the smallest tables."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    rows = sorted((r.doc_id, judged[r.doc_id].clean_text, r.source) for r in docs.collect() if judged[r.doc_id].kept)
    kept = p.quality(spark, docs, SF)
    assert corpora.ordered(kept.select("doc_id", "text", "source").collect()) == corpora.ordered(rows)
    stay = []
    for r in rows:  # in order of ids, a text goes if one that stays is alike
        if not any(corpora.alike(r[1], u[1], 5, 0.8) for u in stay):
            stay.append(r)
    rows = stay
    alone = p.near_copies(spark, kept, SF)
    assert corpora.ordered(alone.select("doc_id", "text", "source").collect()) == corpora.ordered(rows)
    gone = corpora.removed([t.encode().split() for _, t, _ in rows], 35)
    rows = [(i, t if not any(g) else b" ".join(x for x, y in zip(t.encode().split(), g) if not y).decode(), s) for (i, t, s), g in zip(rows, gone) if not all(g)]
    cut = p.substrings(spark, alone, SF)
    assert corpora.ordered(cut.select("doc_id", "text", "source").collect()) == corpora.ordered(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_overlaps([(i, t) for i, t, _ in rows], items)}
    assert leaks
    rows = [r for r in rows if r[0] not in leaks]
    clean = p.decontaminate(spark, cut, SF)
    assert clean.columns == docs.columns
    assert corpora.ordered(clean.select("doc_id", "text", "source").collect()) == corpora.ordered(rows)
    packed = p.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in rows}
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as p

    rows = [(i, t, "en", s, len(t or "")) for i, t, s in odd_texts()] + [(None, odd_texts()[-10][1], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for _, stage in p.STAGES:
            frame = stage(spark, frame, SF).cache()
            frame.count()
