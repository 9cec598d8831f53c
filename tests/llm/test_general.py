"""What the operators offer beyond their queries: whole overlaps, factors, weights, gaps in files, long texts."""

import gzip
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent)]
import corpora  # noqa: E402
from sparkfolio.llm import decontamination, license_scan, packing, queries, substring_rlz, token_counts, warc  # noqa: E402
from sparkfolio.llm.queries import tokenizer_path  # noqa: E402


def best(same, at, penalty):
    """Start and end of the best-scoring stretch around a place."""

    def reach(flags):
        score, top, n = 0, 0, 0
        for k, x in enumerate(flags):
            score += 1 if x else -penalty
            if score > top:
                top, n = score, k + 1
        return n

    return at - reach(same[:at][::-1]), at + reach(same[at:])


def whole_overlaps(docs, items, overlap=13, penalty=3):
    """All columns of every overlap: stretches of one alignment that overlap or touch are one."""
    fold = lambda t: decontamination.folded(t)[0].decode().split()
    out = set()
    for i, t in docs:
        w = fold(t)
        for j, u in items:
            x = fold(u)
            where = defaultdict(list)
            for k, y in enumerate(x):
                where[y].append(k)
            shifts = defaultdict(int)
            for p, y in enumerate(w):
                for k in where[y]:
                    shifts[p - k] += 1
            for shift, n in shifts.items():
                if n < 6:
                    continue
                a, b = max(0, shift), min(len(w), shift + len(x))
                same = [w[p] == x[p - shift] for p in range(a, b)]
                hits = {p for m in decontamination.MASKS for p in range(len(same) - len(m) + 1) if all(same[p + o] for o, c in enumerate(m) if c == "1")}
                spans = sorted(best(same, p, penalty) for p in hits)
                merged = []
                for s, e in spans:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                for s, e in merged:
                    if e - s >= min(overlap, len(x)):
                        out.add((i, j, a + s, a + e, a + s - shift, sum(same[s:e]), len(x)))
    return out


def test_overlaps_in_all_columns(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    long = [word() for _ in range(1500)]
    items = [(1, " ".join(long)), (2, " ".join(long[200:260])), (3, " ".join(word() for _ in range(20))), (3, "another text of the same id " * 4), (None, " ".join(word() for _ in range(30)))]
    every = [x if k % 9 else word() for k, x in enumerate(long)]
    docs = [
        (1, " ".join(["pre"] * 700 + long + ["post"] * 300)),
        (2, " ".join(["pre"] * 50 + every + ["post"])),
        (3, " ".join(long[:400] + [word() for _ in range(3)] + long[400:900])),
        (4, " ".join([word() for _ in range(30)] + items[2][1].split() + [word() for _ in range(5)] + items[4][1].split())),
        (5, " ".join(long[700:1300])),
        (6, None),
        (None, " ".join(long[:100])),
        (1, " ".join(["pre"] * 700 + long + ["post"] * 300)),
    ]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, shift string")
    frame = spark.createDataFrame([(*x, 0, "x", 1) for x in docs], "doc_id bigint, text string, start int, item string, lo int").repartition(3)
    got = {tuple(x) for x in decontamination.find_overlaps(frame, bench).select("doc_id", "item_id", "start", "end", "item_start", "n_matched", "item_words").collect()}
    assert got == whole_overlaps(docs, items)
    assert (1, 1, 700, 2200, 0, 1500, 1500) in got


def test_factors_tile_the_removed_spans(spark):
    rows = corpora.awkward(seed=6)
    got = substring_rlz.dedup_substrings(corpora.frame(spark, rows), length=12).collect()
    texts, named = defaultdict(list), {}
    for i, t, *_ in rows:
        texts[i].append((t or "").encode().split())
    n = 0
    for x in got:
        words = next(w for w in texts[x.doc_id] if len(w) == x.n_words and b" ".join(w[k] for k in range(len(w)) if not any(s.start <= k < s.end for s in x.removed_spans)).decode() == x.kept_text)
        tiled = [k for f in x.factors for k in range(f.start, f.start + f.length)]
        assert tiled == [k for s in x.removed_spans for k in range(s.start, s.end)]
        for f in x.factors:
            n += 1
            whole = words[f.start - f.offset : f.start + f.length]
            assert f.offset >= 0 and len(whole) >= 12
            assert named.setdefault(f.block, whole) == whole
    assert n > 20


def test_parse_is_greedy():
    blocks = [{"p": 0, "q": 3, "s": 1}, {"p": 2, "q": 0, "s": 2}, {"p": 4, "q": 6, "s": 3}, {"p": 30, "q": 0, "s": 4}]
    assert substring_rlz.parse(blocks, 5) == [(0, 8, 1, 0), (8, 7, 3, 4), (30, 5, 4, 0)]
    assert substring_rlz.parse(None, 5) == []


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3}, {"c": 0.001, "a": 1}, {}])
def test_weights_hold_until_a_source_runs_dry(spark, weights):
    r = random.Random(2)
    rows = [(k, " ".join(f"x{r.randrange(99)}" for _ in range(r.randrange(60))), r.choice(["a", "a", "a", "b", "c", None])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = packing.pack(docs, tokenizer_path(), sequence=32, window=256, weights=weights, carry=("source",)).collect()
    place = sorted((x.sequence_id * 32 + x.offset, x.length, x.source) for x in got)
    at, stream = 0, []
    for p, n, s in place:
        assert p == at
        at += n
        stream += [s] * n
    total = {s: stream.count(s) for s in set(stream)}
    live = [s for s in weights if weights[s]]
    if live:  # before the first source runs dry, every window holds the proportions
        used = min(total[s] / weights[s] for s in live) * sum(weights[s] for s in live)
        wide = 256
        while wide * min(weights[s] for s in live) / sum(weights[s] for s in live) < 1:
            wide += 256
        for w in range(int(used) // wide):
            part = stream[w * wide : (w + 1) * wide]
            for s in live:
                assert abs(part.count(s) - wide * weights[s] / sum(weights.values())) < 2
    last = stream[max((k for k, s in enumerate(stream) if s in live), default=-1) + 1 :]
    assert all(s not in live for s in last) and len(last) == sum(n for s, n in total.items() if s not in live)


def test_small_sources_share_a_queue(spark):
    rows = [(k, "word " * 200, "big") for k in range(40)] + [(100 + k, "one", f"small{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = packing.pack(docs, tokenizer_path(), sequence=16, window=256, carry=("source",)).collect()
    stream = [s for _, s in sorted((x.sequence_id * 16 + x.offset + k, x.source) for x in got for k in range(x.length))]
    places = [k for k, s in enumerate(stream) if s != "big"]
    assert len(places) == 60 and max(places) - min(places) > len(stream) // 2


@pytest.mark.parametrize("part", [1 << 22, 64])
def test_warc_gaps(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(warc, "PART", part)
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k} " + "x&copy;y " * 40) for k in range(6)], "page_id bigint, url string, html string")
    members = [gzip.compress(warc.record_bytes(r.asDict()), mtime=0) for r in warc.responses(pages).orderBy("page_id").collect()]
    plain = [gzip.decompress(m) for m in members]
    bad = bytearray(members[2])
    bad[20:60] = bytes(40)
    lost: list[int] = []
    assert [r["target_uri"][-1] for r in warc.parse(b"".join([*members[:2], bytes(bad), *members[3:]]), lost)] == list("01345") and lost
    lost = []
    assert [r["target_uri"][-1] for r in warc.parse(plain[0] + b"noise\r\n" + plain[1] + plain[2].replace(b"Content-Length: ", b"Content-Length: x") + plain[3] + plain[4][:-9], lost)] == list("013") and len(lost) >= 3
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*members[:2], bytes(bad), *members[3:]]))
    (tmp_path / "b.warc").write_bytes(b"".join(plain))
    assert warc.read(spark, str(tmp_path)).count() == 11
    told = {x.path[-6:]: x.gaps for x in warc.unread(spark, str(tmp_path)).collect()}
    assert told["b.warc"] == 0 and told["arc.gz"] > 0


def test_joined_license_index(spark, monkeypatch):
    rows = [(1, "Released under the MIT License. " + "w " * 9), (2, license_scan.TEMPLATES[2].text + " and more"), (3, "none of it"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = sorted(map(tuple, license_scan.scan_licenses(docs).collect()))
    monkeypatch.setattr(license_scan, "INLINED", 0)
    monkeypatch.setattr(license_scan, "SMALL_INDEX", 0)
    assert near and near == sorted(map(tuple, license_scan.scan_licenses(docs).collect()))
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_long_texts_are_cut_at_safe_blanks(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "GROUP", 50)
    monkeypatch.setattr(token_counts, "CALL", 30)
    whole = Tokenizer.from_file(tokenizer_path())
    texts = [t for _, t, _ in corpora.awkward(seed=8)] + ["word " * 500, "x" * 700, " ".join(f"a{k}\nb  c\td{k}" for k in range(200)), "é \0 b\0c " * 90, "\n\n a \n" * 60, "<|endoftext|> y <b> " * 40]
    texts += [" a　b 　c", "a  b", "tail \n", "\n", "a\x85 b\n c", "a b c d e\nf\ng h"]
    import pyarrow as pa

    got = [np.frombuffer(x, "<u4").tolist() for x in token_counts.encoded(tokenizer_path(), pa.array(texts))]
    told = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == told
    assert token_counts.counted(tokenizer_path(), pa.array(texts)).tolist() == [len(x) for x in told]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_op1_on_the_whole_table(spark, table):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    n = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, _ in table]
    got = queries.QUERIES["op1_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert corpora.ordered(got) == corpora.ordered((i, len((t or "").encode()), k, k > 1024) for (i, t, _), k in zip(table, n))


def test_op3_on_the_whole_table(spark, table):
    got = queries.QUERIES["op3_substring_rlz"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert corpora.ordered(got) == corpora.ordered(corpora.substrings(table, 35))


def test_op5_on_the_whole_table(spark, table):
    got = queries.QUERIES["op5_suffix_doubling"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert corpora.ordered(got) == corpora.ordered(corpora.byte_strings(table, 400))


def test_op6_on_the_whole_table(spark, table):
    from tokenizers import Tokenizer
    import zlib

    whole = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in table}
    got = queries.QUERIES["op6_packing"](spark, SF).collect()
    covered, places = defaultdict(list), []
    for x in got:
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length and x.doc_tokens == len(ids[x.doc_id]) and zlib.crc32(np.array(part, "<u4").tobytes()) == x.ids_crc32
        covered[x.doc_id] += range(x.start, x.start + x.length)
        places.append((x.sequence_id * 1024 + x.offset, x.length))
    assert all(sorted(covered[i]) == [*range(len(x))] for i, x in ids.items())
    places.sort()
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0


def test_op8_on_the_whole_table(spark, table):
    got = queries.QUERIES["op8_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert corpora.ordered(got) == corpora.ordered(corpora.near(table, 4, 4))


def test_no_columns_clash_or_are_read(spark):
    rows = [(1, "http://a/", "<p>x</p>", "s", b"p", "m")]
    sent = warc.responses(spark.createDataFrame(rows, "page_id bigint, url string, html string, source string, payload binary, text string"))
    extra = sent.withColumn("body", F.lit(1)).withColumn("r", F.lit(2)).withColumn("metadata_id", F.lit("z")).withColumn("source", F.lit("q"))
    assert [tuple(r) for r in warc.derive(extra).collect()] == [tuple(r) for r in warc.derive(sent).collect()]
