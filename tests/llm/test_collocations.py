"""Collocations against brute force, in chunks of several sizes, and the query against SQL."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import parity  # noqa: E402
from sparkfolio.llm import collocations, queries  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, n string, a int, l int, word string, chunk int"


def brute(rows, longest, at_least, inside):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= at_least and len(p) > 1}
        for p, a in some.items():
            within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= inside * a and within(q) for q, b in some.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            yield lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score


def texts(seed=3, n=80):
    r = random.Random(seed)
    words = ["New", "york", "É", "é", "the", "of", "a\x1cb", "漢字", *[f"w{k}" for k in range(30)]]
    join = lambda ws: "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for w in ws)
    rows = [(r.choice(["en", "en", "en", "fr", None]), join([w for _ in range(r.randint(0, 60)) for w in r.choice([[r.choice(words)], ["new", "York", "city"], ["of", "the"]])])) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("de", " \t,."), ("xx", "alone"), *rows[:5], *rows[:3]]


@pytest.mark.parametrize(("chunk", "longest", "at_least", "keys", "sample"), [(1 << 23, 3, 10, 1 << 21, 512), (300, 3, 4, 100, 3), (50, 4, 3, 40, 1)])
def test_equals_brute_force(spark, monkeypatch, chunk, longest, at_least, keys, sample):
    for name, value in (("CHUNK", chunk), ("RANGE", keys), ("SAMPLE", sample)):
        monkeypatch.setattr(collocations, name, value)
    rows = texts()
    docs = spark.createDataFrame([(k, t, lang, "x", 1, 2, "w", 3) for k, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    got = collocations.collocations(docs, longest=longest, at_least=at_least)
    assert got.columns == ["lang", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, longest, at_least, 50))


@pytest.mark.parametrize("kind", ["<u4", "<u8"])
@pytest.mark.parametrize("columns", [2, 3, 5])
def test_runs_of_equal_keys(kind, columns):
    r = np.random.default_rng(1)
    keys, counts = r.integers(0, 3, (500, columns)).astype(kind), r.integers(1, 9, 500)
    got, sums = collocations._summed(keys, counts)
    want = Counter()
    for k, c in zip(map(tuple, keys.tolist()), counts.tolist()):
        want[k] += c
    assert list(zip(map(tuple, got.tolist()), sums.tolist())) == sorted(want.items())
    assert (collocations._unpress(collocations._press(got.astype(kind.replace("<", ">"))), kind.replace("<", ">"), columns) == got).all()


def test_top_of_each_language(spark):
    rows = texts(seed=4)
    docs = spark.createDataFrame([(k, t, lang, "x", 1, 2, "w", 3) for k, (lang, t) in enumerate(rows)], DOCS)
    got = sorted((r.lang, r.rank, r.phrase) for r in collocations.collocations(docs, at_least=3, top=7).collect())
    by_lang = defaultdict(list)
    for lang, phrase, a, *_, score in brute(rows, 3, 3, 50):
        by_lang[lang].append((-score, -a, phrase.encode(), phrase))
    assert got == [(lang, k + 1, x[-1]) for lang in sorted(by_lang) for k, x in enumerate(sorted(by_lang[lang])[:7])]


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "rare words only", "en", "", 1, 2, "", 3)], DOCS), top=5).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert parity.differences(queries.op13_collocations(spark, sf), queries.ORACLE_SQL["op13_collocations"], sf) is None
