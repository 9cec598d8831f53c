"""The pipeline's near-copy stage against brute force over all pairs of texts."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
import corpora  # noqa: E402
import corpus_pipeline as p  # noqa: E402
from sparkfolio.llm import alike, simhash  # noqa: E402

SF, RADIUS = "/root/testdata/sf0.001", 6


def edited(wanted):
    """Two texts of 300 words whose similarity and differing SimHash bits are as wanted."""
    for seed in range(2000):
        r = random.Random(seed)
        a = [f"w{r.randrange(10**6)}" for _ in range(300)]
        b = list(a)
        for _ in range(r.randint(1, 12)):
            b[r.randrange(300)] = f"w{r.randrange(10**6)}"
        x, y = " ".join(a), " ".join(b)
        if wanted(corpora.alike(x, y, 5, 0.8), (corpora.simhash(x, 5) ^ corpora.simhash(y, 5)).bit_count()):
            return x, y
    raise AssertionError("no such texts")


def kept_ids(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 7, 8, "x", "y") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, d int, u int, set_key string, f0 string").repartition(3)
    return sorted((r.doc_id is None, r.doc_id or 0) for r in p.near_copies(spark, docs, SF).select("doc_id").collect())


def first_of_alike(texts):
    """Ids that stay: in order of ids, a text goes if one that stays is alike."""
    out = []
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        if not any(corpora.alike(t or "", u or "", 5, 0.8) for _, u in out):
            out.append((i, t))
    return sorted((i is None, i or 0) for i, _ in out)


def test_copies_under_an_unlike_leader(spark):
    lead, other = edited(lambda same, bits: not same and bits <= RADIUS)
    near = " ".join([*other.split()[:-2], "new", "end"])
    texts = [(1, lead), (2, other), (3, other), (4, near), (5, other.upper())]
    assert kept_ids(spark, texts) == first_of_alike(texts) == [(False, 1), (False, 2)]


def test_copies_at_many_bits(spark):
    texts = []
    for k in range(8):
        a, b = (t.replace("w", "v" * (k + 1)) for t in edited(lambda same, bits: same and bits > RADIUS + 1 + k % 4))
        texts += [(10 * k, a), (10 * k + 1, b)]
    texts += [(i + 1000, t) for i, t, _ in corpora.awkward(seed=9) if i is not None and i != 3]
    assert kept_ids(spark, texts) == first_of_alike(list({i: (i, t) for i, t in texts}.values()))


def family(n=40, words=120):
    """Texts that descend from each other by few edits: long components of alike and unlike texts."""
    r = random.Random(7)
    out = [[f"w{r.randrange(10**6)}" for _ in range(words)]]
    for _ in range(n):
        out.append([f"w{r.randrange(10**6)}" if r.random() < 0.01 else w for w in out[-1 if r.random() < 0.7 else 0]])
    return [(i, " ".join(w)) for i, w in enumerate(r.sample(out, len(out)))]


@pytest.mark.parametrize("limits", [{}, {"FEW": 2}, {"BUCKET": 8, "FEW": 4}, {"COMPONENT": 6}, {"BUCKET": 5, "FEW": 3, "HOT": 3, "COMPONENT": 9}])
def test_limits_do_not_change_the_result(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(alike, k, v)
    if "HOT" in limits:
        monkeypatch.setattr(alike, "SPREAD", 400)
    texts = family()
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = alike.without_copies(docs)
    assert got.columns == ["doc_id", "text"]
    assert sorted((False, r.doc_id) for r in got.collect()) == first_of_alike(texts)


def test_odd_rows(spark):
    rows = corpora.awkward(seed=4)
    docs = corpora.frame(spark, rows)
    got = alike.without_copies(docs)
    assert got.columns == docs.columns and alike.without_copies(docs.limit(0)).count() == 0
    sets = {}
    for i, t, _ in rows:
        key = alike.hashes(t, 5).tobytes()
        sets[key] = min(sets.get(key, (True, 0)), (i is None, i or 0))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert set(kept) <= set(sets.values()) and len(kept) == len(first_of_alike(list({alike.hashes(t, 5).tobytes(): (i, t) for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, -(x[0] or 0)))}.values())))


@pytest.mark.parametrize("width", [32, 40, 48, 56])
def test_tables_cover_the_radius(width):
    rng, radius = np.random.default_rng(1), 4 * (width // 8 + 1) - 1
    masks = np.array(alike.tables(width)).view(np.uint64)
    for _ in range(200):
        diff = np.zeros(64 * masks.shape[1], np.uint8)
        diff[rng.choice(4 * width, radius, replace=False)] = 1
        diff = np.packbits(diff, bitorder="little").view(np.uint64)
        assert ((masks & diff) == 0).all(1).any()
    assert np.bitwise_count(masks).sum(1).min() >= width // 2 - 8


@pytest.mark.parametrize("radius", range(1, 9))
def test_no_mask_is_nearly_empty(radius):
    table = simhash.masks(radius, 0)
    assert len(table) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in table) >= 16
