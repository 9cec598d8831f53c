"""The operators against brute force on small awkward corpora."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402
from sparkfolio.llm import packing, simhash, substring_rlz, suffix_doubling, token_counts  # noqa: E402
from sparkfolio.llm.queries import tokenizer_path  # noqa: E402

ROWS = corpora.awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return corpora.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts(docs, tokenizer):
    got = token_counts.count_tokens(docs, tokenizer_path(), limit=100).collect()
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in ROWS]
    assert corpora.ordered(got) == corpora.ordered((i, len((t or "").encode()), k, k > 100) for (i, t, *_), k in zip(ROWS, n))


def test_pieces_at_safe_boundaries(tokenizer):
    table = token_counts.Pieces(tokenizer_path())
    texts = ["", " ", "  a", "a  b", "a   b ", "a \n b", "x <|endoftext|> y", "a<|endoftext|>  b", "é  b　 c", "it's  'll we ", "\x1c a\x1c b", " lead", "tab\t b", "12 345  6", "a <b c> <|endoftext|>d\n e", "x\ny z\r w"]
    texts += [t for _, t, _ in ROWS if t]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in table.texts(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length", [6, 12, 35])
def test_substrings(docs, length):
    got = substring_rlz.dedup_substrings(docs, length=length).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.substrings(ROWS, length))


@pytest.mark.parametrize("length", [9, 50, 200, 400])
def test_bytes(docs, length):
    got = suffix_doubling.dedup_bytes(docs, length=length)
    got = got.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256))
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.byte_strings(ROWS, length))


def test_long_texts_go_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(substring_rlz, "PIECE", 50)
    monkeypatch.setattr(suffix_doubling, "PIECE", 300)
    docs = corpora.frame(spark, ROWS)
    got = substring_rlz.dedup_substrings(docs, length=12).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.substrings(ROWS, 12))
    got = suffix_doubling.dedup_bytes(docs, length=100).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256))
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.byte_strings(ROWS, 100))


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_near_duplicates(docs, radius):
    got = simhash.near_duplicates(docs, radius=radius).select("doc_id", "fingerprint", "component_id")
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.near(ROWS, 4, radius))


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rows = corpora.awkward(seed=5, n=150, vocabulary=30)
    got = simhash.near_duplicates(corpora.frame(spark, rows), radius=4).select("doc_id", "fingerprint", "component_id")
    assert corpora.ordered(got.collect()) == corpora.ordered(corpora.near(rows, 4, 4))


def test_masks_cover_the_radius():
    rng = np.random.default_rng(0)
    for radius in (1, 4):
        table = simhash.masks(radius, 0)
        for _ in range(300):
            diff = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & diff == 0 for m in table)


@pytest.mark.parametrize(("sequence", "window"), [(16, 64), (64, 64), (1024, 65536)])
def test_packing(docs, tokenizer, sequence, window):
    got = packing.pack(docs, tokenizer_path(), sequence=sequence, window=window).collect()
    ids = {}
    for i, t, _ in ROWS:
        x = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        ids.setdefault(i, []).append(x)
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(r.length for r in got) == total
    by_sequence = {}
    for r in got:
        x = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(x) == r.length > 0
        assert any(len(y) == r.doc_tokens and y[r.start : r.start + r.length] == x for y in ids[r.doc_id])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, pieces in by_sequence.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == sequence or s == max(by_sequence) and at <= sequence
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for i, xs in ids.items():
        assert sorted(covered[i]) == sorted(k for x in xs for k in range(len(x)))


def test_windows_hold_the_mixture():
    sizes = [70_000, 20_000, 9_000, 1_000]
    m = packing.Mixture(sizes, 1000)
    for w in range(100):
        for s, n in enumerate(sizes):
            assert abs(m.drawn(s, w + 1) - m.drawn(s, w) - n / 100) < 2


def test_empty_tables(spark):
    none = corpora.empty(spark)
    assert token_counts.count_tokens(none, tokenizer_path()).count() == 0
    assert substring_rlz.dedup_substrings(none).count() == 0
    assert suffix_doubling.dedup_bytes(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_carried_columns(docs):
    got = substring_rlz.dedup_substrings(docs, carry=("source", "d")).columns
    assert got[:3] == ["doc_id", "source", "d"]
    assert zlib.crc32(b"") == 0
