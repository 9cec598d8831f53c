"""Byte-level BPE against the tokenizer library, and round trips."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402
from sparkfolio.llm import byte_bpe, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "it's  'LL we'll 12 345x  \n\n a\tb \x1c c\x85d e　f",
    "a\0b \0\0 c",
    "<|endoftext|> <|im_start|>",
    "x" * 5000 + "ab" * 700 + " " * 300 + "!?" * 200,
    "漢字かな交じり文、１２３。" * 40,
    "\U0001f600\U0001f468‍\U0001f469 é ՘ ꟎1 \U00016ea0a\U00016ff4",
    "\r\n\r\n  x\n y z",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def rows_of():
    rows = corpora.awkward()
    return rows + [(1000 + k, t, "odd") for k, t in enumerate(ODD)]


def expected(rows, library):
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        yield i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()


@pytest.mark.parametrize("table", [400_000, 40])
def test_encode_and_decode(spark, library, monkeypatch, table):
    monkeypatch.setattr(byte_bpe, "TABLE", table)
    monkeypatch.setattr(byte_bpe, "GROUP", 3000)
    monkeypatch.setattr(byte_bpe, "IDS", 100)
    rows = rows_of()
    docs = corpora.frame(spark, rows)
    out = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect()]
    assert corpora.ordered(got) == corpora.ordered(expected(rows, library))


def test_long_words_merge_alike():
    ranks = byte_bpe.ranks_of(PATH)
    word = [ranks[bytes([b])] for b in ("Étion " * 20 + "a" * 90 + "ab漢" * 30).encode()]
    ids = [*word]
    token = {r: t for t, r in ranks.items()}
    while True:
        pairs = [(ranks[token[a] + token[b]], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if token[a] + token[b] in ranks]
        if not pairs:
            break
        rank, k = min(pairs)
        ids[k : k + 2] = [rank]
    assert byte_bpe.merge_long(word, ranks) == ids


def test_empty_table_and_carried_columns(spark):
    assert byte_bpe.decode(byte_bpe.encode(corpora.empty(spark), PATH, public_tokenizers.PATTERN), PATH).count() == 0
    docs = corpora.frame(spark, corpora.awkward()[:3])
    assert byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, carry=("source", "d")).columns == ["doc_id", "source", "d", "n_tokens", "ids"]


def test_unknown_ids_are_an_error(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([50_300], "<u4").tobytes())), (2, None)], "doc_id bigint, ids binary")
    assert byte_bpe.decode(bad.where("doc_id = 2"), PATH).first().decoded is None
    with pytest.raises(Exception, match="not in the rank file"):
        byte_bpe.decode(bad, PATH).collect()


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, n, digest(ids), digest(text)) for i, n, ids, text in expected([(r.doc_id, r.text, None) for r in texts], library)]
    assert corpora.ordered(queries.op12_byte_bpe(spark, sf).collect()) == corpora.ordered(want)


@pytest.mark.parametrize("table", [400_000, 40])
def test_one_pass_with_words_in_bounded_rows(spark, library, monkeypatch, table):
    monkeypatch.setattr(byte_bpe, "TABLE", table)
    monkeypatch.setattr(byte_bpe, "GROUP", 3000)
    monkeypatch.setattr(byte_bpe, "ROW", 7)
    rows = rows_of()
    out = byte_bpe.encode(corpora.frame(spark, rows), PATH, public_tokenizers.PATTERN, decoded=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect()]
    assert corpora.ordered(got) == corpora.ordered(expected(rows, library))


def test_the_query_has_two_python_steps(spark):
    plan = queries.op12_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
