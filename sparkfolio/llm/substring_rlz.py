"""Exact substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into content-defined blocks: the
stretches of words that all windows of one anchor cover (``anchors``). Each
distinct block is indexed once, under its anchor. Where the anchor of a block
is indexed but its whole stretch is not, its windows are looked up one by one,
against each other and against the windows of one copy of each indexed block;
those found are blocks of one window. A document is then parsed greedily from
left to right: at a place that an indexed block covers, the factor is the rest
of the covering block that reaches farthest, a (block, offset, length); other
words are literals. Blocks are at least one window long, so factors and the
boundaries between them hide no repeated window: factors that touch become a
removal span.

Equality is by pairs of 64-bit hashes (anchor and block, or anchor and window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import RUN_SCHEMA, mix, open_runs, runs_of, settle_runs
from .common import Shelf, give_back, row_key, squeezed, unsqueeze

GRAM = 6
#: Words looked at together; longer texts go piece by piece, overlapping by a window.
PIECE = 200_000
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(x)]
    return _powers


def words_of(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one blank, and where each starts and ends."""
    joined = b" ".join(data.split())  # bytes.split() splits at exactly the six ASCII separators
    if not joined:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def word_grams(joined: bytes, starts: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive words."""
    lo, hi = starts[0], ends[-1]
    buf = np.frombuffer(joined, np.uint8)[lo:hi]
    power, inverse = _powers_to(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    a, b = starts[: len(starts) - gram + 1] - lo, ends[gram - 1 :] - lo
    return mix((total[b] - total[a]) * inverse[a])


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                if (text := batch.column(2)[i].as_py()) is None:
                    continue
                joined, starts, ends = words_of(text.encode())
                for k in range(0, len(starts) - length + 1, PIECE):
                    grams = word_grams(joined, starts[k : k + PIECE + length - 1], ends[k : k + PIECE + length - 1], GRAM)
                    first, last, at = runs_of(grams, length - GRAM + 1)
                    a, b = starts[first + k].tolist(), ends[last + k + length - 1].tolist()
                    names = np.array([xxhash.xxh3_64_intdigest(joined[x:y]) for x, y in zip(a, b)], np.uint64)
                    n = len(first)
                    for col, x in zip(out, (np.full(n, batch.column(0)[i].as_py()), np.full(n, batch.column(1)[i].as_py()), first + k, last - first, at + k, grams[at].view(np.int64), names.view(np.int64))):
                        col.append(x)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                cols = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "v", "p", "q", "m", "a", "s"])
        give_back()

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                joined, starts, ends = words_of(unsqueeze(r["text"]))
                for u in r["runs"]:
                    for p in range(u["p"], u["p"] + u["q"] + 1):
                        w = xxhash.xxh3_64_intdigest(joined[starts[p] : ends[p + length - 1]])
                        rows.append((r["d"], r["v"], p, u["a"], w - (1 << 64) if w >> 63 else w, u["whole"]))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "v", "p", "a", "w", "whole"])
        give_back()

    return run


def parse(blocks: list[dict] | None, length: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, block, offset) against the indexed blocks that stand in
    a document: ``blocks`` start at word p, hold q + 1 windows and are named s."""
    out, at = [], 0
    todo = sorted(((u["p"], u["p"] + u["q"] + length, u["s"]) for u in blocks or []), reverse=True)
    while todo:
        best = todo.pop()
        while todo and todo[-1][0] <= max(at, best[0]):  # all that cover the place; the one that reaches farthest
            best = max(best, todo.pop(), key=lambda u: u[1])
        if best[1] > at:
            start = max(at, best[0])
            out.append((start, best[1] - start, best[2], start - best[0]))
            at = best[1]
    return out


def _cut(length: int, names: list[str], as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, spans, told = [], [], [], [], []
            for i in range(batch.num_rows):
                data = unsqueeze(batch.column("text")[i].as_py())
                joined, starts, ends = words_of(data)
                n = len(starts)
                factors = parse(batch.column("blocks")[i].as_py(), length)
                step: list[list[int]] = []
                for a, m, *_ in factors:
                    if step and step[-1][1] == a:
                        step[-1][1] += m
                    else:
                        step.append([a, a + m])
                text = data if as_is else joined
                if step:
                    gone = np.zeros(n, bool)
                    for a, b in step:
                        gone[a:b] = True
                    stay = np.repeat(~gone, ends - starts + 1)[: len(joined)]
                    text = np.frombuffer(joined, np.uint8)[stay].tobytes().rstrip(b" ")
                counts.append(n)
                removed.append(sum(b - a for a, b in step))
                kept.append(text.decode())
                spans.append([{"start": a, "end": b} for a, b in step])
                told.append([dict(zip(("start", "length", "block", "offset"), x)) for x in factors])
            cols = [batch.column(x) for x in names] + [
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(told, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "block", "offset")]))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_removed", "kept_text", "removed_spans", "factors"])
        give_back()

    return run


def dedup_substrings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, as_is: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Remove every word that lies in a ``length``-word sequence that also starts elsewhere.

    Returns one row per input row: the id, the columns named in ``carry``,
    n_words, n_removed, kept_text (remaining words joined by one blank),
    removed_spans (maximal removed word ranges, end exclusive) and factors (start
    and length in words, the block's name and the offset there). With ``as_is``,
    the kept_text of a document that loses nothing is its text as it stands. The
    input is judged as it stands, whole, across and within documents.

    Null and empty texts have no words and an empty kept_text. A null id is
    kept. Repeated rows are copies of each other, so everything in them of a
    window or more goes. Empty tables give empty results. Other columns are
    neither read nor returned, so their names cannot clash; ``carry`` may not
    name a result column. A text of any length is looked at in pieces.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    shelf = Shelf(docs.sparkSession)
    text = F.col(text_col).alias("text")
    short = docs.select(*row_key(id_col, text_col), text)
    told = settle_runs(short.mapInArrow(_runs(length), RUN_SCHEMA), shelf)
    to_look = squeezed(short).join(open_runs(told), ["d", "v"])
    schema = "d bigint, v bigint, p int, a bigint, w bigint, whole boolean"
    windows = shelf.keep(to_look.mapInArrow(_windows(length), schema))
    twice = shelf.keep(windows.groupBy("a", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "w"))
    single = windows.where(~F.col("whole")).join(twice, ["a", "w"]).select("d", "v", "p", F.lit(0).alias("q"), F.col("w").alias("s"))
    blocks = shelf.keep(told.where("whole").select("d", "v", "p", "q", "s").unionByName(single))
    shelf.drop(told, windows, twice)
    by_doc = blocks.groupBy("d", "v").agg(F.collect_set(F.struct("p", "q", "s")).alias("blocks"))
    given = docs.select(*row_key(id_col, text_col), text, F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}, n_words bigint, n_removed bigint, kept_text string, removed_spans array<struct<start:bigint,end:bigint>>, factors array<struct<start:bigint,length:bigint,block:bigint,offset:bigint>>"
    out = squeezed(given).join(by_doc, ["d", "v"], "left").mapInArrow(_cut(length, names, as_is), schema)
    return out.withColumnsRenamed(dict(zip(names, [id_col, *carry])))
