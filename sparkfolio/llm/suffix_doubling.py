"""Exact removal of repeated byte strings by doubling ranks on a sampled suffix set.

Prefix doubling over every byte position would sort as many (position, rank)
pairs as the corpus has bytes, in every round. Here only positions of a
content-defined sample take part: the anchors of ``anchors``, which equal
windows choose alike. A gram's name is the pair of its halves' names (8, 16,
32, ... bytes); Spark groups positions by that first rank and unique ones leave.
Those left are reranked over growing stretches around the anchor: windows are
taken together by 64, 16, 4 and 1 neighbouring offsets, whose common core grows
to ``length`` bytes. A core that is unique ends all its windows, a stretch
that occurs again settles all its windows as repeated, and what is neither is
cut into smaller sets of offsets for the next, longer, rank.

Ranks are names by content: tuples of anchor hash, offset set and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import RUN_SCHEMA, byte_grams, merged, open_runs, runs_of, settle_runs
from .common import Shelf, give_back, row_key, squeezed, unsqueeze

#: Window starts looked at together; longer texts go piece by piece.
PIECE = 1 << 20


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(length: int, power: int):
    gram = 8 << power

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                data = (batch.column(2)[i].as_py() or "").encode()
                d, v = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for k in range(0, len(data) - length + 1, PIECE):
                    piece = np.frombuffer(data, np.uint8)[k : k + PIECE + length - 1]
                    grams = byte_grams(piece, power)
                    first, last, at = runs_of(grams, length - gram + 1)
                    names = [xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip((first + k).tolist(), (last + k).tolist())]
                    n = len(first)
                    for col, x in zip(out, (np.full(n, d), np.full(n, v), first + k, last - first, at + k, grams[at].view(np.int64), np.array(names, np.uint64).view(np.int64))):
                        col.append(x)
            if out[0]:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                cols = [pa.array(np.concatenate(c).astype(t.to_pandas_dtype()), t) for c, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "v", "p", "q", "m", "a", "s"])
        give_back()

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = unsqueeze(r["text"])
                rows += [(r["d"], r["v"], u["p"], u["q"], u["m"], u["a"], data[u["p"] : u["p"] + u["q"] + length]) for u in r["runs"]]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "v", "p", "q", "m", "a", "ctx"])
        give_back()

    return run


def _ranks(length: int, size: int, wider: int):
    """Rows of (offset set, core, stretch) of ``size`` offsets, inside the sets
    of ``wider`` offsets listed in ``sets``, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                p, q, m, ctx = r["p"], r["q"], r["m"], r["ctx"]
                low, high = m - p - q, m - p  # offsets of this run's windows
                sets = range(low // size, high // size + 1) if wider == 0 else sorted({i for w in r["sets"] for i in range(w * wider // size, (w + 1) * wider // size)})
                for i in sets:
                    a, b = max(low, i * size), min(high, (i + 1) * size - 1)
                    if a > b:
                        continue
                    core = ctx[m - i * size - p : m - (i + 1) * size + 1 + length - p]
                    x, y = m - b, m - a  # first and last start
                    span = ctx[x - p : y - p + length]
                    rows.append((r["d"], r["v"], p, i, x, y - x, r["a"], _signed(xxhash.xxh3_64_intdigest(core)), _signed(xxhash.xxh3_64_intdigest(span))))
            cols = list(zip(*rows)) or [[]] * 9
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "v", "p", "i", "x", "q", "a", "core", "span"])
        give_back()

    return run


def _cut(length: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept, spans = [], [], [], []
            for i in range(batch.num_rows):
                data = unsqueeze(batch.column("text")[i].as_py())
                step = merged(batch.column("spans")[i].as_py(), length).tolist()
                inner = [(0, 0), *step, (len(data), len(data))]
                counts.append(len(data))
                removed.append(sum(b - a for a, b in step))
                kept.append(b"".join(data[a[1] : b[0]] for a, b in zip(inner, inner[1:])))
                spans.append([{"start": a, "end": b} for a, b in step])
            cols = [batch.column(x) for x in names] + [
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "n_removed", "kept_bytes", "removed_spans"])
        give_back()

    return run


def dedup_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Remove every byte that lies in a ``length``-byte string that also starts elsewhere.

    Returns one row per input row: the id, the columns named in ``carry``,
    n_bytes, n_removed, kept_bytes and removed_spans (maximal removed byte
    ranges, end exclusive). Texts count as UTF-8 and are judged as they stand,
    whole, across and within documents; matches never cross documents.

    Null and empty texts have no bytes. A null id is kept. Repeated rows are
    copies of each other. Empty tables give empty results. Other columns are
    neither read nor returned, so their names cannot clash; ``carry`` may not
    name a result column. kept_bytes need not be valid UTF-8, as a cut may fall
    inside a character.
    """
    if length < 9:
        raise ValueError("length must be at least 9")
    power = max(k for k in range(20) if k == 0 or 8 << k <= length // 5)
    width = length - (8 << power) + 1
    sizes = [4**k for k in range(4) if k == 0 or 4**k <= width // 4][::-1]
    shelf = Shelf(docs.sparkSession)
    text = F.col(text_col).alias("text")
    short = docs.select(*row_key(id_col, text_col), text)
    told = settle_runs(short.mapInArrow(_runs(length, power), RUN_SCHEMA), shelf)
    schema = "d bigint, v bigint, p int, q int, m int, a bigint, ctx binary"
    contexts = shelf.keep(squeezed(short).join(open_runs(told), ["d", "v"]).mapInArrow(_contexts(length), schema))
    spans = told.where("whole").select("d", "v", "p", "q")
    alive, wider, used = contexts, 0, []
    for size in sizes:
        ranked = shelf.keep(alive.mapInArrow(_ranks(length, size, wider), "d bigint, v bigint, p int, i int, x int, q int, a bigint, core bigint, span bigint"))
        cores = ranked.groupBy("a", "i", "core").agg((F.min("span") != F.max("span")).alias("mixed"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        cores = shelf.keep(cores)
        names = ranked.groupBy("a", "i", "core", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "v", "p")).alias("first"))
        names = shelf.keep(names)
        told_now = shelf.keep(ranked.join(cores, ["a", "i", "core"]).join(names, ["a", "i", "core", "span"]).select("d", "v", "p", "i", "x", "q", "mixed", "n", "first"))
        shelf.drop(ranked, cores, names)
        used.append(told_now)
        spans = spans.unionByName(told_now.where("n > 1").select("d", "v", F.col("x").alias("p"), "q"))
        left = told_now.where(F.col("mixed") & ((F.col("n") == 1) | (F.col("first") == F.struct("d", "v", "p"))))
        alive = contexts.join(left.groupBy("d", "v", "p").agg(F.collect_set("i").alias("sets")), ["d", "v", "p"])
        wider = size
    spans = shelf.keep(spans)
    shelf.drop(told, contexts, *used)
    by_doc = spans.groupBy("d", "v").agg(F.collect_set(F.struct("p", "q")).alias("spans"))
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(*row_key(id_col, text_col), text, F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}, n_bytes bigint, n_removed bigint, kept_bytes binary, removed_spans array<struct<start:bigint,end:bigint>>"
    out = squeezed(given).join(by_doc, ["d", "v"], "left").mapInArrow(_cut(length, names), schema)
    return out.withColumnsRenamed(dict(zip(names, [id_col, *carry])))
