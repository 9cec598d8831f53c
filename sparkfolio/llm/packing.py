"""Mixture-controlled packing by deficit round-robin over source queues.

Documents queue by source. Every window of ``window`` tokens takes from each
queue its share of the mixture; what whole tokens leave over is carried as a
deficit into the next window, across partitions too. With P(s) the cumulative
share of the queues up to s, the queues up to s have given floor(w * window *
P(s)) tokens after w windows, so each window is filled exactly, no queue is
ever a token ahead or behind by more than one, and the place of any token
follows from its place in its queue alone. Places in a queue come from a
two-level running sum (within a partition, then over partitions), so nothing
is collected and no task sees a whole source.

Without weights the target proportions are the sources' own shares, and no
source runs dry before another. With weights, a source that is used up leaves
the others to share its part by their weights: the mixture is then one phase
for every source that runs dry, each filled as above.

Within a window the queues' parts stand one behind another; each window is cut
into sequences of ``sequence`` tokens. Only the last sequence of the corpus can
be short, so padding is less than one sequence.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Shelf, give_back
from .token_counts import encoded, ids_bytes

#: Most bases (partitions times queues) that a join may broadcast.
SMALL_TABLE = 200_000


def _tokens(path: str, names: list[str], end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, behind = TaskContext.get().partitionId(), {}
        tail = ids_bytes([end])
        for batch in batches:
            sizes, places, ids = [], [], []
            for i, x in enumerate(encoded(path, batch.column("text"))):
                x += tail
                source, n = batch.column("queue")[i].as_py(), len(x) // 4
                places.append(behind.get(source, 0))
                behind[source] = places[-1] + n
                sizes.append(n)
                ids.append(x)
            cols = [*[batch.column(c) for c in [*names, "queue"]], pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "queue", "part", "place", "n", "ids"])
        give_back()

    return run


class Mixture:
    """Where queue tokens go. ``sizes``: tokens of each queue, in queue order."""

    def __init__(self, sizes: list[int], window: int):
        self.total, self.window = sum(sizes), window
        self.upto = [0]
        for n in sizes:
            self.upto.append(self.upto[-1] + n)

    def given(self, s: int, w: int) -> int:
        """Tokens that the queues before ``s`` have given after ``w`` windows."""
        return min(w * self.window, self.total) * self.upto[s] // self.total

    def drawn(self, s: int, w: int) -> int:
        return self.given(s + 1, w) - self.given(s, w)

    def window_of(self, s: int, x: int) -> int:
        """The window that takes token ``x`` of queue ``s``."""
        w = x * self.total // ((self.upto[s + 1] - self.upto[s]) * self.window)
        while self.drawn(s, w) > x:
            w -= 1
        while self.drawn(s, w + 1) <= x:
            w += 1
        return w

    def pieces(self, s: int, x: int, n: int, sequence: int, base: int = 0) -> Iterator[tuple[int, int, int]]:
        """Start in the document, length and place in the corpus of each piece of
        the ``n`` tokens that stand at ``x`` in queue ``s``; the mixture starts at place ``base``."""
        at, w = 0, self.window_of(s, x)
        while at < n:
            first, end = self.drawn(s, w), self.drawn(s, w + 1)
            place = base + w * self.window + self.given(s, w + 1) - self.given(s, w) + x + at - first
            size = min(n - at, end - x - at, sequence - place % sequence)
            if size > 0:
                yield at, size, place
                at += size
            if x + at >= end:
                w += 1


def phases(sizes: list[int], weights: list[float] | None) -> list[list[int]]:
    """Tokens that each queue gives in each phase; a phase ends when a queue runs dry.
    Queues without weight come last, by their sizes."""
    if weights is None:
        return [sizes] if sum(sizes) else []
    left, out = list(sizes), []
    share = [Fraction(str(w)) for w in weights]
    while any(left):
        active = [s for s, n in enumerate(left) if n and share[s]]
        if not active:
            out.append(list(left))
            break
        total = sum(share[s] for s in active)
        least = min(active, key=lambda s: left[s] / share[s])
        span = left[least] * total / share[least]
        take = [min(n, int(span * share[s] / total)) if s in active else 0 for s, n in enumerate(left)]
        take[least] = left[least]
        out.append(take)
        left = [n - t for n, t in zip(left, take)]
    return out


class Schedule:
    """Where queue tokens go over all phases."""

    def __init__(self, sizes: list[int], window: int, weights: list[float] | None = None):
        self.parts: list[tuple[int, Mixture]] = []
        self.starts: list[list[int]] = [[] for _ in sizes]  # by queue: where in it each phase starts
        at, given = 0, [0] * len(sizes)
        for take in phases(sizes, weights):
            least = min(n for n in take if n)
            wide = window * -(-sum(take) // (least * window)) if weights is not None else window  # a token a window at least
            self.parts.append((at, Mixture(take, wide)))
            for s, n in enumerate(take):
                self.starts[s].append(given[s])
                given[s] += n
            at += sum(take)

    def pieces(self, s: int, x: int, n: int, sequence: int) -> Iterator[tuple[int, int, int]]:
        at = 0
        while at < n:
            k = bisect_right(self.starts[s], x + at) - 1
            end = self.starts[s][k + 1] if k + 1 < len(self.starts[s]) else x + n
            size = min(n - at, end - x - at)
            base, mixture = self.parts[k]
            for a, m, place in mixture.pieces(s, x + at - self.starts[s][k], size, sequence, base):
                yield at + a, m, place
            at += size


def _pack(sizes: list[int], weights: list[float] | None, window: int, sequence: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Schedule(sizes, window, weights)
        for batch in batches:
            rows, take = [], []
            for i in range(batch.num_rows):
                s, x, n = (batch.column(c)[i].as_py() for c in ("slot", "place", "n"))
                ids = memoryview(batch.column("ids")[i].as_buffer())
                for start, size, place in mixture.pieces(s, x, n, sequence):
                    rows.append((start, size, n, place // sequence, place % sequence, ids[4 * start : 4 * (start + size)].tobytes()))
                    take.append(i)
            cols = list(zip(*rows)) or [[]] * 6
            kept = [batch.column(c).take(pa.array(take, pa.int64())) for c in names]
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*names, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sequence: int = 1024,
    window: int = 64 * 1024,
    end_id: int = 0,
    weights: dict[str, float] | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Pack all documents into sequences of at most ``sequence`` tokens.

    Every window of ``window`` tokens holds the sources in proportion to
    ``weights`` (by source; others have none and come last), or to their own
    shares of all tokens if there are none. When a source runs dry, the others
    keep their proportions among themselves. Returns one row per piece: the id, the
    columns named in ``carry``, start and length in the document's ids,
    doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).
    A document's ids are those of the tokenizers file at ``path`` without added
    special tokens, then ``end_id``. Pieces of a sequence lie side by side from
    offset 0; every sequence but the last is full.

    Null and empty texts are one ``end_id``. Null sources are a queue of their
    own, with the weight of "". Without weights, sources with less than one token
    a window share a queue, the largest source's if even they together have less;
    with weights, windows widen until each source has a token in them. Null ids and repeated rows are packed like any others; an
    empty table gives an empty result. Other columns are not read, so their
    names cannot clash; ``carry`` may not name a result column. The number of
    sources, not of documents, bounds what the driver sees.
    """
    if window % sequence:
        raise ValueError("window must hold whole sequences")
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession)
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
        F.col(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("queue"),
    )
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    tokens = shelf.keep(given.mapInArrow(_tokens(path, names, end_id), f"{kinds}, queue string, part int, place bigint, n bigint, ids binary"))
    sums = tokens.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    totals = sorted((r["queue"], r["m"]) for r in sums.groupBy("queue").agg(F.sum("m").alias("m")).collect())
    total = sum(m for _, m in totals)
    main = max(totals, key=lambda x: x[1])[0] if totals else ""
    tail = {q for q, m in totals if q != main and m * window < total} if weights is None else set()
    if not tail or sum(m for q, m in totals if q in tail) * window < total:
        merged_into, own = dict.fromkeys(tail, main), [q for q, _ in totals if q not in tail]
    else:
        merged_into, own = dict.fromkeys(tail, min(tail)), [q for q, _ in totals if q not in tail or q == min(tail)]
    slot = {q: own.index(merged_into.get(q, q)) for q, _ in totals}
    sizes = [0] * len(own)
    for q, m in totals:
        sizes[slot[q]] += m
    shares = None if weights is None else [weights.get(q[1:], 0) for q in own]
    slots = spark.createDataFrame([*slot.items()] or [("", 0)], "queue string, slot int")
    slots = F.broadcast(slots) if len(slot) <= SMALL_TABLE else slots
    before = W.partitionBy("slot").orderBy("queue", "part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.join(slots, "queue").select("queue", "part", "slot", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    bases = shelf.keep(bases)
    if bases.count() <= SMALL_TABLE:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).withColumn("place", F.col("place") + F.col("base"))
    schema = f"{kinds}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return placed.mapInArrow(_pack(sizes, shares, window, sequence, names), schema).withColumnsRenamed(dict(zip(names, [id_col, *carry])))
