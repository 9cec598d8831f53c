"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each of the 64 bit positions is given a non-zero vector of ``radius + 1`` bits,
such that every mask fixes many bits. For every non-zero vector v, a table keeps the
positions whose vector has an odd product with v. At most ``radius`` differing
positions span less than the whole space, so some v is orthogonal to all of
them: that table's mask skips every difference and the pair collides there.
With radius 4 that is 31 tables of about 33 fixed bits.

Buckets of up to ``BUCKET`` distinct fingerprints are searched inside a task,
which finds a spanning forest of links and holds no pairs. A larger bucket is
dealt out again by the 31 masks of another vector assignment, which fixes about
half of the bits left free, until all are small: a link inside it collides
there too. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf
from .substring_rlz import words_of

BITS, BUCKET = 64, 4096
#: Vector choices of which the masks are the best, and exploded rows a task.
CHOICES, SPREAD = 32, 1 << 20


def fingerprint(data: bytes, shingle: int) -> int:
    """SimHash of a text's word shingles, A-Z lower-cased; 0 without words."""
    joined, starts, ends = words_of(data.lower())
    n = len(starts)
    if not n:
        return 0
    k = min(shingle, n)
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h)))


@cache
def cover(bits: int, radius: int, level: int) -> list[int]:
    """One mask of fixed bits per non-zero vector of ``radius + 1`` bits, over ``bits`` positions.

    Positions get vectors at random, none again before all were given. Of some
    such choices, made from ``level``, that with the fullest emptiest mask is
    taken, as a mask of few bits has buckets of very many fingerprints.
    """
    top, best = 1 << (radius + 1), None
    for k in range(CHOICES):
        rng, vectors = random.Random(level * CHOICES + k + 1), []
        while len(vectors) < bits:
            vectors += rng.sample(range(1, top), top - 1)
        at = np.array(vectors[:bits])
        odd = np.bitwise_count(np.arange(1, top)[:, None] & at[None]) % 2 == 1
        if best is None or odd.sum(1).min() > best.sum(1).min():
            best = odd
    return [sum(1 << i for i in np.flatnonzero(row).tolist()) for row in best]


def masks(radius: int, level: int) -> list[int]:
    return cover(BITS, radius, level)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    """Spanning links of each bucket; rows come sorted by bucket."""

    def forest(f: np.ndarray) -> Iterator[tuple[int, int]]:
        left = f
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                u = todo.pop()
                near = np.bitwise_count(left ^ u) <= radius
                if near.any():
                    new = left[near]
                    todo += [*new]
                    left = left[~near]
                    yield from ((int(u), int(v)) for v in new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = None, np.zeros(0, np.uint64)

        def told(groups: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.array([x for g in groups if len(g) > 1 for x in forest(g)], np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, f = np.array(batch.column("bucket")), np.array(batch.column("fp")).view(np.uint64)
            cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
            groups = np.split(f, cuts)
            if held_t == t[0]:
                groups[0] = np.concatenate((held_f, groups[0]))
            elif len(held_f):
                groups.insert(0, held_f)
            held_t, held_f = t[-1], groups.pop()
            if groups:
                yield told(groups)
        if len(held_f):
            yield told([held_f])

    return run


def link_fingerprints(fingerprints: DataFrame, shelf: Shelf, radius: int) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs of distinct
    fingerprints ``fp`` that differ in at most ``radius`` bits."""
    links, level = None, 0
    todo = fingerprints.select("fp", F.lit(0).cast("bigint").alias("bucket"))
    while True:
        fixed = masks(radius, level)
        tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(signed(m)).cast("bigint").alias("m")) for k, m in enumerate(fixed)])
        spread = todo.repartition(1 + todo.count() * len(fixed) // SPREAD).select("fp", "bucket", F.explode(tables).alias("t")).select(
            "fp", F.xxhash64("bucket", F.lit(level), "t.k", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket")
        )
        sizes = shelf.keep(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # settled, so that a hot bucket can be split
        dealt = shelf.keep(spread.join(sizes, "bucket"))
        shelf.drop(sizes)
        small = dealt.where(F.col("n") <= BUCKET).select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
        found = shelf.keep(small.mapInArrow(_links(radius), "a bigint, b bigint").distinct())
        links = found if links is None else links.unionByName(found)
        todo, level = dealt.where(F.col("n") > BUCKET).select("fp", "bucket"), level + 1
        if todo.isEmpty():
            return links.distinct()


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is its component's smallest node.

    Large-star hangs each node's larger neighbours on its smallest neighbour,
    small-star the smaller ones and itself; a fixed point is a star for each
    component. Smallest neighbours are aggregates, so a node with very many
    neighbours is combined before it is shuffled.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = shelf.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Smallest neighbours are settled before they are joined, so that Spark can split a node of very many neighbours.
        least = shelf.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shelf.keep(large)
        shelf.drop(least)
        least = shelf.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = shelf.keep(small)
        shelf.drop(edges, large, least)
        edges, now = after, state(after)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, carry: tuple[str, ...] = ()
) -> DataFrame:
    """SimHash fingerprints and the components of those within ``radius`` bits.

    Returns one row per input row: the id, the columns named in ``carry``,
    fp (bigint, the 64 bits), fingerprint (16 lowercase hex digits),
    component_id, the smallest id reachable over links, its own included, and
    root, the smallest fp of the component.

    Null, empty and blank texts have fingerprint zero and link like any other.
    A null id is never a component's smallest unless all its ids are null (then
    component_id is null). Repeated rows share their fingerprint. Empty tables
    give empty results. Other columns are not read, so their names cannot
    clash; ``carry`` may not name a result column.
    """
    shelf = Shelf(docs.sparkSession)
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint((batch.column("text")[i].as_py() or "").encode(), shingle)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(fps, pa.int64())], names=[*names, "fp"])

    told = shelf.keep(given.mapInArrow(prints, f"{kinds}, fp bigint"))
    least = shelf.keep(told.groupBy("fp").agg(F.min("_id").alias("low")))
    stars = components(link_fingerprints(least, shelf, radius), shelf)
    roots = least.join(stars, least["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = roots.join(lows, "root").select("fp", "root", "component_id")
    out = told.join(of_print, "fp").select(*names, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")
    return out.withColumnsRenamed(dict(zip(names, [id_col, *carry])))
