"""Content-defined sampling of fixed-length windows, and where their content repeats.

Every window of a document (``length`` words or bytes) names one of its
``gram``-long pieces as its anchor: the one of smallest hash, leftmost on ties.
The choice depends on the window's content alone, so equal windows have equal
anchors at equal places, wherever they stand. Windows that share an anchor
occurrence are consecutive: a *run*. About two of ``length - gram`` positions
are anchors, so an index of runs is a small part of the corpus.

``settle_runs`` finds, with aggregates whose hot keys collapse before any
shuffle, the runs whose whole stretch occurs elsewhere (all their windows
repeat), the runs whose anchor is unique (none repeats), and the rest.
Names are pairs of 64-bit hashes, the anchor's and the stretch's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

#: Odd multipliers of the mixing steps (from the golden ratio and public mixers).
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HIGH, _LOW, _32, _29 = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(29)

RUN_SCHEMA = "d bigint, v bigint, p int, q int, m int, a bigint, s bigint"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _29)
    h *= _C3
    h ^= h >> _32
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in log2(width) passes."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def runs_of(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each run; a window has ``width`` grams."""
    key = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, width) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return first, last, at[first]


def byte_grams(buf: np.ndarray, power: int) -> np.ndarray:
    """Hash of every ``8 * 2**power`` bytes, named by doubling: a gram is the pair of its halves."""
    n = len(buf) - 7
    h = mix(np.ndarray((n,), "<u8", buffer=buf, strides=(1,)) * _C1)
    for k in range(power):
        half = 8 << k
        h = mix(h[:-half] * _C2 + h[half:])
    return h


def settle_runs(runs: DataFrame, shelf: Shelf) -> DataFrame:
    """Runs with a repeated anchor, with ``whole`` (the whole stretch occurs
    again) and ``lead`` (the first of the runs of one stretch)."""
    runs = shelf.keep(runs)
    # Aggregates are settled before they are joined: a join straight on an
    # aggregate reuses its exchange, and Spark cannot split a hot key there.
    again = shelf.keep(runs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    shared = shelf.keep(runs.join(again, "a"))
    shelf.drop(runs, again)
    names = shared.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "v", "p")).alias("first"))
    names = shelf.keep(names)
    told = shelf.keep(
        shared.join(names, ["a", "s"]).select(
            "d", "v", "p", "q", "m", "a", "s", (F.col("n") > 1).alias("whole"), (F.col("first") == F.struct("d", "v", "p")).alias("lead")
        )
    )
    shelf.drop(shared, names)
    return told


def open_runs(told: DataFrame) -> DataFrame:
    """Per document, the runs to look into window by window: those whose stretch
    is unique though the anchor is not, and one run of each repeated stretch
    that such a run may share windows with."""
    loose = told.where(~F.col("whole"))
    leads = told.where("whole and lead").join(loose.select("a").distinct(), "a", "left_semi")
    both = loose.select("d", "v", "p", "q", "m", "a", "whole").unionByName(leads.select("d", "v", "p", "q", "m", "a", "whole"))
    return both.groupBy("d", "v").agg(F.collect_set(F.struct("p", "q", "m", "a", "whole")).alias("runs"))


def merged(spans: list[dict] | None, length: int) -> np.ndarray:
    """Maximal ranges (start, end) that the windows of these runs cover."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pq = np.array([(u["p"], u["q"]) for u in spans], np.int64)
    pq = pq[np.argsort(pq[:, 0], kind="stable")]
    end = np.maximum.accumulate(pq[:, 0] + pq[:, 1] + length)
    head = np.flatnonzero(np.concatenate(([True], pq[1:, 0] > end[:-1])))
    return np.stack((pq[head, 0], end[np.concatenate((head[1:], [len(end)])) - 1]), 1)
