"""The trie of conversations: a Cartesian tree over the longest common prefixes of sorted conversations.

Conversations are rows of turn digests, sorted as such; a range partition is a
block. Neighbours share a prefix of lcp turns. Every node of the trie is opened
by its first conversation in the order, at a depth over the lcp there, and
ends before the next smaller lcp: nodes are the intervals of all nearest
smaller values. In a block a stack finds them; nodes of one opener and one end,
a chain of depths, are one segment. Across blocks, the lcps that are minima of
the rest of their block tell which nodes are open at its end: the driver folds
these minima, a short list a block, and the turns at the borders into the path
that each block starts with. A node that lies in several blocks is added up
from a row for each of them; at last segments are expanded to all their depths.

Members that end at a node are its first ones in the order, with ids rising, so
their digest is taken along runs, over blocks in order where a run spans some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

#: Bytes of a turn's digest; rows that a join may broadcast.
DIGEST, SMALL_TABLE = 16, 500_000

_ROWS = "block bigint, pos bigint, conv_id bigint, lcp bigint, sums array<bigint>, first binary, last binary, minima array<array<bigint>>"
_NODE = "ob bigint, op bigint, depth bigint, pb bigint, pp bigint, whole boolean, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, block bigint, ids binary"
_NO_IDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: ``conv_id`` and ``steps``, an array of (key, bytes) in the order of turns.

    ``key`` is the MD5 digest of role and text, ``bytes`` the text's UTF-8 length. Null turns come first; equal
    ones are ordered by role, then digest. A null role or text is empty. Rows without a conversation belong to
    none and are left out. Repeated rows are turns of their own. A conversation's digests, not its texts, form a row.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text))
    step = F.struct(F.col(turn_col).isNotNull().alias("some"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("bigint").alias("bytes"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), step.alias("step"))
    steps = F.transform(F.array_sort(F.collect_list("step")), lambda x: F.struct(F.unhex(x["key"]).alias("key"), x["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(steps.alias("steps"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two conversations share at their start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * DIGEST).reshape(n, DIGEST) for s in (a, b))
    return int(np.argmax((x != y).any(1)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block with their lcp (the first has none yet), then one with its borders and the minima of its rests."""
    block, pos, last, first, minima = TaskContext.get().partitionId(), 0, None, None, []
    names = ["block", "pos", "conv_id", "lcp", "sums", "first", "last", "minima"]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
    for batch in batches:
        keys, lcps, n = batch.column("key").to_pylist(), [], batch.num_rows
        sizes, count = np.array(batch.column("sizes").flatten(), np.int64), np.array(pc.list_value_length(batch.column("sizes")), np.int64)
        total, before = np.append(0, np.cumsum(sizes)), np.cumsum(count) - count
        # Bytes of each conversation's first 0, 1, 2, ... texts.
        inner = np.repeat(before - np.cumsum(count + 1) + count + 1, count + 1) + np.arange(len(sizes) + n)
        sums = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count + 1)), pa.int32()), pa.array(total[inner] - np.repeat(total[before], count + 1)))
        for key in keys:
            lcp = -1 if last is None else _shared(last, key)
            first = key if first is None else first
            while minima and minima[-1][0] >= lcp:
                minima.pop()
            minima.append([lcp, pos])
            lcps.append(lcp)
            last, pos = key, pos + 1
        at = np.arange(pos - n, pos)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(at), batch.column("conv_id"), pa.array(lcps, pa.int64()), sums, *[pa.nulls(n, k) for k in kinds[5:]]], names=names
        )
    if first is not None:
        values = [[block], [None], [None], [None], [None], [first], [last], [minima]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)


def _paths(borders: list) -> dict[int, tuple[int, list, int]]:
    """For each block the lcp of its first row, the segments (depth up to, block, place) open there and the lcp of the next block's first row."""
    out, path, last = {}, [], None
    for k, b in enumerate(borders):
        lcp = -1 if last is None else _shared(last, b.first)
        path, last = _upto(path, lcp), b.last
        out[b.block] = (lcp, path, _shared(b.last, borders[k + 1].first) if k + 1 < len(borders) else -1)
        rests, deepest = b.minima[1:], len(b.last) // DIGEST  # the first is the block's first row
        low = rests[0][0] if rests else deepest
        path = _upto(path, min(lcp, low)) + ([(low, b.block, 0)] if lcp < low else [])
        tops = [*[x for x, _ in rests[1:]], deepest]
        path += [(hi, b.block, pos) for (x, pos), hi in zip(rests, tops) if x < hi]
    return out


def _upto(path: list, depth: int) -> list:
    """The segments of a path down to a depth."""
    out, lo = [], -1
    for hi, block, pos in path:
        if lo < depth:
            out.append((min(hi, depth), block, pos))
        lo = hi
    return out


def segments(lcp: list[int], size: list[int], path: list, block: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a block, by all nearest smaller values: columns are the opener's block and place, the first
    row here, the end, depths over and up to, and whether all of it lies here; and each one's parent
    segment (or -1). A segment is nodes of one opener and end at consecutive depths."""
    stack, out, parent = [], [], []  # a stack entry: opener's block, place, first row, depth over, up to, segments below
    lo = -1
    for hi, ob, op in path:
        stack.append([ob, op, 0, lo, hi, []])
        lo = hi

    def close(depth: int, end: int, whole: bool) -> None:
        while stack and stack[-1][4] > depth:
            ob, op, i, lo, hi, below = stack[-1]
            cut = max(lo, depth)
            for s in below:
                parent[s] = len(out)
            out.append((ob, op, i, end, cut, hi, whole and ob == block))
            parent.append(-1)
            if cut == lo:
                stack.pop()
                if stack:
                    stack[-1][5].append(len(out) - 1)
            else:
                stack[-1][4], stack[-1][5] = cut, [len(out) - 1]

    for j, (shared, n) in enumerate(zip(lcp, size)):
        close(shared, j, True)
        if n > shared:
            stack.append([block, j, j, shared, n, []])
    close(after, len(lcp), True)
    close(-2, len(lcp), False)
    return np.array(out, np.int64).reshape(-1, 7), np.array(parent, np.int64)


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of x[a:b] for many ranges, by minima of power-of-two stretches."""
    level, table = np.frexp((b - a).astype(float))[1] - 1, [x]
    while (1 << len(table)) <= len(x):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        on = level == k
        out[on] = np.minimum(table[k][a[on]], table[k][b[on] - (1 << k)])
    return out


def _nodes(paths: dict[int, tuple[int, list, int]]):
    """All nodes of a block's conversations; those that other blocks share in are rows to be added up."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        block = table["block"][0].as_py()
        shared, path, after = paths[block]
        lcp, conv, n = np.array(table["lcp"], np.int64).copy(), np.array(table["conv_id"], np.int64), table.num_rows
        lcp[0] = shared
        lists = table["sums"].combine_chunks()
        sums, size = np.array(lists.flatten(), np.int64), np.array(pc.list_value_length(lists), np.int64) - 1
        offsets = np.append(0, np.cumsum(size + 1))
        seg, parent = segments(lcp.tolist(), size.tolist(), path, block, after)
        ob, op, i, e, lo, hi, whole = seg.T
        given = np.append(0, np.cumsum(np.where(lcp >= 0, sums[offsets[:-1] + np.maximum(lcp, 0)], 0)))
        leaf = np.append(0, np.cumsum(np.append(lcp[1:], after) < size))
        low = _least(conv, i, e)
        above = np.where(parent >= 0, parent, 0)
        own = ob == block
        known = (parent >= 0) & (whole[above] == 1)

        # Every depth of every segment.
        count = hi - lo
        at = np.repeat(np.arange(len(seg)), count)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + lo[at] + 1
        top = depth == lo[at] + 1  # the segment's uppermost node; its parent lies in another one
        up = np.where(top, above[at], at)
        root = depth == 0
        first = i[at] + own[at]  # rows after the opener
        opens = np.flatnonzero((size > lcp) & (lcp >= 0))
        where = np.sort(lcp[opens] * (n + 1) + opens)
        children = np.searchsorted(where, depth * (n + 1) + e[at]) - np.searchsorted(where, depth * (n + 1) + first) + (own[at] & (size[i[at]] > depth))
        saved = given[e[at]] - given[first] - (e[at] - first) * sums[offsets[i[at]] + np.maximum(depth - 1, 0)]

        # Members that end at a node: runs of equal conversations.
        heads = np.flatnonzero((lcp != size) | (np.arange(n) == 0))
        tails = np.append(heads[1:], n)
        ends, ids = np.full(len(at), _NO_IDS, object), np.full(len(at), None, object)
        last = np.flatnonzero((depth == size[i[at]]) & (own[at] | ((i[at] == 0) & (lcp[0] == size[0]))))
        run_at = dict(zip(heads.tolist(), tails.tolist()))
        for k in last.tolist():
            a = int(i[at[k]])
            b = run_at[a]
            text = ",".join(map(str, conv[a:b].tolist())).encode()
            if whole[at[k]]:
                ends[k] = hashlib.sha256(text).hexdigest()
            else:
                ids[k] = text
        part = whole[at] == 0
        ends[part] = None
        pick = lambda x, on: pa.array(x, pa.int64(), mask=~on)
        cols = {
            "ob": pa.array(ob[at]), "op": pa.array(op[at]), "depth": pa.array(depth), "pb": pick(ob[up], ~root), "pp": pick(op[up], ~root),
            "whole": pa.array(~part), "conv_id": pa.array(low[at]), "parent_conv_id": pick(low[up], ~root & ~part & (~top | known[at])),
            "n_convs": pa.array(e[at] - i[at]), "n_children": pa.array(children), "n_leaves": pa.array(leaf[e[at]] - leaf[i[at]]), "saved_tokens": pa.array(saved),
            "ends": pa.array(ends, pa.string()), "block": pa.array(np.full(len(at), block)), "ids": pa.array(ids, pa.binary()),
        }
        return pa.table(cols)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; rows come sorted by node and block."""
    node, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([digest.hexdigest()])], names=["ob", "op", "depth", "ends"])

    for batch in batches:
        for *at, ids in zip(*[batch.column(c).to_pylist() for c in ("ob", "op", "depth")], batch.column("ids")):
            if at != node:
                if node is not None:
                    yield told()
                node, digest = at, hashlib.sha256(ids.as_buffer())
            else:
                digest.update(b",")
                digest.update(ids.as_buffer())
    if node is not None:
        yield told()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations given as ``sequences`` gives them (conv_id, steps).

    Returns a row for each distinct prefix: conv_id (the smallest member), depth (turns), parent_conv_id (the
    parent's conv_id, null for the root), n_convs (members, which start with it), n_children, n_leaves (childless
    nodes of its subtree, itself included), saved_tokens (over its subtree, each node's members but one times the
    UTF-8 bytes of its last text) and ends_sha256 (of the decimal ids, rising and joined by commas, of the members
    that end there).

    An empty array is a conversation without turns, a null one too; rows without an id are left out; rows of one
    id are members each. An empty table has no nodes. Memory: a range partition's digests, lengths
    and numbers; the driver holds for each partition its two border conversations' digests and a path.
    """
    shelf = Shelf(conversations.sparkSession)
    steps = F.coalesce("steps", F.array().cast("array<struct<key: binary, bytes: bigint>>"))
    key = F.unhex(F.array_join(F.transform(steps, lambda x: F.hex(x["key"])), ""))
    sizes = F.transform(steps, lambda x: x["bytes"])
    keyed = shelf.keep(conversations.where("conv_id is not null").select("conv_id", key.alias("key"), sizes.alias("sizes")))
    ordered = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = shelf.keep(ordered.mapInArrow(_blocks, _ROWS))
    shelf.drop(keyed)
    borders = blocks.where("first is not null").select("block", "first", "last", "minima").orderBy("block").collect()  # a row a partition
    rows = blocks.where("first is null").select("block", "pos", "conv_id", "lcp", "sums")
    nodes = shelf.keep(rows.groupBy("block").applyInArrow(_nodes(_paths(borders)), _NODE))
    shelf.drop(blocks)

    node = ["ob", "op", "depth"]
    parts = nodes.where("not whole")
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    added = parts.groupBy(*node).agg(F.first("pb").alias("pb"), F.first("pp").alias("pp"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in numbers])
    ended = parts.where("ids is not null").select(*node, "block", "ids").repartition(*node).sortWithinPartitions(*node, "block")
    ended = ended.mapInArrow(_digests, "ob bigint, op bigint, depth bigint, ends string")
    added = shelf.keep(added.join(ended, node, "left").withColumn("ends", F.coalesce("ends", F.lit(_NO_IDS))))
    few = added.count() <= SMALL_TABLE
    wide = added.select(F.col("ob").alias("pb"), F.col("op").alias("pp"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up"))
    wide = F.broadcast(wide) if few else wide
    columns = ["conv_id", "depth", "parent_conv_id", *numbers, F.col("ends").alias("ends_sha256")]
    done = nodes.where("whole and (parent_conv_id is not null or depth = 0)").select(*columns)
    rest = nodes.where("whole and parent_conv_id is null and depth > 0").drop("parent_conv_id").unionByName(added.withColumn("whole", F.lit(False)), allowMissingColumns=True)
    rest = rest.join(wide, ["pb", "pp", "depth"], "left").withColumn("parent_conv_id", F.col("_up"))
    return done.unionByName(rest.select(*columns))


SQL = r"""
WITH polynomial AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda b: ascii(b)::UBIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 9)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM turns), polynomial),
grown AS (
  SELECT c.conv_id, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.k <= c.h
  UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(r := role, t := text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM grown WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
members AS (SELECT conv_id, depth, p FROM prefixes UNION ALL SELECT conv_id, 0, [] FROM convs),
sizes AS (SELECT conv_id, max(depth) AS turns FROM members GROUP BY 1),
nodes AS (
  SELECT m.depth, m.p, min(m.conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE s.turns = m.depth), '')) AS ends_sha256
  FROM members m JOIN sizes s ON s.conv_id = m.conv_id GROUP BY 1, 2),
kids AS (SELECT p[:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.p[n.depth].t) ELSE 0 END AS own
  FROM nodes n LEFT JOIN kids k ON k.p = n.p),
below AS (
  SELECT a.p, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.own) AS saved
  FROM (SELECT p, n_children, own, unnest(range(0, depth + 1)) AS d FROM full_) b JOIN full_ a ON a.depth = b.d AND a.p = b.p[:b.d] GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_ n JOIN below b ON b.p = n.p LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.p = n.p[:n.depth - 1]
"""
