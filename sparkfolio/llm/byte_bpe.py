"""Byte-level BPE over rank files: Spark's higher-order functions fold the merges of distinct words.

One pass without a shuffle. An Arrow function cuts texts into words by the
vocabulary's pattern and sends two kinds of rows down the task's stream: for
each document the places of its words in the task's word table, and before
them the words that the table does not hold yet, as arrays of byte ranks.
Spark folds each such word: the adjacent pair of lowest rank, the leftmost of
several, is merged until no pair has a rank. A second Arrow function keeps the
folded words by their place and puts each document's ids together, and where
asked decodes them at once. Words travel a bounded number to a row, as a row's
arrays stand whole in Spark's memory.

The rank map is a literal of two arrays, packed by row displacement: the pair
(left, right) has its rank at ``slots[starts[left] + right]`` if that slot
names ``left``. A merge's rank is the id of what it makes.

A word table is emptied at ``TABLE`` words, so its size has a bound; a task
folds a word once as long as the table holds it. The fold's work grows with the
square of a word's length, so runs of over ``LONG`` bytes without a boundary
are merged by a heap on the same ranks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .token_counts import _cut, _spread

#: Characters, about, of the texts looked at together; words a task remembers; bytes of a word that Spark folds; words of a row.
GROUP, TABLE, LONG, ROW = 1 << 22, 1_000_000, 192, 4096
#: Ids put back into bytes together.
IDS = 1 << 20
#: Bits of a rank; an empty slot.
_RANK, _EMPTY = 22, 1 << 45

# Letters and numbers that Unicode has had since version 16, which
# the pattern library knows and the tokenizer's does not.
LATER = (
    "՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ ꭬-꭭ "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff3 \U00016ff4-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 "
    "\U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 "
    "\U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed "
    "\U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)

_ranks: dict[str, dict[bytes, int]] = {}
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file: a line each, base64 and a number."""
    if path not in _ranks:
        with open(path, "rb") as lines:
            _ranks[path] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _ranks[path]


def words_pattern(pattern: str, later: bool) -> regex.Pattern:
    """The vocabulary's pattern in the pattern library's words, with the tokenizer's idea of white space; with
    ``later``, of letters and numbers too, for texts that hold some of those in question."""
    if later:
        some = "".join(LATER.split())
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{some}]]")
        for name in ("L", "N"):
            pattern = pattern.replace(rf" ?\p{{{name}}}+", rf" ?[\p{{{name}}}--[{some}]]+")
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.VERSION1 if later else regex.VERSION0)


def packed(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` and ``slots`` of the rank map (above); a slot holds left * 2^22 + rank."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    top, size = max(ranks.values(), default=0) + 1, 64 + sum(map(len, rows.values())) * 3
    starts, slots = np.zeros(top, np.int64), np.full(size + top, _EMPTY, np.int64)
    steps, begin = np.arange(1024), 0
    many = sorted((x for x in rows.items() if len(x[1]) > 1), key=lambda x: -len(x[1]))
    for left, row in many:
        right, rank = np.array(sorted(row), np.int64).T
        while True:  # the next fit, a thousand starts at a time
            fits = np.flatnonzero((slots[begin + steps[:, None] + right - right[0]] == _EMPTY).all(1))
            if len(fits):
                break
            begin += len(steps)
            if begin + len(steps) > size:
                begin, size = 0, size + len(steps)
                slots = np.append(slots, np.full(len(steps), _EMPTY, np.int64))
        begin += int(fits[0])
        starts[left] = begin - right[0]
        slots[starts[left] + right] = (left << _RANK) + rank
        begin = begin if begin + len(steps) <= size else 0
    one = np.array([(left, *row[0]) for left, row in rows.items() if len(row) == 1], np.int64).reshape(-1, 3)
    free = np.flatnonzero(slots == _EMPTY)[: len(one)]  # a row of one pair goes anywhere
    starts[one[:, 0]], slots[free] = free - one[:, 1], (one[:, 0] << _RANK) + one[:, 2]
    return starts, slots[: 1 + int(np.flatnonzero(slots != _EMPTY).max(initial=0))]


def _literal(values: np.ndarray) -> Column:
    """An array<bigint>, null for empty slots, that the optimizer folds to a literal: one string, not an expression for each value."""
    return F.from_json(F.lit("[" + ",".join("null" if x == _EMPTY else str(x) for x in values.tolist()) + "]"), "array<bigint>")


def fold_merges(word: Column, path: str) -> Column:
    """The token ids of a word given as the array<bigint> of its bytes' ranks."""
    if path not in _tables:
        _tables[path] = packed(ranks_of(path))
    starts, slots = (_literal(x) for x in _tables[path])

    def let(value: Column, then) -> Column:  # a lambda's variable is evaluated once
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def pair(left: Column, right: Column) -> Column:
        # The pair's rank; another pair's slot gives a number past all ranks, an empty one null.
        return F.get(slots, (F.get(starts, left) + right).cast("int")).bitwiseXOR(F.shiftleft(left, _RANK))

    def merged(ids: Column, rank: Column, right: Column) -> Column:
        # ``right`` is the place of the pair's second token, counted from zero.
        return F.array_remove(F.transform(ids, lambda x, i: F.when(i == right, F.lit(-1)).when(i + 1 == right, rank).otherwise(x)), F.lit(-1))

    def step(ids: Column, _: Column) -> Column:
        def lowest(ranks: Column) -> Column:
            def merge(rank: Column) -> Column:
                leftmost = F.array_position(ranks, rank).cast("int")  # counted from one
                return F.when(rank < F.lit(1 << _RANK), let(leftmost, lambda p: merged(ids, rank, p))).otherwise(ids)

            return let(F.array_min(ranks), merge)

        return let(F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), pair), lowest)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), word, step)


def merge_long(word: list[int], ranks: dict[bytes, int]) -> list[int]:
    """``fold_merges`` of a long word by a heap of pairs, each step's lowest and leftmost first."""
    token = {rank: t for t, rank in ranks.items()}
    ids, nxt, prev = [*word], [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]

    def pair(i: int) -> tuple[int, int, int, int] | None:
        j = nxt[i] if i >= 0 else -1
        rank = ranks.get(token[ids[i]] + token[ids[j]]) if j >= 0 else None
        return None if rank is None else (rank, i, ids[i], ids[j])

    heap = [p for p in map(pair, range(len(word))) if p]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue  # one of the two has been merged since
        ids[i], ids[j], nxt[i] = rank, -1, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for p in (pair(i), pair(prev[i])):
            if p:
                heapq.heappush(heap, p)
    return [x for x in ids if x >= 0]


class _Words:
    """The task's word table: cuts texts into words and gives their places."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.patterns = ranks_of(path), [words_pattern(pattern, later) for later in (False, True)]
        self.later = regex.compile(f"[{''.join(LATER.split())}]")
        self.tokens = pa.array(self.ranks, pa.large_binary())
        self.token_ranks = np.array([*self.ranks.values()], np.int64)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.known = pa.array([], pa.large_string())

    def places(self, texts: list[str]) -> tuple[list[np.ndarray], pa.Array, bool]:
        """For each text its words' places, the words new to the table, and whether the table was emptied before."""
        odd = ["\0" in t for t in texts]
        pieces, starts = _cut(pa.array(["" if o else t for t, o in zip(texts, odd)], pa.large_string()))
        if any(odd):  # such texts are a piece of their own
            sizes = np.diff(starts)
            parts = [pa.array([t], pa.large_string()) if o else pieces.slice(a, n) for t, o, a, n in zip(texts, odd, starts, sizes)]
            pieces, starts = pa.concat_arrays(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        coded = pieces.dictionary_encode()
        words, sizes = self.words(coded.dictionary)
        emptied = len(self.known) + len(words.dictionary) > TABLE
        if emptied:
            self.known = self.known.slice(0, 0)
        at = pc.index_in(words.dictionary, self.known)
        fresh = np.array(at.is_null())
        at = np.array(at.fill_null(0), np.int64)
        at[fresh] = len(self.known) + np.arange(fresh.sum())
        new = words.dictionary.filter(pa.array(fresh))
        self.known = pa.concat_arrays([self.known, new])
        flat, ends = at[np.array(words.indices, np.int64)], np.cumsum(sizes)
        which = np.array(coded.indices, np.int64)
        of_piece, size = ends[which] - sizes[which], sizes[which]
        out = flat[_spread(of_piece, size)].astype("<u4") if len(flat) else np.zeros(0, "<u4")
        return np.split(out, np.append(0, np.cumsum(size))[starts[1:-1]]), new, emptied

    def words(self, pieces: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of each of some pieces, one after another, and how many they are."""
        more = np.flatnonzero(~np.array(pc.match_substring_regex(pieces, r"^ ?\p{L}+$")))  # the others are a word
        texts = pieces.take(pa.array(more)).to_pylist()
        found = self.patterns[any(map(self.later.search, texts))].findall
        split = [found(t) for t in texts]
        sizes = np.ones(len(pieces), np.int64)
        sizes[more] = [len(x) for x in split]
        both = pa.concat_arrays([pieces, pa.array([w for x in split for w in x], pa.large_string())])
        at, into = np.repeat(np.arange(len(pieces)), sizes), np.zeros(len(pieces), bool)
        into[more] = True
        at[into[at]] = len(pieces) + np.arange(len(both) - len(pieces))
        return both.take(pa.array(at)).dictionary_encode(), sizes

    def rows(self, new: pa.Array) -> pa.Array:
        """Words as arrays of their bytes' ranks, or as ids where they are a token, or long."""
        new = new.cast(pa.large_binary())
        at = pc.index_in(new, self.tokens)
        token, size = np.array(at.is_valid()), np.array(pc.binary_length(new), np.int64)
        given = {k: [x] for k, x in zip(np.flatnonzero(token).tolist(), self.token_ranks[np.array(at.drop_null(), np.int64)].tolist())}
        for k in np.flatnonzero(~token & (size > LONG)).tolist():
            given[k] = merge_long(self.byte[np.frombuffer(new[k].as_buffer(), np.uint8)].tolist(), self.ranks)
        told = np.zeros(len(new), bool)
        told[[*given]] = True
        flat = np.frombuffer(b"".join(new.filter(pa.array(~told)).to_pylist()), np.uint8)
        ends = pa.array(np.append(0, np.cumsum(np.where(told, 0, size))), pa.int32())
        ids = pa.array([given.get(k) for k in range(len(new))], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(self.byte[flat])), ids], ["bytes", "ids"])


def _parts(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Whole texts (null: empty) in groups of about GROUP characters, with the place of each."""
    group, at, size = [], [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        group.append(text)
        at.append(i)
        size += len(text) + 16
        if size >= GROUP:
            yield group, at
            group, at, size = [], [], 0
    if group:
        yield group, at


class _Bytes:
    """The bytes of tokens by their ids."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.top = max(ranks.values(), default=-1) + 1
        self.sizes = np.full(self.top, _EMPTY, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        token = {rank: t for t, rank in ranks.items()}
        self.every = np.frombuffer(b"".join(token.get(k, b"") for k in range(self.top)), np.uint8)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)

    def text(self, ids: np.ndarray) -> bytes:
        out = []
        for a in range(0, len(ids), IDS):
            x = ids[a : a + IDS].astype(np.int64)
            if x.max() >= self.top or (self.sizes[x] < 0).any():
                raise ValueError("an id is not in the rank file")
            out.append(self.every[_spread(self.starts[x], self.sizes[x])].tobytes())
        return b"".join(out)


def encode(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), decoded: bool = False
) -> DataFrame:
    """Token ids of whole texts under the rank file at ``path``, without special tokens.

    Each match of ``pattern`` is a word and is encoded by itself. Returns one row
    per input row: the id, the columns named in ``carry``, n_tokens (bigint) and
    ids (binary, little-endian unsigned 32-bit), with ``decoded`` also the column
    of that name, which ``decode`` would add. ``path`` must exist on every
    executor, and the file must hold all 256 single bytes.

    Null and empty texts have no tokens. Null ids, repeated rows and ids stay as
    they are; an empty table gives an empty result. Other columns are not read,
    so their names cannot clash; ``carry`` may not name a result column. Strings
    of special tokens are ordinary text. A text of any length is one row: a task
    holds it, its words' places and its ids.
    """
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)
    results = ["n_tokens", "ids", "decoded"][: 2 + decoded]
    both = f"{kinds}, places binary, emptied boolean, words array<struct<bytes: array<bigint>, ids: array<bigint>>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(path, pattern)
        for batch in batches:
            heads = batch.select(names)
            for group, at in _parts(batch.column("text")):
                places, new, emptied = table.places(group)
                words = table.rows(new)
                listed = pa.ListArray.from_arrays(pa.array([*range(0, len(words), ROW), len(words)] if len(words) else [0, 0], pa.int32()), words)
                nulls = [pa.nulls(len(listed), f.type) for f in heads.schema]
                every = [*names, "places", "emptied", "words"]
                first = pa.array([emptied, *[False] * (len(listed) - 1)])
                yield pa.RecordBatch.from_arrays([*nulls, pa.nulls(len(listed), pa.binary()), first, listed], names=every)
                rows = heads.take(pa.array(at))
                blobs = pa.array([p.tobytes() for p in places], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, blobs, pa.nulls(len(at), pa.bool_()), pa.nulls(len(at), listed.type)], names=every)
        give_back()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        starts, more, tokens = sizes, [], _Bytes(path) if decoded else None
        for batch in batches:
            tables = np.flatnonzero(np.array(batch.column("emptied").is_valid()))
            edges = [*tables.tolist(), batch.num_rows]
            for a, b in zip([-1, *edges], edges):
                if a >= 0:
                    if batch.column("emptied")[a].as_py():
                        flat, sizes, more = flat[:0], sizes[:0], []
                    folded = batch.column("folded").slice(a, 1).flatten()
                    more.append((folded.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.array(pc.list_value_length(folded), np.int64)))
                rows = batch.slice(a + 1, b - a - 1)
                if not rows.num_rows:
                    continue
                if more:
                    flat, sizes = (np.concatenate(x) for x in zip((flat, sizes), *more))
                    starts, more = np.cumsum(sizes) - sizes, []
                out, texts = [], []
                for blob in rows.column("places"):
                    at = np.frombuffer(blob.as_buffer(), "<u4")
                    ids = flat[_spread(starts[at], sizes[at])]
                    out.append(ids.tobytes())
                    if tokens:
                        texts.append(tokens.text(ids))
                made = [pa.array([len(x) // 4 for x in out], pa.int64()), *[pa.array(x, pa.binary()) for x in ((out, texts) if tokens else (out,))]]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], *made], names=[*names, *results])
        give_back()

    folded = F.transform("words", lambda w: F.coalesce(w["ids"], fold_merges(w["bytes"], path))).alias("folded")
    stream = given.mapInArrow(cut, both).select(*names, "places", "emptied", folded)
    schema = f"{kinds}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return stream.mapInArrow(join, schema).withColumnsRenamed(dict(zip(names, [id_col, *carry])))


def decode(frame: DataFrame, path: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``frame`` with the binary column ``to``: the bytes of the tokens of ``ids_col``, one after another.

    A null stays null; no ids give no bytes; an id that the rank file lacks, or a
    length that is no multiple of four, is an error. Ids are taken a bounded
    number at a time.
    """
    schema = frame.drop(to).schema.add(to, "binary")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Bytes(path)
        for batch in batches:
            cols = {n: batch.column(n) for n in names if n != to}
            cols[to] = pa.array([tokens.text(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else None for x in batch.column(ids_col)], pa.binary())
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
        give_back()

    return frame.mapInArrow(run, schema)
