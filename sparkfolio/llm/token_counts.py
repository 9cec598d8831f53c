"""Token counts and ids of whole texts, by pieces cut at safe boundaries.

A pre-token of the byte-level pattern never has a blank after a character that
is not white space, so a text may be cut before such a blank if the next
character is not white space either: the pieces encode as the text does. A line
feed between two such characters is a pre-token of its own. Texts longer than
``GROUP`` are cut at such blanks, and texts are taken in groups of about that
size. A group's pieces are told apart in Arrow, the distinct ones are encoded in
calls of bounded size, and every piece takes its ids, or only their number, by
its place among the distinct ones. A worker keeps the tokenizer and an Arrow
table of the pieces met last, of bounded size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Characters, about, of the texts looked at together and of one call of the library.
GROUP, CALL = 1 << 23, 1 << 17
#: Pieces that a worker remembers, and their longest length in bytes.
REMEMBERED, LONGEST = 400_000, 24
#: Parts the pieces of a group; texts that hold it are cut one by one.
_MARK = "\0"
# White space, in RE2's words.
_W = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNSAFE = f"[ \\n][{_W}]|[{_W}][ \\n]"
#: Pieces that may be encoded in one string, a line each: a line feed between
#: them is a pre-token of its own. None holds white space, but for a first blank, or a special string.
_PLAIN = f"^ ?[^{_W}<]+$"
_safe = re.compile(r"(?<=\S)(?= \S)")


def ids_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return np.array(ids, "<u4").tobytes()


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts without the mark, and where each text's start (and the end). Blanks and
    line feeds between two characters that are not white space part them; where that is
    so of all in a text, plain replacement does, else a pattern, which may leave out some."""
    unsafe = pc.match_substring_regex(texts, _UNSAFE)
    kinds = np.array(unsafe)
    parts, order = [], []
    for kind in (False, True):
        at = np.flatnonzero(kinds == kind)
        if not len(at):
            continue
        x = texts.take(pa.array(at)) if len(at) < len(texts) else texts
        if kind:
            x = pc.replace_substring_regex(x, f"([^{_W}]) ([^{_W}])", f"\\1{_MARK} \\2")
            x = pc.replace_substring_regex(x, f"([^{_W}])\\n([^{_W}])", f"\\1{_MARK}\n{_MARK}\\2")
        else:
            x = pc.replace_substring(pc.replace_substring(x, " ", f"{_MARK} "), "\n", f"{_MARK}\n{_MARK}")
        parts.append(pc.split_pattern(x, _MARK))
        order.append(at)
    lists = parts[0] if len(parts) == 1 else pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))
    return lists.flatten(), np.append(0, np.cumsum(np.array(pc.list_value_length(lists)))).astype(np.int64)


class Pieces:
    """Encodes texts with a tokenizers file, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.line_feed = self._ids("\n")
        self.known = pa.array([], pa.large_string())
        self.places = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode`` of distinct pieces, of which those met lately are known."""
        at = pc.index_in(pieces, self.known)
        new = np.array(at.is_null())
        at = np.array(at.fill_null(0), np.int64)
        flat, places, sizes = self.encode(pieces.filter(pa.array(new)))
        starts, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[new], counts[new] = places + len(self.flat), sizes
        starts[~new], counts[~new] = self.places[at[~new]], self.sizes[at[~new]]
        flat = np.concatenate((self.flat, flat))
        self._remember(pieces, starts, counts, np.delete(np.arange(len(self.known)), at[~new]), flat)
        return flat, starts, counts

    def _remember(self, pieces: pa.Array, starts: np.ndarray, counts: np.ndarray, others: np.ndarray, flat: np.ndarray) -> None:
        """The table holds ``pieces`` first, then of those it had the ``others``, up to ``REMEMBERED``."""
        short = np.flatnonzero(np.array(pc.binary_length(pieces)) <= LONGEST)[:REMEMBERED]
        others = others[: REMEMBERED - len(short)]
        self.known = pa.concat_arrays([pieces.take(pa.array(short)), self.known.take(pa.array(others))])
        starts, self.sizes = np.concatenate((starts[short], self.places[others])), np.concatenate((counts[short], self.sizes[others]))
        self.flat, self.places = flat[_spread(starts, self.sizes)], np.cumsum(self.sizes) - self.sizes

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and where in them each piece's start and how many they are."""
        plain = np.array(pc.match_substring_regex(pieces, _PLAIN)) & (len(self.line_feed) == 1)
        starts, sizes, flat, base = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [], 0
        at = np.flatnonzero(plain)
        ends = np.cumsum(np.array(pc.binary_length(pieces), np.int64)[at])
        for calls in np.split(at, np.searchsorted(ends, np.arange(CALL, ends[-1], CALL))) if len(at) else []:
            if not len(calls):
                continue
            lines = pa.ListArray.from_arrays(pa.array([0, len(calls)], pa.int32()), pieces.take(pa.array(calls)).cast(pa.string()))
            ids = self._ids(pc.binary_join(lines, "\n")[0].as_py())
            cuts = np.concatenate(([-1], np.flatnonzero(ids == self.line_feed[0]), [len(ids)]))
            starts[calls], sizes[calls] = base + cuts[:-1] + 1, np.diff(cuts) - 1
            flat.append(ids)
            base += len(ids)
        for k in np.flatnonzero(~plain).tolist():
            ids = self._ids(pieces[k].as_py())
            starts[k], sizes[k] = base, len(ids)
            flat.append(ids)
            base += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, "<u4"), starts, sizes

    def group(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Of texts cut into pieces: ``distinct`` of the distinct ones, which of them
        each piece is, and where each text's pieces start (and the end)."""
        marked = [k for k, t in enumerate(texts) if _MARK in t]
        pieces, starts = _cut(pa.array(["" if _MARK in t else t for t in texts] if marked else texts, pa.large_string()))
        if marked:
            parts, sizes = [], np.diff(starts)
            for k, t in enumerate(texts):
                parts.append(pa.array(_safe.split(t), pa.large_string()) if _MARK in t else pieces.slice(starts[k], sizes[k]))
                sizes[k] = len(parts[-1])
            pieces, starts = pa.concat_arrays(parts), np.append(0, np.cumsum(sizes))
        coded = pieces.dictionary_encode()
        return self.distinct(coded.dictionary), np.array(coded.indices, np.int64), starts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        (_, _, sizes), which, starts = self.group(texts)
        total = np.append(0, np.cumsum(sizes[which]))
        return total[starts[1:]] - total[starts[:-1]]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        (flat, places, sizes), which, starts = self.group(texts)
        sizes = sizes[which]
        ids = flat[_spread(places[which], sizes)]
        ends = np.append(0, np.cumsum(sizes))[starts].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


_workers: dict[str, Pieces] = {}


def groups(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Texts (null: empty) in groups of about GROUP characters, with the place of each; longer ones in parts cut at safe blanks."""
    group, at, size = [], [], 0
    for i in range(len(texts)):
        text, a = texts[i].as_py() or "", 0
        while a is not None:
            cut = _safe.search(text, a + GROUP) if len(text) > a + 2 * GROUP else None
            part = text[a : cut.start() if cut else None] if a or cut else text
            group.append(part)
            at.append(i)
            size += len(part) + 16
            a = cut.start() if cut else None
            if size >= GROUP:
                yield group, at
                group, at, size = [], [], 0
    if group:
        yield group, at


def pieces_of(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encoded(path: str, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text (null: empty), in order."""
    held: list[bytes] = []
    last = 0
    for group, at in groups(texts):
        for i, x in zip(at, pieces_of(path).texts(group)):
            if i != last:
                yield held[0] if len(held) == 1 else b"".join(held)
                held, last = [], i
            held.append(x)
    if held:
        yield b"".join(held)


def counted(path: str, texts: pa.Array) -> np.ndarray:
    """The number of ids of each text (null: none)."""
    out = np.zeros(len(texts), np.int64)
    for group, at in groups(texts):
        np.add.at(out, at, pieces_of(path).counts(group))
    return out


def count_tokens(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Bytes and tokens of each whole text under the tokenizers file at ``path``.

    Returns one row per input row: the id, the columns named in ``carry``,
    n_bytes, n_tokens and over_limit (n_tokens > ``limit``). No begin, end or
    added special tokens, no truncation, no padding; special strings inside a
    text count as the library's default has it. ``path`` must exist on every
    executor.

    Null texts count as empty, with no tokens. Null ids, repeated rows and ids
    stay as they are; an empty table gives an empty result. Other columns are
    not read, so their names cannot clash; ``carry`` may not name a result
    column. Memory per task: one Arrow batch and a group's pieces.
    """
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text"))
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            cols = [*[batch.column(n) for n in names], sizes, pa.array(counted(path, texts))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_bytes", "n_tokens"])
        give_back()

    out = given.mapInArrow(run, f"{kinds}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnsRenamed(dict(zip(names, [id_col, *carry])))
