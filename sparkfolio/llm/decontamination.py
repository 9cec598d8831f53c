"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become folded words: A-Z lower-cased, ASCII
punctuation blanked. A seed looks at the words a fixed mask keeps and ignores
the rest, so a substituted word at an ignored place does not hide an overlap.
Every place of every text is hashed under every mask; a bitmap of fixed size
over the items' hashes lets only likely places through, with the words around
them. Their hashes are joined with the items' hashes, and the alignment that a
hit names is verified word by word around the hit. Overlaps that reach the end
of the words kept there are verified once more in the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import Shelf, row_key, squeezed, unsqueeze
from .substring_rlz import word_grams, words_of

# Fixed masks (1: the word counts) of six words each.
MASKS = ("111111", "1110111", "11011011", "110100111", "1101001000111")
#: Bits of the bitmap, whatever the number of items: 16 MiB.
BITMAP_BITS = 1 << 27
#: Words kept on either side of a run of hits for verification.
AROUND = 96
#: Hits closer than this share one stretch; a stretch of hits is at most LONGEST words (longer overlaps are verified again, whole).
JOINED, LONGEST = 32, 512
#: Words looked at together.
PIECE = 200_000
#: Most seeds of items, or ids of texts to verify again, that a join may broadcast.
SMALL_SEEDS = 500_000

_FOLD = bytes.maketrans(
    bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128))
)


def folded(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Folded words joined by blanks, with their starts and ends."""
    return words_of((text or "").encode().translate(_FOLD))


def seeds(words: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask, the hash of the seed at every place where it fits."""
    for k, mask in enumerate(MASKS):
        n = len(words) - len(mask) + 1
        if n > 0:
            h = np.full(n, k + 1, np.uint64)
            for j, x in enumerate(mask):
                if x == "1":
                    h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n])
            yield h


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, place, seed = [], [], []
        for i in range(batch.num_rows):
            joined, starts, ends = folded(batch.column("text")[i].as_py())
            if len(starts):
                for h in seeds(word_grams(joined, starts, ends, 1)):
                    item += [batch.column("item")[i].as_py()] * len(h)
                    place += range(len(h))
                    seed += h.view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(place, pa.int32()), pa.array(seed, pa.int64())], names=["item", "place", "seed"])


def _places(bitmap):
    """Stretches of a text around the places whose seeds the bitmap knows."""

    def stretches(joined: bytes, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> Iterator[tuple]:
        n, found = len(starts), []
        for k in range(0, n, PIECE):
            part = slice(k, min(n, k + PIECE + len(MASKS[-1]) - 1))
            for h in seeds(word_grams(joined, starts[part], ends[part], 1)):
                b = (h % np.uint64(BITMAP_BITS)).astype(np.int64)
                at = np.flatnonzero((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
                at = at[at < PIECE]
                if len(at):
                    found.append(np.stack((at + k, h[at].view(np.int64))))
        if not found:
            return
        hits = np.concatenate(found, 1)
        hits = hits[:, np.lexsort((hits[1], hits[0]))]
        first = 0
        for last in range(1, hits.shape[1] + 1):
            if last == hits.shape[1] or hits[0, last] - hits[0, last - 1] > JOINED or hits[0, last] - hits[0, first] > LONGEST:
                lo, hi = max(0, int(hits[0, first]) - AROUND), min(n, int(hits[0, last - 1]) + len(MASKS[-1]) + AROUND)
                yield lo, n, joined[starts[lo] : ends[hi - 1]].decode(), [{"place": int(p), "seed": int(s)} for p, s in hits[:, first:last].T]
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("place", pa.int32()), ("seed", pa.int64())]))]
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                joined, starts, ends = folded(batch.column("text")[i].as_py())
                if len(starts):
                    key = [batch.column(c)[i].as_py() for c in ("d", "v", "_id")]
                    rows += [(*key, *x) for x in stretches(joined, starts, ends, bits)]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "v", "_id", "lo", "whole", "words", "hits"])

    return run


def _reach(same: np.ndarray, penalty: int) -> tuple[int, int]:
    """Length of the best-scoring prefix (+1 a match, -``penalty`` a mismatch), and its matches."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -penalty))
    k = int(score.argmax())
    return (k + 1, int(same[: k + 1].sum())) if score[k] > 0 else (0, 0)


def _grown(same: np.ndarray, places: list[int], penalty: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of best score around the places, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for at in sorted(places):
        if out and at < out[-1][1]:
            continue
        a, b = at - _reach(same[:at][::-1], penalty)[0], at + _reach(same[at:], penalty)[0]
        while out and a <= out[-1][1]:
            last = out.pop()
            a, b = min(a, last[0]), max(b, last[1])
        if b > a:
            out.append((a, b))
    return out


_OVERLAP = [("d", pa.int64()), ("v", pa.int64()), ("_id", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("start", "end", "item_start", "n_matched")], ("item_words", pa.int64()), ("cut", pa.bool_())]


def _told(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_OVERLAP)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _OVERLAP)], names=[n for n, _ in _OVERLAP])


def _overlaps(r: dict, words: np.ndarray, lo: int, whole: int, item: np.ndarray, found: dict[int, list[int]], overlap: int, penalty: int) -> list[tuple]:
    """Overlap rows of one text (``words`` from place ``lo`` on, of ``whole``) and item;
    ``found``: places of the text by shift (item word i stands at text word i + shift).
    ``cut`` tells that a stretch ends where ``words`` do and the text and the item go on."""
    rows = []
    for shift, places in found.items():
        a, b = max(lo, shift), min(lo + len(words), shift + len(item))
        same = words[a - lo : b - lo] == item[a - shift : b - shift]
        for x, y in _grown(same, [p - a for p in places], penalty):
            if y - x >= min(overlap, len(item)):
                cut = (x == 0 and a == lo and min(lo, lo - shift) > 0) or (y == len(same) and b == lo + len(words) and b < min(whole, shift + len(item)))
                rows.append((r["d"], r["v"], r["_id"], r["item"], r["item_id"], a + x, a + y, a + x - shift, int(same[x:y].sum()), len(item), cut))
    return rows


def _hashed(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_grams(joined, starts, ends, 1) if len(starts) else np.zeros(0, np.uint64)


def _verify(overlap: int, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found: dict[int, list[int]] = {}
                for x in r["aligned"]:
                    found.setdefault(x["shift"], []).append(x["place"])
                words, item = _hashed(*words_of(r["words"].encode())), _hashed(*folded(r["item_text"]))
                rows += _overlaps(r, words, r["lo"], r["whole"], item, found, overlap, penalty)
            yield _told(rows)

    return run


def _verify_whole(overlap: int, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words, item = _hashed(*folded(unsqueeze(r["text"]).decode())), _hashed(*folded(r["item_text"]))
                found: dict[int, list[int]] = {}
                for x in r["parts"]:
                    found.setdefault(x["shift"], []).append(x["start"])
                rows += _overlaps(r, words, 0, len(words), item, found, overlap, penalty)
            yield _told(rows)

    return run


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    overlap: int = 13,
    penalty: int = 3,
) -> DataFrame:
    """Stretches of texts that repeat a benchmark item, substitutions tolerated.

    Returns distinct rows: the document's id, the item's id, start and end (the
    folded words of the text, end exclusive), item_start, n_matched and
    item_words. A stretch is grown from a hit both ways to the best score of +1
    for an equal and -``penalty`` for another word, so at least
    ``penalty / (penalty + 1)`` of its words are equal; it counts from
    ``overlap`` words, or an item's whole length if that is less. Stretches of one
    alignment that overlap or touch are one, of any length. Items of under six
    folded words hold no seed and are never found.

    Null and empty texts and items give no rows. Null ids are kept, of documents
    and of items, repeated rows give one row. Empty tables, of either side, give empty results. Other
    columns are not read, so their names cannot clash. A benchmark of any size
    does: only a bitmap of fixed size reaches the driver.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession)
    items = benchmark.select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))  # never null
    keyed = shelf.keep(items.select("item", "text").mapInArrow(_item_seeds, "item bigint, place int, seed bigint"))
    spot = F.col("seed").bitwiseAND(BITMAP_BITS - 1)
    bits = keyed.select(spot.alias("b")).distinct().selectExpr("bitmap_bucket_number(b + 1) AS k", "bitmap_bit_position(b + 1) AS p")
    parts = bits.groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bytes")).collect()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in parts:
        bitmap[(r["k"] - 1) * 4096 :][:4096] = np.frombuffer(r["bytes"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    given = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text"))
    schema = "d bigint, v bigint, _id bigint, lo int, whole int, words string, hits array<struct<place:int,seed:bigint>>"
    found = shelf.keep(given.mapInArrow(_places(shared), schema))
    small = F.broadcast if keyed.count() <= SMALL_SEEDS else lambda df: df
    hits = found.select("d", "v", "lo", F.explode("hits").alias("h")).select("d", "v", "lo", "h.place", "h.seed")
    pairs = hits.join(small(keyed.withColumnRenamed("place", "item_place")), "seed")
    pairs = pairs.select("d", "v", "lo", "item", "place", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    aligned = pairs.groupBy("d", "v", "lo", "item").agg(F.sort_array(F.collect_list(F.struct("shift", "place"))).alias("aligned"))
    to_check = aligned.join(found.select("d", "v", "lo", "_id", "whole", "words").distinct(), ["d", "v", "lo"]).join(items.withColumnRenamed("text", "item_text"), "item")
    schema = "d bigint, v bigint, _id bigint, item bigint, item_id bigint, start int, end int, item_start int, n_matched int, item_words bigint, cut boolean"
    near = to_check.select("d", "v", "_id", "item", "item_id", "lo", "whole", "words", "aligned", "item_text").mapInArrow(_verify(overlap, penalty), schema)
    near = shelf.keep(near)
    again = shelf.keep(near.where("cut").select("d", "v", "item").distinct())
    out, n_again = near, again.count()
    if n_again:
        ids = again.select("d", "v").distinct()
        ids = F.broadcast(ids) if n_again <= SMALL_SEEDS else ids
        parts = near.join(again, ["d", "v", "item"], "left_semi").groupBy("d", "v", "_id", "item", "item_id").agg(F.collect_set(F.struct((F.col("start") - F.col("item_start")).alias("shift"), "start")).alias("parts"))
        texts = squeezed(given.select("d", "v", "text").join(ids, ["d", "v"], "left_semi").dropDuplicates(["d", "v"]))
        whole = parts.join(texts, ["d", "v"]).join(items.select("item", F.col("text").alias("item_text")), "item")
        whole = whole.select("d", "v", "_id", "item", "item_id", "text", "parts", "item_text").mapInArrow(_verify_whole(overlap, penalty), schema)
        out = near.join(again, ["d", "v", "item"], "left_anti").unionByName(whole)
    out = out.select("_id", F.col("item_id").alias("item"), "start", "end", "item_start", "n_matched", "item_words").distinct()
    return out.withColumnsRenamed({"_id": id_col, "item": item_id_col})
