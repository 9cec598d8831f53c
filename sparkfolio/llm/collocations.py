"""Phrases that occur together more often than their parts: counts of dictionary-encoded n-grams.

1. Texts of one language are read in chunks of bounded size. An Arrow function
   names a chunk's distinct words, counts them and writes the chunk as those
   names, with a mark where a piece ends.
2. Chunk counts add up to word counts. A phrase of ``at_least`` occurrences has
   only words of as many, so these alone get dense ids.
3. Each chunk meets the ids of its words, by a join on the words that chunks hold
   and not on their occurrences; pieces break at every other word, and
   each n-gram is packed into a binary key of fixed-width ids, most
   significant byte first, and counted in its chunk.
4. A chunk's keys are sorted and written as one block of bytes. Samples of all
   blocks give the bounds of ranges; each block is cut at them, slices of
   a range meet in one task, are sorted by their 8-byte words, least significant first, and
   runs of equal keys are added up. A key has one row a chunk, so no range grows with a key.
5. Parts of candidates are substrings of their keys, so cuts and longer
   candidates are joins on keys.

Chunks and counts are written tables; no step collects more than a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, give_back

#: Bytes, about, of a chunk.
CHUNK = 1 << 23
#: Keys, about, of a range, as long as the ranges are no more than RANGES; keys of a block of which one is a sample.
RANGE, RANGES, SAMPLE = 1 << 21, 1 << 17, 512
#: Samples of a range that suffice for its bound, and samples that the driver holds.
PER_RANGE, SAMPLED = 64, 1 << 20
#: Parts of a language whose best phrases are found, level by level, before the whole language's; languages that may be broadcast.
SALTS, LANGUAGES = (256, 8), 100_000

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[[*b".,;:!?", *range(10, 14)]] = 2

_CHUNKS = "chunk bigint, lang string, word binary, at int, n bigint, seq binary"


def named(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a text, the commonest first, how often each occurs, and the
    text as their places plus one, with a zero between pieces."""
    buf = np.frombuffer(text, np.uint8)
    kind = _CLASS[buf]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.append(0, np.cumsum(last - first))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(buf[inside])]).dictionary_encode()
    at = np.array(words.indices, np.int64)
    counts = np.bincount(at, minlength=len(words.dictionary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    piece = np.cumsum(kind == 2)[first]
    marks = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    seq = np.zeros(len(at) + (int(marks[-1]) if len(marks) else 0), "<u4")
    seq[np.arange(len(at)) + marks] = place[at] + 1
    return words.dictionary.take(pa.array(order)), counts[order], seq


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def told(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        words, counts, seq = named(b"\n".join(held.pop(lang)))
        sizes.pop(lang)
        if not len(words):
            return
        n, schema = len(words), ["chunk", "lang", "word", "at", "n", "seq"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), words.cast(pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.binary())],
            names=schema,
        )
        seq = zstandard.ZstdCompressor(level=3).compress(seq.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([lang]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([seq], pa.binary())], names=schema
        )
        number += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), pc.ascii_lower(batch.column("text"))):
            text = text.as_py().encode()
            a = 0
            while a < len(text):  # a long text is parted where a piece ends
                cut = _BREAK.search(text, a + CHUNK)
                part = text[a : cut.start() if cut else len(text)]
                a += len(part) + 1
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= CHUNK:
                    yield from told(lang)
            if sum(sizes.values()) > 4 * CHUNK:
                yield from told(max(sizes, key=sizes.__getitem__))
    for lang in [*held]:
        yield from told(lang)
    give_back()


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of ids, by radix over columns, least significant first."""
    if keys.shape[1] % 2:  # ids of 32 bits go in pairs
        keys = np.concatenate((np.zeros((len(keys), 1), keys.dtype), keys), 1)
    wide = keys.astype(np.uint64)
    pairs = wide[:, ::2] << np.uint64(32) | wide[:, 1::2] if keys.dtype == np.uint32 else wide
    return np.lexsort(pairs.T[::-1])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, sorted, and the sums of their counts: a sort and the lengths of runs."""
    if not len(keys):
        return keys, counts
    order = _order(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    return keys[heads], np.add.reduceat(counts, heads)


def _press(x: np.ndarray) -> bytes:
    """An array as bytes, most significant bytes first and together, which compress best."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpress(blob: bytes, kind: str, columns: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize * columns
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1, columns)


def _grams(longest: int, kind: str):
    """For each chunk (seq, ids: places and ids of its frequent words) and n, its distinct n-grams as rows of ids, sorted, with counts, and samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("seq")[i].as_buffer()), "<u4")
                told = batch.column("ids")[i].values
                at, id_ = np.array(told.field("at"), np.int64), np.array(told.field("id"), np.int64)
                local, ids = np.zeros(int(seq.max()) + 1, np.uint64), np.zeros(int(seq.max()) + 1, kind)
                local[at + 1], ids[at + 1] = np.arange(1, len(at) + 1), id_
                local, ids = local[seq], ids[seq]
                start = np.flatnonzero(local)
                name = local[start]
                for n in range(2, longest + 1):
                    on = start + n - 1 < len(local)
                    start, name = start[on], name[on]
                    nxt = local[start + n - 1]
                    start, name, nxt = start[nxt > 0], name[nxt > 0], nxt[nxt > 0]
                    if not len(start):
                        break
                    # An n-gram's name is the place of (its first n - 1 words' name, its last word) among the distinct ones.
                    pair = name << np.uint64(32) | nxt
                    if n < longest:
                        _, first, inverse, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                        name = inverse.astype(np.uint64) + np.uint64(1)
                    else:
                        _, first, count = np.unique(pair, return_index=True, return_counts=True)
                    keys = np.stack([ids[start[first] + k] for k in range(n)], 1)
                    order = _order(keys)
                    keys, count = keys[order], count[order].astype("<u4")
                    some = keys[np.arange(SAMPLE // 2, len(keys), SAMPLE)].astype(np.int64)
                    values = [[n], [len(keys)], [_press(keys.astype(kind.replace("<", ">")))], [_press(count)], [some.tolist()]]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["n", "size", "keys", "counts", "some"])
        give_back()

    return run


def _slices(bounds: dict[int, list[tuple[int, np.ndarray]]], kind: str):
    """Blocks cut at the bounds of ranges; ``bounds``: for each n, ranges and their least keys."""

    def place(keys: np.ndarray, least: np.ndarray) -> int:
        lo, hi = 0, len(keys)
        for c in range(keys.shape[1]):
            column = keys[lo:hi, c]
            lo, hi = lo + int(np.searchsorted(column, least[c], "left")), lo + int(np.searchsorted(column, least[c], "right"))
        return lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, keys, counts in zip(batch.column("n").to_pylist(), batch.column("keys"), batch.column("counts")):
                keys = _unpress(keys.as_buffer(), kind.replace("<", ">"), n).astype(kind)
                counts = _unpress(counts.as_buffer(), "<u4", 1)
                ranges, least = zip(*bounds[n])
                cuts = [0, *[place(keys, k) for k in least[1:]], len(keys)]
                rows = [(r, n, _press(keys[a:b].astype(kind.replace("<", ">"))), _press(counts[a:b])) for r, a, b in zip(ranges, cuts, cuts[1:]) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["range", "n", "keys", "counts"])
        give_back()

    return run


def _counted(at_least: int, kind: str):
    """Keys and counts of each range; rows come sorted by range. A range's slices are added up whenever they are ``RANGE`` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, floor = None, [], 0, 0

        def settle() -> None:
            nonlocal held, size, floor
            keys, counts = (np.concatenate(x) for x in zip(*held))
            held, size = [_summed(keys, counts)], 0
            floor = len(held[0][0])

        def told(n: int) -> pa.RecordBatch:
            settle()
            keys, counts = held[0]
            good = counts >= at_least
            packed = np.ascontiguousarray(keys[good].astype(kind.replace("<", ">")))
            ends = np.arange(len(packed) + 1, dtype=np.int32) * (n * packed.dtype.itemsize)
            return pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(packed)]), pa.array(counts[good])], names=["key", "f"])

        for batch in batches:
            for r, n, keys, counts in zip(batch.column("range").to_pylist(), batch.column("n").to_pylist(), batch.column("keys"), batch.column("counts")):
                if (r, n) != now:
                    if now is not None:
                        yield told(now[1])
                    now, held, size, floor = (r, n), [], 0, 0
                held.append((_unpress(keys.as_buffer(), kind.replace("<", ">"), n).astype(kind), _unpress(counts.as_buffer(), "<u4", 1)[:, 0].astype(np.int64)))
                size += len(held[-1][0])
                if size > max(RANGE, floor):
                    settle()
        if now is not None:
            yield told(now[1])
        give_back()

    return run


def _bounds(blocks: DataFrame) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Ranges of about RANGE keys: for each n, (range, least key), from SAMPLE-th keys of the blocks, thinned to a bounded number."""
    out, number = {}, 0
    for n, size in sorted(tuple(r) for r in blocks.groupBy("n").agg(F.sum("size")).collect()):
        ranges = min(-(-size // RANGE), RANGES)
        share = min(1.0, min(ranges * PER_RANGE, SAMPLED) * SAMPLE / size)
        some = blocks.where(F.col("n") == n).select(F.explode("some").alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) <= int(share * (1 << 20)))
        keys = sorted(r["k"] for r in some.collect())
        least = [[0] * n] + [keys[len(keys) * k // ranges] for k in range(1, ranges) if keys]
        out[n] = [(number + k, np.array(x, np.int64)) for k, x in enumerate(least)]
        number += len(least)
    return out


def _big_endian(number: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    at_least: int = 10,
    inside: int = 50,
    top: int | None = None,
    no_lang: str = "und",
) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``at_least`` times in a language, scored by their weakest cut.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``; phrases lie within
    pieces. Returns lang, phrase (words joined by a space), a (occurrences), l and r (occurrences of the two parts),
    n (words of the language) and score, floor(10^6 a a / (l r)) of the cut where it is lowest, of equal ones the
    first. A phrase inside a longer candidate with at least ``inside`` percent of its occurrences is left out.
    With ``top``, the best of each language by score, then a, both falling, then phrase, with their rank.
    Arithmetic is exact up to 10^15 occurrences.

    A null lang is ``no_lang``; null, empty and blank texts have no words. Ids are not
    read: repeated rows count again. An empty table gives an empty result. Other columns are not read, so their
    names cannot clash.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    given = docs.select(F.coalesce(F.col(lang_col), F.lit(no_lang)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = shelf.keep(given.mapInArrow(_chunks, _CHUNKS))
    words, seqs = chunks.where("word is not null").select("chunk", "lang", "word", "at", "n"), chunks.where("seq is not null").select("chunk", "seq")
    sizes = shelf.keep(words.groupBy("lang").agg(F.sum("n").alias("n")))
    sizes = F.broadcast(sizes) if sizes.count() <= LANGUAGES else sizes

    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least)
    frequent = shelf.keep(frequent.select("lang", "word", "f", F.monotonically_increasing_id().alias("row")))
    parts = sorted(frequent.groupBy(F.shiftright("row", 33).alias("part")).count().collect())  # a row a partition
    ends = np.cumsum([0, *[n for _, n in parts]]).tolist()
    width = 4 if ends[-1] < 1 << 32 else 8
    offsets = F.broadcast(spark.createDataFrame([(p, o) for (p, _), o in zip(parts, ends)], "part bigint, offset bigint"))
    numbered = frequent.join(offsets, F.shiftright("row", 33) == F.col("part")).select(
        "lang", "word", "f", (F.col("offset") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("id")
    )
    dictionary = shelf.keep(numbered)
    shelf.drop(frequent)

    ids = words.join(dictionary, ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    kind = f"<u{width}"
    blocks = seqs.join(ids, "chunk").select("seq", "ids").mapInArrow(_grams(longest, kind), "n int, size bigint, keys binary, counts binary, some array<array<bigint>>")
    blocks = shelf.keep(blocks)
    shelf.drop(chunks)
    bounds = _bounds(blocks.select("n", "size", "some"))
    slices = blocks.select("n", "keys", "counts").mapInArrow(_slices(bounds, kind), "range int, n int, keys binary, counts binary")
    slices = slices.repartition(max(1, sum(map(len, bounds.values()))), "range").sortWithinPartitions("range")
    counted = shelf.keep(slices.mapInArrow(_counted(at_least, kind), "key binary, f bigint"))
    shelf.drop(blocks)

    some = shelf.keep(counted.unionByName(dictionary.select(_big_endian(F.col("id"), width).alias("key"), "f")))
    size = F.length("key") / width
    cut = counted.select("key", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size.cast("int") - 1)).alias("k"))
    cut = shelf.keep(cut.select("*", F.expr(f"substring(key, 1, k * {width})").alias("_l"), F.expr(f"substring(key, k * {width} + 1)").alias("_r")))
    left, right = some.select(F.col("key").alias("_l"), F.col("f").alias("l")), some.select(F.col("key").alias("_r"), F.col("f").alias("r"))
    big = [F.col(c).cast("decimal(15,0)") for c in "alr"]
    score = F.expr("cast(_top div _bottom as bigint)")
    scored = cut.join(left, "_l").join(right, "_r").withColumn("_top", big[0] * big[0] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_bottom", big[1] * big[2])
    best = scored.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = counted.where(F.length("key") > 2 * width).select("key", "f", F.explode(F.sequence(F.lit(2), size.cast("int") - 1)).alias("k"))
    longer = longer.select("f", "k", "key", F.explode(F.sequence(F.lit(0), size.cast("int") - F.col("k"))).alias("s"))
    longer = longer.select(F.expr(f"substring(key, s * {width} + 1, k * {width})").alias("_in"), "f").groupBy("_in").agg(F.max("f").alias("most"))
    kept = best.join(shelf.keep(longer), F.col("key") == F.col("_in"), "left")
    kept = shelf.keep(kept.where(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True))).select("key", "a", "cut"))

    spelled = kept.select("key", F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("s"))
    spelled = shelf.keep(spelled.select("key", "s", F.expr(f"cast(conv(hex(substring(key, s * {width} + 1, {width})), 16, 10) as bigint)").alias("id")))
    spelled = spelled.join(dictionary.select("id", "lang", "word"), "id").groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "word"))), lambda x: x["word"].cast("string")), " ").alias("phrase")
    )
    out = kept.join(spelled, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if top is not None:
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        for salts in (*SALTS, 1):
            part = Window.partitionBy("lang", "_salt").orderBy(*order)
            salted = out.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
            out = salted.withColumn("rank", F.row_number().over(part).cast("bigint")).where(F.col("rank") <= top).drop("_salt")
    ranks = ["rank"] if top is not None else []
    return out.join(sizes, "lang").select("lang", *ranks, "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
texts AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws)) AS n FROM texts GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts),
grams AS (SELECT lang, ws[i:i + k - 1] AS ph, count(*) AS f FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY 1, 2 HAVING count(*) >= 10),
cuts AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM grams WHERE len(ph) > 1),
scored AS (
  SELECT c.lang, c.ph, c.a, c.k, x.f AS l, y.f AS r, (1000000 * c.a::HUGEINT * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.ph = c.ph[1:c.k] JOIN grams y ON y.lang = c.lang AND y.ph = c.ph[c.k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, ph[s:s + 1] AS ph, max(f) AS most FROM (SELECT lang, ph, f, unnest([1, 2]) AS s FROM grams WHERE len(ph) = 3) GROUP BY 1, 2),
kept AS (
  SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.ph = b.ph
  WHERE len(b.ph) = 3 OR i.most IS NULL OR 100 * i.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n::BIGINT AS n, r.score::BIGINT AS score FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE r.rank <= 2000
"""
