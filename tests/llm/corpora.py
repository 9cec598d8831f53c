"""Small awkward corpora, and brute-force versions of the operators' contracts."""

import hashlib
import random
from collections import Counter

import xxhash

SEP = b" \t\n\x0b\x0c\r"


def awkward(seed=1, n=60, vocabulary=400):
    """(doc_id, text, source): random prose with shared passages, copies, edits, nulls and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéñ漢") for _ in range(r.randint(1, 6)))
    words = [word() for _ in range(vocabulary)]
    prose = lambda k: [r.choice(words) for _ in range(k)]
    shared = [prose(r.randint(20, 120)) for _ in range(4)]
    rows, texts = [], []
    for i in range(n):
        w = prose(r.randint(0, 260))
        for _ in range(r.randint(0, 2)):
            k, s = r.randint(0, len(w)), r.choice(shared)
            a = r.randint(0, 20)
            w[k:k] = s[a : len(s) - r.randint(0, 20)]
        if texts and r.random() < 0.3:
            w = list(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = word()
        texts.append(w)
        rows.append((i, "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w), f"src{0 if r.random() < 0.4 else r.randint(1, 4)}"))
    rows += [(n, None, None), (n + 1, "", "src1"), (n + 2, " \n\t", "src9"), (n + 3, "ab " * 300, "src1"), (n + 4, "a" * 900, None)]
    rows += [(n + 5, "x y z w\x1c", "src2"), (None, "alone here", "src3"), rows[0], rows[1], rows[1], (3, "another text under a used id", "src1")]
    return rows


def frame(spark, rows):
    """With columns whose names clash with internal and result names."""
    schema = "doc_id bigint, text string, source string, n_words string, d string, v int, kept_text int, a int, spans string, fp int"
    return spark.createDataFrame([(*x, "x", None, 1, 2, 3, "s", 4) for x in rows], schema).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, lang string, n_chars bigint")


def removed(sequences, length):
    """Flags of the items that lie in a window of ``length`` which starts twice or more."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def substrings(rows, length):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    out = []
    for (i, *_), w, gone in zip(rows, texts, removed(texts, length)):
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def byte_strings(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for (i, *_), w, gone in zip(rows, texts, removed(texts, length)):
        kept = bytes(x for x, g in zip(w, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((i, len(w), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, shingle):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    k = min(shingle, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def near(rows, shingle, radius):
    fps = [simhash(t, shingle) for _, t, *_ in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= radius:
                comp[root(i)] = root(j)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return [(i, f"{f:016x}", low.get(root(k))) for k, ((i, *_), f) in enumerate(zip(rows, fps))]


def alike(x, y, shingle, at_least):
    a, b = ({tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle, 0) + 1)} for w in (x.encode().lower().split(), y.encode().lower().split()))
    return len(a & b) >= at_least * len(a | b)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))
