"""The trie of conversations against brute force, over one block and many, and its query against SQL."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import parity  # noqa: E402
from sparkfolio.llm import prefix_trie, queries  # noqa: E402

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, key int"


def brute(conversations):
    """Nodes of (id, [(role, text), ...]) rows."""
    members = defaultdict(list)
    for i, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((i, len(turns)))
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        n, saved = int(not kids[p]), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in kids[p]:
            a, b = below(q)
            n, saved = n + a, saved + b
        return n, saved

    for p, m in members.items():
        ends = ",".join(map(str, sorted(i for i, n in m if n == len(p))))
        leaves, saved = below(p)
        up = min(i for i, _ in members[p[:-1]]) if p else None
        yield min(i for i, _ in m), len(p), up, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()


def conversations(seed, n, hot):
    r = random.Random(seed)
    turn = lambda: (r.choice(["user", "assistant", ""]), r.choice(["", "a", "b", "é漢", "long " * 5]))
    out, shared = [], [turn() for _ in range(6)]
    for i in range(n):
        if r.random() < hot:
            turns = list(shared)
        elif out and r.random() < 0.6:
            old = r.choice(out)[1]
            turns = old[: r.randint(0, len(old))] + [turn() for _ in range(r.randint(0, 3))]
        else:
            turns = [turn() for _ in range(r.choice([0, 1, 2, 3, 30]))]
        out.append((r.randrange(10**9) * 1000 + i, turns))
    return out


def frame(spark, rows):
    table = spark.createDataFrame([(i, k, r or None, t or None, "x", 1) for i, turns in rows for k, (r, t) in enumerate(turns)], TURNS)
    turned = prefix_trie.sequences(table.repartition(5))
    none = spark.createDataFrame([(i, None) for i, turns in rows if not turns], "conv_id bigint, steps array<struct<key: binary, bytes: bigint>>")
    return turned.unionByName(none)


@pytest.mark.parametrize(("seed", "n", "hot", "parts"), [(1, 60, 0, 1), (2, 200, 0.3, 8), (3, 150, 0.9, 16), (4, 9, 0, 16), (5, 300, 0.1, 3), (6, 120, 0.5, 40)])
def test_nodes_equal_brute_force(spark, seed, n, hot, parts):
    rows = conversations(seed, n, hot)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = [tuple(x) for x in prefix_trie.prefix_trie(frame(spark, rows)).select(*FIELDS).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_orders_nulls_and_repeated_rows(spark):
    rows = [(1, 2, "b", "y"), (1, None, None, "first"), (1, 2, "a", "z"), (1, 2, "a", "z"), (None, 1, "user", "nobody's"), (2, None, "", "first"), (3, 0, None, None)]
    got = prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame([(*x, "x", 1) for x in rows], TURNS)))
    want = brute([(1, [("", "first"), ("a", "z"), ("a", "z"), ("b", "y")]), (2, [("", "first")]), (3, [("", "")])])
    key = lambda x: tuple((v is None, v) for v in x)
    assert got.columns == FIELDS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a:b", "c"), (4, 0, "a", "b:c")]
    assert prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame([(*x, "x", 1) for x in rows], TURNS))).count() == 5


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(prefix_trie.sequences(spark.createDataFrame([], TURNS))).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert parity.differences(queries.op11_prefix_trie(spark, sf), queries.ORACLE_SQL["op11_prefix_trie"], sf) is None
