"""Rows without ids of their own, of string ids, and many equal rows."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpora  # noqa: E402
from sparkfolio.llm import common, decontamination, substring_rlz, suffix_doubling  # noqa: E402


def dedup(docs, length):
    words = substring_rlz.dedup_substrings(docs, length=length).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    raw = suffix_doubling.dedup_bytes(docs, length=4 * length)
    return corpora.ordered(words.collect()), corpora.ordered(raw.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256)).collect())


def test_keys_of_many_rows_without_ids_differ(spark):
    n = 400_000
    rows = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert rows.select(*common.row_key("doc_id", "text")).distinct().count() == n
    same = rows.withColumn("doc_id", F.lit(7))
    assert same.select(*common.row_key("doc_id", "text")).distinct().count() == n


def test_rows_without_ids(spark):
    rows = [(None, t, s) for _, t, s in corpora.awkward(seed=8, n=40)]
    words, raw = dedup(corpora.frame(spark, rows), 12)
    assert words == corpora.ordered(corpora.substrings(rows, 12))
    assert raw == corpora.ordered(corpora.byte_strings(rows, 48))


def test_string_ids(spark):
    rows = [(f"doc-{k}", t, s) for k, (_, t, s) in enumerate(corpora.awkward(seed=9, n=30))]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    words, raw = dedup(docs, 12)
    assert words == corpora.ordered(corpora.substrings(rows, 12))
    assert raw == corpora.ordered(corpora.byte_strings(rows, 48))


def test_many_equal_rows_and_one_that_shares_a_part(spark):
    r = [f"w{k}" for k in range(300)]
    rows = [(5, " ".join(r), "a")] * 400 + [(6, " ".join(r[100:180] + ["other"] * 5), "a"), (7, "of its own", "b")]
    words, raw = dedup(corpora.frame(spark, rows), 35)
    assert words == corpora.ordered(corpora.substrings(rows, 35))
    assert raw == corpora.ordered(corpora.byte_strings(rows, 140))
    items = spark.createDataFrame([(1, " ".join(r[50:90]))], "item_id bigint, text string")
    assert {x.doc_id for x in decontamination.find_overlaps(corpora.frame(spark, rows), items).collect()} == {5}
