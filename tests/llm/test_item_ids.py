"""Benchmark items without an id are found like any others."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent)]
import corpora  # noqa: E402
from sparkfolio.llm import decontamination  # noqa: E402


def test_items_of_null_and_repeated_ids(spark):
    passage = {k: " ".join(f"{k}{j}" for j in range(20)) for k in "abc"}
    items = [(None, passage["a"]), (None, passage["b"]), (7, passage["c"]), (7, "other words " * 10)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(i, f"pre {passage[k]} post", "s") for i, k in enumerate("abc")] + [(9, "nothing of it", "s")]
    got = decontamination.find_overlaps(corpora.frame(spark, docs), bench)
    assert {(r.doc_id, r.item_id, r.n_matched) for r in got.collect()} == {(0, None, 20), (1, None, 20), (2, 7, 20)}
