"""Runs of mixed marks, against SQL on DuckDB."""

import sys
from pathlib import Path

import pandas as pd

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
import corpora  # noqa: E402
import parity  # noqa: E402
from sparkfolio.llm import quality_rules  # noqa: E402


def test_mixed_marks_count_as_shouts(spark):
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(9))
    rows = [(k, f"{body}\n{line}", "a") for k, line in enumerate(("Really?! What!? No?!", "So!? it is?!", "What? No! Yes.", "Now!! Or?! Else", "one two three four five six seven?!"))]
    frame = pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    got = quality_rules.judge(corpora.frame(spark, rows))
    assert parity.differences(got.drop("clean_text"), quality_rules.SQL, "/root/testdata/sf0.001", {"documents": frame}) is None
    told = {r.doc_id: r.clean_text for r in got.collect()}
    assert [told[k] == rows[k][1] for k in range(5)] == [False, False, True, False, True]
