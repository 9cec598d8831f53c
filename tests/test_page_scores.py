"""Page scores: texts are looked at once, and what a pattern needs is no filter of its own."""

from pyspark.sql import functions as F

from sparkfolio.operators import ranking as R
from sparkfolio.plans.catalog import load

SF = "/root/testdata/sf0.001"


def test_later_plans_read_what_was_told_of_a_page(spark):
    plan = load()["page_score_bm25"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "benchmark.parquet" in plan and "documents.parquet" not in plan


def test_needed_texts_leave_out_no_match(spark):
    lines = [
        "# The Balance Sheets", "## financial POSITION", "### Goodwill", "CONSOLIDATED balance sheet", "Statements of Financial Position", "notes to the Consolidated Financial Statements",
        "連結貸借対照表", "財務諸表", "資産の部", "PROXY statement", "Board OF Directors", "executive compensation", "Shareholder Proposal", "corporate Governance", "Table of Contents",
        "取締役", "役員の状況", "コーポレート・ガバナンス", "株主総会", "目次", "Operating lease Right-of-use Assets", "RIGHT OF USE ASSET", "市場価格のない株式等", "減価償却累計額", "金銭債権の連結決算日後の償還予定額", "x\n | a | b |\ny", "plain", "", None,
    ]
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    patterns = [*R.HEADINGS, *R.REJECTS, *(p for _, p in R.CRITICAL), R.TABLE_ROW]
    text = F.col("text")
    got = rows.select([F.struct(text.rlike(p), R._matches(text, F.lower(text), p)).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    assert all(a == b for row in got for a, b in row)
    assert all(any(row[k][0] for row in got) for k in range(len(patterns)))
