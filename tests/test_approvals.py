"""Approvals of documents whose registry key is not their digest."""

import parity
import pytest
from pyspark.sql import functions as F

from sparkfolio.plans.catalog import load

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["approved_manifest", "approved_keys", "approval_outcomes"])
def test_copies_stored_under_a_later_id(spark, tmp_path, name):
    """Document 7 is not stored, its copies 10 and 12 are, under the key 10; 8 and 11 have no text."""
    text = F.when(F.col("doc_id").isin(7, 10, 12), "same").when(~F.col("doc_id").isin(8, 11), F.concat(F.lit("text "), F.col("doc_id")))
    docs = spark.range(20).select(F.col("id").alias("doc_id")).withColumn("text", text).withColumn("lang", F.lit("en"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run, sql = load()[name]
    assert parity.differences(run(spark, str(tmp_path)), sql, SF, {"documents": docs.toPandas()}) is None


def test_judged_without_sorting_rows(spark):
    """A submission's rows are aggregated as they come: a sort would hold all of a task's rows, 27 a document."""
    judged = load()["approvals"][0](spark, SF)
    assert "SortAggregate" not in judged._jdf.queryExecution().executedPlan().toString()
