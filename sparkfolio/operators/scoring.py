"""Confidence gate, scoring against gold, reconciliation, consensus and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio_percent

# Acceptance and tolerance rules.
ACCEPT, FALLBACK_TOLERANCE, EPSILON = 0.8, 0.5, 1e-9


def accepted(confidence: Column, answer: Column) -> Column:
    """An answer is accepted unless its confidence is known to be low."""
    return (confidence.isNull() | (confidence >= ACCEPT)) & answer.isNotNull()


def confidence_gate(rows: DataFrame) -> DataFrame:
    """Adds ``accepted`` to (…, answer, confidence); values stay as they are."""
    return rows.withColumn("accepted", accepted(F.col("confidence"), F.col("answer")))


def score_runs(rows: DataFrame, gold: DataFrame, on: list[str], by: list[str], schema_rows: int = 27) -> DataFrame:
    """Metrics of each run: (by…, on…, answer, confidence, quantum) against (on…, gold).

    Rows without gold count as filled, not as compared; gold without a row does
    not count. Empty denominators give null.
    """
    joined = confidence_gate(rows).join(gold, on, "left")
    compared = F.col("gold").isNotNull()
    committed = compared & F.col("answer").isNotNull()
    tolerance = F.when(F.col("quantum") > 0, F.col("quantum") / 2 + EPSILON).otherwise(FALLBACK_TOLERANCE)
    exact = committed & (F.abs(F.col("answer") - F.col("gold")) <= tolerance)
    sums = joined.groupBy(*by).agg(
        F.count_if(F.col("answer").isNotNull()).alias("filled"),
        F.count_if("accepted").alias("accepted_filled"),
        F.count_if(compared).alias("compared"),
        F.count_if(committed).alias("committed"),
        F.count_if(exact).alias("exact"),
        F.count_if(exact & F.col("accepted")).alias("accepted_exact"),
        F.count_if(committed & F.col("accepted")).alias("accepted_committed"),
    )
    percent = {
        "accuracy": ("exact", F.col("compared")),
        "coverage": ("filled", F.lit(schema_rows)),
        "precision": ("exact", F.col("committed")),
        "accepted_accuracy": ("accepted_exact", F.col("compared")),
        "accepted_coverage": ("accepted_filled", F.lit(schema_rows)),
        "accepted_precision": ("accepted_exact", F.col("accepted_committed")),
    }
    return sums.withColumns({k: ratio_percent(F.col(a), b) for k, (a, b) in percent.items()})


def rescore(rows: DataFrame, keys: DataFrame, year: str, on: list[str], by: list[str]) -> DataFrame:
    """``score_runs`` against the key of another fiscal year. ``keys``: year, on…, gold."""
    return score_runs(rows, keys.where(F.col("year") == year).drop("year"), on, by)


def resolve_gold(runs: DataFrame, assignment: DataFrame, audited: DataFrame, approved: DataFrame) -> DataFrame:
    """The gold key of each run (run_id, sha, company_key, fiscal_year, currency), first match wins:
    assignment by company, year and currency; audited by digest, company, year and currency;
    approved by digest and currency. Keys carry ``quantum``; audited ones default to 1, approved ones to 0."""
    a = assignment.select("company_key", "fiscal_year", "currency", F.lit("assignment").alias("g1"), F.col("quantum").alias("q1"))
    b = audited.select("sha", "company_key", "fiscal_year", "currency", F.lit("audited").alias("g2"), F.coalesce("quantum", F.lit(1.0)).alias("q2"))
    c = approved.select("sha", "currency", F.lit("approved").alias("g3"), F.coalesce("quantum", F.lit(0.0)).alias("q3"))
    joined = runs.join(a, ["company_key", "fiscal_year", "currency"], "left").join(b, ["sha", "company_key", "fiscal_year", "currency"], "left").join(c, ["sha", "currency"], "left")
    quantum = F.when(F.col("g1").isNotNull(), F.col("q1")).when(F.col("g2").isNotNull(), F.col("q2")).otherwise(F.col("q3"))
    return joined.select(*runs.columns, F.coalesce("g1", "g2", "g3").alias("gold_source"), quantum.alias("gold_quantum"))


def last_values(rows: DataFrame, by: list[str]) -> DataFrame:
    """The last value of each (by…, item) in ``ord`` order, nulls included."""
    return rows.groupBy(*by, "item").agg(F.max_by(F.struct("value"), "ord").alias("x")).select(*by, "item", F.col("x.value").alias("value"))


def reconcile(values: DataFrame, edges: DataFrame, by: list[str], quantum: float = 0.0, fallback: Column | float = FALLBACK_TOLERANCE) -> DataFrame:
    """A check for each (by…, total): ok, failed, or skipped where a value is missing.

    ``values``: by…, item, value, one row an item. ``edges``: total, part, leaves
    (small, a constant dimension). Printed lines rounded to ``quantum`` may each
    be off by half of it: a total of n leaves tolerates (n + 1) * quantum / 2.
    """
    keys = values.select(*by).distinct()
    wanted = keys.crossJoin(F.broadcast(edges))  # 26 edges at most: a constant dimension
    parts = wanted.join(values.select(*by, F.col("item").alias("part"), "value"), [*by, "part"], "left")
    sums = parts.groupBy(*by, "total").agg(F.sum("value").alias("computed"), F.count_if(F.col("value").isNull()).alias("missing"), F.first("leaves").alias("leaves"))
    joined = sums.join(values.select(*by, F.col("item").alias("total"), F.col("value").alias("stated")), [*by, "total"], "left")
    return judge(joined, quantum, fallback)


def judge(sums: DataFrame, quantum: float = 0.0, fallback: Column | float = FALLBACK_TOLERANCE) -> DataFrame:
    """Status of (…, computed, missing, leaves, stated)."""
    skipped = F.col("stated").isNull() | (F.col("missing") > 0)
    tolerance = (F.col("leaves") + 1) * (quantum / 2) + EPSILON if quantum > 0 else (fallback if isinstance(fallback, Column) else F.lit(fallback))
    delta = F.col("computed") - F.col("stated")
    return (
        sums.withColumn("computed", F.when(~skipped, F.col("computed")))
        .withColumn("delta", F.when(~skipped, F.bround(delta, 2)))
        .withColumn("status", F.when(skipped, "skipped").when(F.abs(delta) <= tolerance, "ok").otherwise("failed"))
    )


def reconciliation_report(checks: DataFrame, by: list[str]) -> DataFrame:
    """evaluated, passed, failed, skipped, consistency and a line of summary."""
    told = checks.groupBy(*by).agg(
        F.count_if(F.col("status") != "skipped").alias("evaluated"),
        F.count_if(F.col("status") == "ok").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("total")))), ", ").alias("failed_identities"),
    )
    share = F.concat(F.col("passed").cast("string"), F.lit("/"), F.col("evaluated").cast("string"))
    line = (
        F.when(F.col("evaluated") == 0, "no identity could be checked (too many null values)")
        .when(F.col("failed") == 0, F.concat(F.lit("all "), share, F.lit(" arithmetic identities hold")))
        .otherwise(F.concat(share, F.lit(" identities hold; failed: "), F.col("failed_identities")))
    )
    return told.withColumn("consistency", ratio_percent(F.col("passed"), F.col("evaluated"))).withColumn("summary", line)


def consensus(passes: DataFrame, by: list[str], requested: int) -> DataFrame:
    """One row for each (by…) from its passes (pass, value, confidence, evidence).

    The answer is the median; passes within max(0.5, 0.1%) of it agree; evidence
    is that of the nearest pass, the first on ties. ``stability``: exact (all
    requested passes gave one value), stable (two or more agree), disagreement, missing.
    """
    median = passes.groupBy(*by).agg(F.expr("percentile(value, 0.5)").alias("answer"))
    joined = passes.join(median, by)
    off = F.abs(F.col("value") - F.col("answer"))
    near = off <= F.greatest(F.lit(0.5), F.abs("answer") * 0.001)
    told = joined.groupBy(*by).agg(
        F.first("answer").alias("answer"),
        F.count("value").alias("numeric_passes"),
        F.count_distinct("value").alias("distinct_values"),
        F.count_if(near).alias("agreeing"),
        F.sum(F.when(near, F.col("confidence")).cast("decimal(18,6)")).cast("double").alias("agreed_confidence"),
        F.min_by("evidence", F.when(off.isNotNull(), F.struct(off, "pass"))).alias("evidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "value"))), lambda x: x["value"]).alias("pass_values"),
    )
    stability = (
        F.when(F.col("numeric_passes") == 0, "missing")
        .when((F.col("numeric_passes") == requested) & (F.col("distinct_values") == 1), "exact")
        .when(F.col("agreeing") >= 2, "stable")
        .otherwise("disagreement")
    )
    share = F.col("agreeing") / F.lit(float(requested))
    confidence = F.when(F.col("agreeing") > 0, F.bround(F.col("agreed_confidence") / F.col("agreeing") * share, 6)).otherwise(0.0)
    return told.withColumn("stability", stability).withColumn("confidence", confidence).withColumn("agreement", F.bround(share, 6)).drop("distinct_values", "agreed_confidence")


def calibration(rows: DataFrame) -> DataFrame:
    """Observed correctness in each confidence bin of (confidence, correct)."""
    # Bin edges.
    c = F.col("confidence")
    label = F.when(c < 0.5, "<.5").when(c < 0.7, ".5-.7").when(c < 0.8, ".7-.8").when(c < 0.9, ".8-.9").when(c < 0.95, ".9-.95").otherwise(">=.95")
    told = rows.where(c.isNotNull()).groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    return told.withColumn("percent_correct", ratio_percent(F.col("n_correct"), F.col("n")))
