"""Cohorts, means of means, leaders, speedups, frontiers and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_mean(value: str, scale: int = 6) -> Column:
    """Mean that does not depend on the order of rows: a decimal sum over a count."""
    return F.sum(F.col(value).cast(f"decimal(28,{scale})")).cast("double") / F.count(value)


def arm_means(runs: DataFrame, arm: str, values: list[str], ok: Column) -> DataFrame:
    """Means over successful runs of each arm, rounded to two decimals, with completed and requested counts."""
    told = runs.groupBy(arm).agg(F.count_if(ok).alias("completed"), F.count(F.lit(1)).alias("requested"), *[exact_mean_if(v, ok).alias(f"mean_{v}") for v in values])
    return told.withColumns({f"mean_{v}": F.round(F.col(f"mean_{v}").cast("decimal(28,6)"), 2).cast("double") for v in values})


def exact_mean_if(value: str, ok: Column, scale: int = 6) -> Column:
    kept = F.when(ok, F.col(value))
    return F.sum(kept.cast(f"decimal(28,{scale})")).cast("double") / F.nullif(F.count(kept), F.lit(0))


def matched_cohort(runs: DataFrame, report: list[str], strategy: str, strategies: DataFrame) -> DataFrame:
    """Runs of reports that every strategy of ``strategies`` scored: relational division."""
    wanted = strategies.select(strategy).distinct()
    present = runs.join(wanted, strategy, "left_semi").select(*report, strategy).distinct()
    full = present.groupBy(*report).agg(F.count(F.lit(1)).alias("k")).join(wanted.agg(F.count(F.lit(1)).alias("n"))).where("k = n")  # one row on the right
    return runs.join(wanted, strategy, "left_semi").join(full.select(*report), report, "left_semi")


def mean_of_means(runs: DataFrame, group: list[str], unit: list[str], values: list[str]) -> DataFrame:
    """Mean within each unit, then over units, nulls dropped at each level; with units and observations."""
    inner = runs.groupBy(*group, *unit).agg(F.count(F.lit(1)).alias("k"), *[exact_mean(v).alias(v) for v in values])
    return inner.groupBy(*group).agg(
        F.count(F.lit(1)).alias("units"), F.sum("k").alias("observations"), *[F.round(exact_mean(v, 10), 6).alias(v) for v in values]
    )


def leaders(stats: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """Rows that tie for the best value as displayed with one decimal, halves up."""
    shown = F.floor(F.col(metric) * 10 + 0.5) / 10
    ranked = stats.where(F.col(metric).isNotNull()).withColumn("displayed", shown)
    top = ranked.groupBy(*(by or [])).agg(F.max("displayed").alias("top"))
    joined = ranked.join(top, by) if by else ranked.join(F.broadcast(top))
    return joined.where("displayed = top").drop("top")


def speedup(stats: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Each arm's time against the arm ``baseline``, else the first by key."""
    first = W.orderBy(F.when(F.col(key) == baseline, 0).otherwise(1), key)
    return stats.withColumn("baseline", F.first(value).over(first)).withColumn("speedup", F.round(F.col("baseline") / F.nullif(F.col(value), F.lit(0.0)), 4))


def composition(stats: DataFrame) -> DataFrame:
    """Three parts of 100 from accuracy and coverage: exact, answered but not exact, missing."""
    exact = F.least(F.lit(100.0), F.greatest(F.lit(0.0), "accuracy"))
    covered = F.least(F.lit(100.0), F.greatest(exact, F.col("coverage")))
    return stats.withColumn("exact_part", F.round(exact, 4)).withColumn("inexact_part", F.round(covered - exact, 4)).withColumn("missing_part", F.round(100 - covered, 4))


def frontier(stats: DataFrame, speed: str, quality: str) -> DataFrame:
    """Quadrants at the upper medians: sorted[floor(n / 2)]. ``stats`` is a small report."""
    split = stats.agg(*[F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int")).alias(f"split_{c}") for c in (speed, quality)])
    joined = stats.join(F.broadcast(split))
    fast, good = F.col(speed) <= F.col(f"split_{speed}"), F.col(quality) >= F.col(f"split_{quality}")
    return joined.withColumn("quadrant", F.when(fast & good, "fast and accurate").when(fast, "fast").when(good, "accurate").otherwise("neither"))


def latest(runs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest run of each key."""
    return runs.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def workspace_filter(runs: DataFrame, workspace: str) -> DataFrame:
    return runs.where(F.coalesce(F.nullif(F.col("workspace_id"), F.lit("")), F.lit("legacy-public")) == workspace)


def relabel(runs: DataFrame, strategies: DataFrame) -> DataFrame:
    """Known strategy keys stay; others resolve by run-id prefix, else S2* to s2, else s1."""
    keys = strategies.select(F.col("strategy").alias("known"), "experiment", "parser")
    prefixes = strategies.select("prefix", F.col("strategy").alias("by_prefix"))
    head = F.regexp_extract("run_id", "^([A-Z0-9]+)_", 1)
    named = runs.withColumn("prefix", head).join(prefixes, "prefix", "left")
    known = named.join(keys.select(F.col("known").alias("k")), F.col("strategy") == F.col("k"), "left")
    fixed = F.coalesce("k", "by_prefix", F.when(F.col("prefix").startswith("S2"), "s2").otherwise("s1"))
    return known.withColumn("strategy", fixed).drop("k", "by_prefix", "prefix").join(keys, F.col("strategy") == F.col("known")).drop("known")


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose joined columns contain the words, whatever their case."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))
