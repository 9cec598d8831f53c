"""Queries that score, reconcile, compare and rank; events stand for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import analytics as A
from ..operators import scoring as S
from .catalog import query, table


def _values(rows) -> str:
    show = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(show(x) for x in r) + ")" for r in rows) + ")"


EDGES_SQL = _values([(k, t, p, dims.leaves(t)) for k, (t, parts) in enumerate(dims.IDENTITIES) for p in parts]) + " AS edges(total_ord, total, part, leaves)"
SCHEMA_SQL = _values([(k, *r) for k, r in enumerate(dims.SCHEMA)]) + " AS schema_dim(ord, classification, subclassification, item)"


def mean_sql(value: str, scale: int = 6) -> str:
    return f"(sum({value}::DECIMAL(28, {scale}))::DOUBLE / nullif(count({value}), 0))"


def percent_sql(part: str, whole: str) -> str:
    return f"round_even({part}::DOUBLE / nullif({whole}, 0) * 100, 1)"


@query(
    "reconcile_identities",
    """WITH parts AS (SELECT l_orderkey, sum((l_extendedprice::DECIMAL(18, 2) * (1 - l_discount::DECIMAL(18, 2)) * (1 + l_tax::DECIMAL(18, 2)))::DECIMAL(38, 6))::DOUBLE AS computed, count(*) AS leaves FROM lineitem GROUP BY l_orderkey),
joined AS (SELECT o_orderkey, o_totalprice AS stated, computed, leaves FROM orders LEFT JOIN parts ON l_orderkey = o_orderkey)
SELECT o_orderkey, stated, round(computed, 2) AS computed, round(computed - stated, 1) AS delta,
  CASE WHEN stated IS NULL OR computed IS NULL THEN 'skipped' WHEN abs(computed - stated) <= 0.1::DOUBLE * stated THEN 'ok' ELSE 'failed' END AS status FROM joined""",
)
def reconcile_identities(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)")) * (1 + F.col("l_tax").cast("decimal(18,2)"))
    parts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price.cast("decimal(38,6)")).cast("double").alias("computed"), F.count(F.lit(1)).alias("leaves"))
    sums = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated")).join(parts, "o_orderkey", "left")
    sums = sums.withColumn("missing", F.when(F.col("computed").isNull(), 1).otherwise(0))
    told = S.judge(sums, fallback=F.col("stated") * 0.1)
    return told.select("o_orderkey", "stated", F.round("computed", 2).alias("computed"), F.round(F.col("computed") - F.col("stated"), 1).alias("delta"), "status")


_CHECKS = f"""given AS (SELECT source, (doc_id // 20) % 29 AS ord, sum(n_chars)::DOUBLE AS value FROM documents GROUP BY ALL),
schema_rows AS (SELECT * FROM {SCHEMA_SQL}), edge_rows AS (SELECT * FROM {EDGES_SQL}),
vals AS (SELECT source, item, value FROM given JOIN schema_rows USING (ord)),
parts AS (SELECT k.source, e.total, max(e.leaves) AS leaves, sum(v.value) AS computed, count(*) FILTER (v.value IS NULL) AS missing
  FROM (SELECT DISTINCT source FROM vals) k CROSS JOIN edge_rows e LEFT JOIN vals v ON v.source = k.source AND v.item = e.part GROUP BY k.source, e.total),
checks AS (SELECT p.source, p.total, CASE WHEN s.value IS NULL OR missing > 0 THEN 'skipped' WHEN abs(computed - s.value) <= (leaves + 1) * 500::DOUBLE + 1e-9 THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN s.value IS NOT NULL AND missing = 0 THEN round_even(computed - s.value, 2) END AS delta FROM parts p LEFT JOIN vals s ON s.source = p.source AND s.item = p.total)"""


def _checks(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "documents").groupBy("source", (F.floor(F.col("doc_id") / 20) % 29).alias("ord")).agg(F.sum("n_chars").cast("double").alias("value"))
    named = given.join(F.broadcast(dims.schema_dim(spark)), "ord")  # 27 rows
    values = S.last_values(named.select("source", "ord", "item", "value"), ["source"])
    return S.reconcile(values, dims.edges_dim(spark), ["source"], quantum=1000.0)


@query("reconcile_schema", f"WITH {_CHECKS} SELECT source, total, status, delta FROM checks")
def reconcile_schema(spark: SparkSession, folder: str) -> DataFrame:
    return _checks(spark, folder).select("source", "total", "status", "delta")


@query(
    "reconciliation_report",
    f"""WITH {_CHECKS}, told AS (SELECT source, count(*) FILTER (status <> 'skipped') AS evaluated, count(*) FILTER (status = 'ok') AS passed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'skipped') AS skipped, coalesce(string_agg(total, ', ' ORDER BY total) FILTER (status = 'failed'), '') AS failed_identities FROM checks GROUP BY source)
SELECT *, {percent_sql("passed", "evaluated")} AS consistency, CASE WHEN evaluated = 0 THEN 'no identity could be checked (too many null values)' WHEN failed = 0 THEN 'all ' || passed || '/' || evaluated || ' arithmetic identities hold'
  ELSE passed || '/' || evaluated || ' identities hold; failed: ' || failed_identities END AS summary FROM told""",
)
def reconciliation_report(spark: SparkSession, folder: str) -> DataFrame:
    return S.reconciliation_report(_checks(spark, folder), ["source"])


@query(
    "leaf_counts",
    f"""WITH RECURSIVE edge_rows AS (SELECT * FROM {EDGES_SQL}), tree AS (SELECT total, part FROM edge_rows UNION ALL SELECT t.total, e.part FROM tree t JOIN edge_rows e ON e.total = t.part)
SELECT total, count(*) AS leaves FROM tree WHERE part NOT IN (SELECT total FROM edge_rows) GROUP BY total""",
)
def leaf_counts(spark: SparkSession, folder: str) -> DataFrame:
    edges = dims.edges_dim(spark).select("total", "part")
    inner = edges.select(F.col("total").alias("part"), F.col("part").alias("p2"))
    level = edges
    for _ in range(2):  # identities nest three deep at most
        level = level.join(inner, "part", "left").select("total", F.coalesce("p2", "part").alias("part"))
    return level.groupBy("total").agg(F.count(F.lit(1)).alias("leaves"))


@query(
    "confidence_gate",
    "SELECT event_id, value, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 101) / 100.0::DOUBLE END AS confidence, (event_id % 13 = 0 OR (event_id % 101) / 100.0::DOUBLE >= 0.8) AND value IS NOT NULL AND event_id % 17 <> 0 AS accepted FROM events",
)
def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("confidence", F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 101) / 100.0)).withColumn("answer", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return S.confidence_gate(events).select("event_id", "value", "confidence", "accepted")


_SCORED = f"""rows AS (SELECT d.doc_id, d.source, CASE WHEN d.doc_id % 9 = 0 THEN NULL WHEN d.n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer, (d.doc_id % 11) / 10.0::DOUBLE AS confidence, l.quality::DOUBLE AS gold
  FROM documents d LEFT JOIN labels l USING (doc_id)),
gated AS (SELECT *, confidence >= 0.8 AND answer IS NOT NULL AS accepted, gold IS NOT NULL AND answer IS NOT NULL AS committed, coalesce(abs(answer - gold) <= 0.5, false) AS exact FROM rows),
sums AS (SELECT source, count(answer) AS filled, count(*) FILTER (accepted) AS accepted_filled, count(gold) AS compared, count(*) FILTER (committed) AS committed, count(*) FILTER (exact) AS exact,
  count(*) FILTER (exact AND accepted) AS accepted_exact, count(*) FILTER (committed AND accepted) AS accepted_committed FROM gated GROUP BY source)"""


@query(
    "score_against_gold",
    f"""WITH {_SCORED} SELECT *, {percent_sql("exact", "compared")} AS accuracy, {percent_sql("filled", "50")} AS coverage, {percent_sql("exact", "committed")} AS precision,
{percent_sql("accepted_exact", "compared")} AS accepted_accuracy, {percent_sql("accepted_filled", "50")} AS accepted_coverage, {percent_sql("accepted_exact", "accepted_committed")} AS accepted_precision FROM sums""",
)
def score_against_gold(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        F.when(F.col("doc_id") % 9 != 0, F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0)).alias("answer"),
        ((F.col("doc_id") % 11) / 10.0).alias("confidence"),
        F.lit(0.0).alias("quantum"),
    )
    gold = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("gold"))
    return S.score_runs(rows, gold, ["doc_id"], ["source"], schema_rows=50)


@query(
    "gold_resolution",
    """SELECT doc_id AS run_id, CASE WHEN source = 'src3' AND n_chars % 5 = 2 AND lang = 'en' THEN 'assignment' WHEN l.quality = 1 AND lang IN ('en', 'fr') THEN 'audited' WHEN l.quality = 0 THEN 'approved' END AS gold_source,
  CASE WHEN source = 'src3' AND n_chars % 5 = 2 AND lang = 'en' THEN 0.001::DOUBLE WHEN l.quality = 1 AND lang IN ('en', 'fr') THEN 1.0::DOUBLE WHEN l.quality = 0 THEN 0.0::DOUBLE END AS gold_quantum
FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def gold_resolution(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    runs = docs.select(
        F.col("doc_id").alias("run_id"), F.concat(F.lit("sha-"), F.col("doc_id")).alias("sha"), F.col("source").alias("company_key"), (F.col("n_chars") % 5).cast("string").alias("fiscal_year"), F.col("lang").alias("currency")
    )
    assignment = spark.createDataFrame([("src3", "2", "en", 0.001)], "company_key string, fiscal_year string, currency string, quantum double")
    keyed = runs.join(labels.select(F.col("doc_id").alias("run_id"), "quality"), "run_id").withColumn("quantum", F.lit(None).cast("double"))
    audited = keyed.where("quality = 1 AND currency IN ('en', 'fr')")
    return S.resolve_gold(runs, assignment, audited, keyed.where("quality = 0")).select("run_id", "gold_source", "gold_quantum")


_PASSES = "passes AS (SELECT * FROM (SELECT user_id, event_type, event_id, value, (event_id % 10) / 10.0::DOUBLE AS confidence, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pass FROM events) WHERE pass <= 3)"
_CONSENSUS = f"""{_PASSES}, mid AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS answer FROM passes GROUP BY ALL),
near AS (SELECT *, abs(value - answer) AS off, abs(value - answer) <= greatest(0.5::DOUBLE, abs(answer) * 0.001::DOUBLE) AS near FROM passes JOIN mid USING (user_id, event_type)),
told AS (SELECT user_id, event_type, any_value(answer) AS answer, count(value) AS numeric_passes, count(DISTINCT value) AS kinds, count(*) FILTER (near) AS agreeing,
  (sum(confidence::DECIMAL(18, 6)) FILTER (near))::DOUBLE AS sure, arg_min(event_id, (off, pass)) AS evidence, string_agg(value::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY pass) AS pass_values FROM near GROUP BY user_id, event_type),
consensus AS (SELECT user_id, event_type, round(answer, 6) AS answer, numeric_passes, agreeing, evidence, pass_values,
  CASE WHEN numeric_passes = 0 THEN 'missing' WHEN numeric_passes = 3 AND kinds = 1 THEN 'exact' WHEN agreeing >= 2 THEN 'stable' ELSE 'disagreement' END AS stability,
  CASE WHEN agreeing > 0 THEN round_even(sure / agreeing * (agreeing / 3.0::DOUBLE), 6) ELSE 0.0 END AS confidence, round_even(agreeing / 3.0::DOUBLE, 6) AS agreement FROM told)"""


def _consensus(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = table(spark, folder, "events").withColumn("pass", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))).where("pass <= 3")
    passes = events.select("user_id", "event_type", "pass", "value", ((F.col("event_id") % 10) / 10.0).alias("confidence"), F.col("event_id").alias("evidence"))
    told = S.consensus(passes, ["user_id", "event_type"], 3)
    shown = F.array_join(F.transform("pass_values", lambda v: v.cast("decimal(18,2)").cast("string")), ",")
    return told.withColumn("answer", F.round("answer", 6)).withColumn("pass_values", shown)


@query("consensus_multi_pass", f"WITH {_CONSENSUS} SELECT * FROM consensus")
def consensus_multi_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder)


@query("consensus_summary", f"WITH {_CONSENSUS} SELECT stability, count(*) AS items FROM consensus GROUP BY stability")
def consensus_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).groupBy("stability").agg(F.count(F.lit(1)).alias("items"))


@query(
    "confidence_calibration",
    f"""WITH rows AS (SELECT CASE WHEN c < 0.5 THEN '<.5' WHEN c < 0.7 THEN '.5-.7' WHEN c < 0.8 THEN '.7-.8' WHEN c < 0.9 THEN '.8-.9' WHEN c < 0.95 THEN '.9-.95' ELSE '>=.95' END AS bin, quality
  FROM (SELECT (event_id % 101) / 100.0::DOUBLE AS c, quality FROM events JOIN labels ON labels.doc_id = events.event_id)),
told AS (SELECT bin, count(*) AS n, count(*) FILTER (quality = 1) AS n_correct FROM rows GROUP BY bin)
SELECT *, {percent_sql("n_correct", "n")} AS percent_correct FROM told""",
)
def confidence_calibration(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "events").join(table(spark, folder, "labels"), F.col("doc_id") == F.col("event_id"))
    return S.calibration(joined.select(((F.col("event_id") % 101) / 100.0).alias("confidence"), (F.col("quality") == 1).alias("correct")))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as runs: the user is the report, the event type the strategy."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("report"),
        F.col("event_type").alias("strategy"),
        F.to_date("ts").alias("day"),
        "ts",
        "value",
        F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("total_seconds"),
        F.when(F.col("event_id") % 6 != 1, F.least(F.lit(100.0), F.col("value") * 5)).alias("accuracy"),
        F.when(F.col("event_id") % 7 != 2, F.least(F.lit(100.0), F.col("value") * 8)).alias("coverage"),
    )


RUNS_SQL = """runs AS (SELECT event_id, user_id AS report, event_type AS strategy, ts::DATE AS day, ts, value, CASE WHEN event_id % 10 <> 3 THEN value END AS total_seconds,
  CASE WHEN event_id % 6 <> 1 THEN least(100.0::DOUBLE, value * 5) END AS accuracy, CASE WHEN event_id % 7 <> 2 THEN least(100.0::DOUBLE, value * 8) END AS coverage FROM events)"""


@query("arm_means", f"WITH {RUNS_SQL} SELECT strategy, count(*) FILTER (event_id % 6 <> 1) AS completed, count(*) AS requested, round({mean_sql('CASE WHEN event_id % 6 <> 1 THEN value END')}::DECIMAL(28, 6), 2)::DOUBLE AS mean_value, round({mean_sql('CASE WHEN event_id % 6 <> 1 THEN coverage END')}::DECIMAL(28, 6), 2)::DOUBLE AS mean_coverage FROM runs GROUP BY strategy")
def arm_means(spark: SparkSession, folder: str) -> DataFrame:
    return A.arm_means(runs(spark, folder), "strategy", ["value", "coverage"], F.col("event_id") % 6 != 1)


_COHORT = f"{RUNS_SQL}, full_days AS (SELECT report, day FROM runs GROUP BY report, day HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM runs)), cohort AS (SELECT runs.* FROM runs JOIN full_days USING (report, day))"


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    given = runs(spark, folder)
    return A.matched_cohort(given, ["report", "day"], "strategy", given.select("strategy"))


@query("matched_cohort", f"WITH {_COHORT} SELECT report, day::VARCHAR AS day, strategy, event_id FROM cohort")
def matched_cohort(spark: SparkSession, folder: str) -> DataFrame:
    return _cohort(spark, folder).select("report", F.col("day").cast("string").alias("day"), "strategy", "event_id")


def _means_sql(source: str, group: str, unit: str) -> str:
    return f"""inner_means AS (SELECT {group}, {unit}, count(*) AS k, {mean_sql("value")} AS value, {mean_sql("accuracy")} AS accuracy, {mean_sql("coverage")} AS coverage FROM {source} GROUP BY ALL),
means AS (SELECT {group}, count(*) AS units, sum(k)::BIGINT AS observations, round({mean_sql("value", 10)}, 6) AS value, round({mean_sql("accuracy", 10)}, 6) AS accuracy, round({mean_sql("coverage", 10)}, 6) AS coverage FROM inner_means GROUP BY {group})"""


@query("mean_of_means_parser", f"WITH {_COHORT}, {_means_sql('cohort', 'strategy', 'report, day')} SELECT * FROM means")
def mean_of_means_parser(spark: SparkSession, folder: str) -> DataFrame:
    return A.mean_of_means(_cohort(spark, folder), ["strategy"], ["report", "day"], ["value", "accuracy", "coverage"])


_ARM = f"{RUNS_SQL}, armed AS (SELECT *, CASE WHEN strategy IN ('click', 'view') THEN 'no_ocr' ELSE 'ocr' END AS experiment FROM runs)"


def _arms(spark: SparkSession, folder: str) -> DataFrame:
    armed = runs(spark, folder).withColumn("experiment", F.when(F.col("strategy").isin("click", "view"), "no_ocr").otherwise("ocr"))
    return A.mean_of_means(armed, ["experiment"], ["report", "strategy"], ["value", "accuracy", "coverage"])


@query("mean_of_means_arm", f"WITH {_ARM}, {_means_sql('armed', 'experiment', 'report, strategy')} SELECT * FROM means")
def mean_of_means_arm(spark: SparkSession, folder: str) -> DataFrame:
    return _arms(spark, folder)


_STATS = f"{RUNS_SQL}, {_means_sql('runs', 'strategy', 'report')}"


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    return A.mean_of_means(runs(spark, folder), ["strategy"], ["report"], ["value", "accuracy", "coverage"])


@query("metric_leaders_ties", f"WITH {_STATS}, shown AS (SELECT strategy, accuracy, floor(accuracy * 10 + 0.5::DOUBLE) / 10 AS displayed FROM means) SELECT * FROM shown WHERE displayed = (SELECT max(displayed) FROM shown)")
def metric_leaders_ties(spark: SparkSession, folder: str) -> DataFrame:
    return A.leaders(_stats(spark, folder).select("strategy", "accuracy"), "accuracy")


@query("metric_leaders_by_day", f"WITH {RUNS_SQL}, {_means_sql('runs', 'day, strategy', 'report')}, shown AS (SELECT day::VARCHAR AS day, strategy, floor(accuracy * 10 + 0.5::DOUBLE) / 10 AS displayed FROM means WHERE accuracy IS NOT NULL) SELECT * FROM shown s WHERE displayed = (SELECT max(displayed) FROM shown t WHERE t.day = s.day)")
def metric_leaders_by_day(spark: SparkSession, folder: str) -> DataFrame:
    stats = A.mean_of_means(runs(spark, folder), ["day", "strategy"], ["report"], ["accuracy"])
    return A.leaders(stats, "accuracy", ["day"]).select(F.col("day").cast("string").alias("day"), "strategy", "displayed")


@query("speedup_vs_baseline", f"WITH {_STATS} SELECT strategy, value, (SELECT value FROM means ORDER BY CASE WHEN strategy = 'view' THEN 0 ELSE 1 END, strategy LIMIT 1) AS baseline, round((SELECT value FROM means ORDER BY CASE WHEN strategy = 'view' THEN 0 ELSE 1 END, strategy LIMIT 1) / nullif(value, 0), 4) AS speedup FROM means")
def speedup_vs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return A.speedup(_stats(spark, folder).select("strategy", "value"), "strategy", "value", "view")


@query("coverage_composition", f"WITH {_STATS}, c AS (SELECT strategy, least(100.0::DOUBLE, greatest(0.0::DOUBLE, accuracy)) AS e, coverage FROM means) SELECT strategy, round(e, 4) AS exact_part, round(least(100.0::DOUBLE, greatest(e, coverage)) - e, 4) AS inexact_part, round(100 - least(100.0::DOUBLE, greatest(e, coverage)), 4) AS missing_part FROM c")
def coverage_composition(spark: SparkSession, folder: str) -> DataFrame:
    return A.composition(_stats(spark, folder)).select("strategy", "exact_part", "inexact_part", "missing_part")


@query("frontier_split", f"""WITH {_STATS}, split AS (SELECT list_sort(list(value))[count(value) // 2 + 1] AS sv, list_sort(list(accuracy))[count(accuracy) // 2 + 1] AS sa FROM means)
SELECT strategy, value, accuracy, CASE WHEN value <= sv AND accuracy >= sa THEN 'fast and accurate' WHEN value <= sv THEN 'fast' WHEN accuracy >= sa THEN 'accurate' ELSE 'neither' END AS quadrant FROM means, split""")
def frontier_split(spark: SparkSession, folder: str) -> DataFrame:
    return A.frontier(_stats(spark, folder), "value", "accuracy").select("strategy", "value", "accuracy", "quadrant")


@query("dashboard_headline", f"""WITH {_STATS}, lead AS (SELECT string_agg(strategy, ', ' ORDER BY strategy) AS leaders FROM means WHERE floor(accuracy * 10 + 0.5::DOUBLE) / 10 = (SELECT max(floor(accuracy * 10 + 0.5::DOUBLE) / 10) FROM means))
SELECT arg_min(strategy, (value, strategy)) AS fastest, max(accuracy) AS best_accuracy, leaders, CASE WHEN contains(leaders, ',') THEN 'tie: ' || leaders ELSE leaders || ' leads' END AS conclusion FROM means, lead GROUP BY leaders""")
def dashboard_headline(spark: SparkSession, folder: str) -> DataFrame:
    stats = _stats(spark, folder)
    lead = A.leaders(stats, "accuracy").agg(F.array_join(F.array_sort(F.collect_list("strategy")), ", ").alias("leaders"))
    head = stats.agg(F.min_by("strategy", F.struct("value", "strategy")).alias("fastest"), F.max("accuracy").alias("best_accuracy"))
    words = F.when(F.contains("leaders", F.lit(",")), F.concat(F.lit("tie: "), F.col("leaders"))).otherwise(F.concat(F.col("leaders"), F.lit(" leads")))
    return head.join(F.broadcast(lead)).withColumn("conclusion", words)  # one row each


@query("run_history_view", f"""WITH {RUNS_SQL}, shown AS (SELECT 'S' || event_id % 4 || '_' || event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 's3' ELSE 'old' END AS strategy, ts, value, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN 'team-alpha' WHEN 1 THEN '' END, ''), 'legacy-public') AS w FROM runs),
fixed AS (SELECT run_id, ts, value, CASE WHEN strategy = 's3' THEN 's3' WHEN starts_with(run_id, 'S1_') THEN 's1' WHEN starts_with(run_id, 'S2_') THEN 's2' WHEN starts_with(run_id, 'S3_') THEN 's3' ELSE 's1' END AS strategy FROM shown WHERE w = 'legacy-public')
SELECT run_id, strategy, CASE strategy WHEN 's1' THEN 'no_ocr' WHEN 's2' THEN 'ocr' ELSE 'intelligent_scan' END AS experiment, value, epoch_us(ts) AS at_us, value >= 8 AS accepted FROM fixed""")
def run_history_view(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 3
    shown = runs(spark, folder).select(
        F.concat(F.lit("S"), (F.col("event_id") % 4).cast("string"), F.lit("_"), F.col("event_id").cast("string")).alias("run_id"),
        F.when(F.col("event_id") % 5 == 0, "s3").otherwise("old").alias("strategy"),
        F.when(kind == 0, "team-alpha").when(kind == 1, "").alias("workspace_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.col("value"),
    )
    labelled = A.relabel(A.workspace_filter(shown, "legacy-public"), dims.strategies_dim(spark))
    gated = S.confidence_gate(labelled.withColumn("answer", F.col("value")).withColumn("confidence", F.col("value") / 10))
    return gated.orderBy(F.desc("at_us"), F.desc("run_id")).select("run_id", "strategy", "experiment", "value", "at_us", "accepted")


@query("verified_runs_semi_join", "SELECT event_id, user_id, event_type FROM events WHERE event_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def verified_runs_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    verified = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("event_id"))
    return table(spark, folder, "events").join(verified, "event_id", "left_semi").select("event_id", "user_id", "event_type")


@query("latest_matching_run", "SELECT user_id AS report, event_type AS strategy, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_matching_run(spark: SparkSession, folder: str) -> DataFrame:
    return A.latest(runs(spark, folder), ["report", "strategy"], [F.desc("ts"), F.desc("event_id")]).select("report", "strategy", "event_id", "value")


@query("resume_plan_anti", "WITH plan AS (SELECT c_custkey AS report, strategy FROM customer, (SELECT DISTINCT event_type AS strategy FROM events)) SELECT report, strategy FROM plan ANTI JOIN (SELECT user_id AS report, event_type AS strategy FROM events WHERE value > 10) done USING (report, strategy)")
def resume_plan_anti(spark: SparkSession, folder: str) -> DataFrame:
    done = runs(spark, folder)
    arms = done.select("strategy").distinct()  # a handful of registered strategies
    planned = table(spark, folder, "customer").select(F.col("c_custkey").alias("report")).crossJoin(F.broadcast(arms))
    return planned.join(done.where("value > 10"), ["report", "strategy"], "left_anti")


@query("live_comparison", f"""WITH {RUNS_SQL}, ok AS (SELECT report FROM runs GROUP BY report HAVING count(DISTINCT CASE WHEN value > 2 THEN strategy END) = (SELECT count(DISTINCT strategy) FROM runs))
SELECT strategy, count(*) AS scheduled, count(*) FILTER (value > 2) AS successful, count(*) FILTER (value <= 2) AS failed, round({mean_sql("CASE WHEN value > 2 AND report IN (SELECT report FROM ok) THEN value END")}, 6) AS matched_mean FROM runs GROUP BY strategy""")
def live_comparison(spark: SparkSession, folder: str) -> DataFrame:
    given = runs(spark, folder)
    good = A.matched_cohort(given.where("value > 2"), ["report"], "strategy", given.select("strategy"))
    means = good.groupBy("strategy").agg(F.round(A.exact_mean("value"), 6).alias("matched_mean"))
    counts = given.groupBy("strategy").agg(F.count(F.lit(1)).alias("scheduled"), F.count_if(F.col("value") > 2).alias("successful"), F.count_if(F.col("value") <= 2).alias("failed"))
    return counts.join(means, "strategy", "left")


@query("history_search", "SELECT event_id, event_type, props FROM events WHERE contains(lower(concat_ws(' ', event_id::VARCHAR, event_type, props, 'FY' || (2020 + event_id % 6))), 'fy2023') AND event_type = 'click'")
def history_search(spark: SparkSession, folder: str) -> DataFrame:
    shown = table(spark, folder, "events").withColumn("fy", F.concat(F.lit("FY"), (2020 + F.col("event_id") % 6).cast("string"))).withColumn("id", F.col("event_id").cast("string"))
    return A.search(shown, ["id", "event_type", "props", "fy"], "FY2023").where("event_type = 'click'").select("event_id", "event_type", "props")


@query("cache_usage", "WITH u AS (SELECT event_id, nullif(event_id % 50, 0) * 100 AS prompt_tokens, CASE WHEN event_id % 4 <> 0 THEN (event_id % 50) * 100 * (event_id % 11) // 10 END AS cached_tokens FROM events) SELECT event_id, prompt_tokens, cached_tokens, CASE WHEN prompt_tokens > 0 AND cached_tokens > 0 THEN round_even(cached_tokens::DOUBLE / prompt_tokens * 100, 1) END AS hit_rate FROM u")
def cache_usage(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    usage = table(spark, folder, "events").select(
        "event_id", (F.nullif(e % 50, F.lit(0)) * 100).alias("prompt_tokens"), F.when(e % 4 != 0, F.floor((e % 50) * 100 * (e % 11) / 10)).alias("cached_tokens")
    )
    both = (F.col("prompt_tokens") > 0) & (F.col("cached_tokens") > 0)
    return usage.withColumn("hit_rate", F.when(both, F.bround(F.col("cached_tokens") / F.col("prompt_tokens") * 100, 1)))
