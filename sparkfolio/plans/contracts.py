"""Queries that read, repair and validate model-written values and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..functions import values as V
from ..operators import contract as K
from .catalog import query, table
from .scores import SCHEMA_SQL, _values

NAMES_SQL = _values(dims.names()) + " AS names(folded, item)"
_FORMS = ("{}", "({})", "${}", " {} million ", "¥{}m", "n/a", "about {}", "-", "({})usd", "−{}")


def _money_text() -> str:
    forms = " ".join(f"WHEN {k} THEN " + " || x || ".join(f"'{part}'" for part in form.split("{}")) for k, form in enumerate(_FORMS))
    return f"CASE l_orderkey % {len(_FORMS)} {forms} END"


_GROUPED = "regexp_replace(format('{:,}', (l_extendedprice * 100)::BIGINT // 100), '_', ',')"
_MONEY = rf"""given AS (SELECT l_orderkey, l_linenumber, l_partkey, {_GROUPED} AS x FROM lineitem), raw AS (SELECT l_orderkey, l_linenumber, l_partkey, {_money_text()} AS raw FROM given),
bare AS (SELECT *, trim(raw) AS t, regexp_replace(regexp_replace(replace(trim(trim(raw), '()'), '−', '-'), '[$¥€£,\s]', '', 'g'), '(?i)(usd|mm|millions|million|m)$', '') AS b FROM raw),
money AS (SELECT *, lower(t) IN ({", ".join("'" + t + "'" for t in V.NULL_TOKENS)}) OR b IN ('', '-', '+') AS absent, CASE WHEN regexp_matches(b, '^[+-]?[0-9]+\.?[0-9]*$') THEN try_cast(b AS DOUBLE) * CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN -1 ELSE 1 END END AS value FROM bare)"""


def _raw_money(spark: SparkSession, folder: str) -> DataFrame:
    x = F.format_number(F.floor((F.col("l_extendedprice") * 100).cast("bigint") / 100), 0)
    forms = [F.concat(*[p for part in f.split("{}") for p in (F.lit(part), x)][:-1]) for f in _FORMS]
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*forms), (F.col("l_orderkey") % len(_FORMS) + 1).cast("int")).alias("raw"))


@query("parse_money", f"WITH {_MONEY} SELECT l_orderkey, l_linenumber, l_partkey, raw, CASE WHEN NOT absent THEN value END AS value, CASE WHEN absent THEN 'null' WHEN value IS NULL THEN 'unreadable' ELSE 'ok' END AS status FROM money")
def parse_money(spark: SparkSession, folder: str) -> DataFrame:
    return _raw_money(spark, folder).withColumn("m", V.parse_money(F.col("raw"))).select("l_orderkey", "l_linenumber", "l_partkey", "raw", "m.value", "m.status")


_SURE = "CASE event_id % 5 WHEN 0 THEN (event_id % 130) || '%' WHEN 1 THEN (event_id % 130)::VARCHAR WHEN 2 THEN '0.' || event_id % 10 WHEN 3 THEN '-' || event_id % 4 ELSE 'high' END"


@query("parse_confidence", rf"""WITH raw AS (SELECT event_id, {_SURE} AS raw FROM events), num AS (SELECT *, try_cast(regexp_replace(raw, '%+$', '') AS DOUBLE) / CASE WHEN ends_with(raw, '%') THEN 100 ELSE 1 END AS n FROM raw)
SELECT event_id, raw, CASE WHEN n IS NOT NULL THEN round(least(greatest(CASE WHEN n > 1 AND n <= 100 THEN n / 100 ELSE n END, 0), 1), 9) + 0.0::DOUBLE END AS value, CASE WHEN n IS NULL THEN 'unreadable' ELSE 'ok' END AS status FROM num""")
def parse_confidence(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    raw = (
        F.when(e % 5 == 0, F.concat(text(e % 130), F.lit("%"))).when(e % 5 == 1, text(e % 130)).when(e % 5 == 2, F.concat(F.lit("0."), text(e % 10))).when(e % 5 == 3, F.concat(F.lit("-"), text(e % 4))).otherwise("high")
    )
    told = table(spark, folder, "events").select("event_id", raw.alias("raw")).withColumn("c", V.parse_confidence(F.col("raw")))
    return told.select("event_id", "raw", F.round("c.value", 9).alias("value"), "c.status")


@query("parse_page_year", r"""WITH raw AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'p. ' || event_id % 90 WHEN 1 THEN 'page 0' WHEN 2 THEN 'none' ELSE (event_id % 70) || '-' || event_id END AS page, CASE event_id % 3 WHEN 0 THEN 'FY' || (1990 + event_id % 40) WHEN 1 THEN 'fiscal year' ELSE '18' || event_id END AS fy FROM events)
SELECT event_id, CASE WHEN try_cast(nullif(regexp_extract(page, '[0-9]+'), '') AS BIGINT) > 0 THEN try_cast(regexp_extract(page, '[0-9]+') AS BIGINT) END AS page, coalesce(nullif(regexp_extract(fy, '((?:19|20)[0-9]{2})', 1), ''), fy) AS year FROM raw""")
def parse_page_year(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    page = F.when(e % 4 == 0, F.concat(F.lit("p. "), text(e % 90))).when(e % 4 == 1, "page 0").when(e % 4 == 2, "none").otherwise(F.concat_ws("-", text(e % 70), text(e)))
    fy = F.when(e % 3 == 0, F.concat(F.lit("FY"), text(1990 + e % 40))).when(e % 3 == 1, "fiscal year").otherwise(F.concat(F.lit("18"), text(e)))
    return table(spark, folder, "events").select("event_id", V.parse_page(page).alias("page"), V.parse_year(fy).alias("year"))


_VARIANTS = [*dims.ITEMS, *(a.title() for a, _ in dims.ALIASES), "Goodwill", "Trade  Receivables!", "PLANT & MACHINERY"]
_VARIANTS_SQL = _values([*enumerate(_VARIANTS)]) + " AS variants(k, name)"


def _named(spark: SparkSession, folder: str) -> DataFrame:
    variants = spark.createDataFrame([*enumerate(_VARIANTS)], "k int, name string")
    return table(spark, folder, "part").withColumn("k", (F.col("p_partkey") % len(_VARIANTS)).cast("int")).join(F.broadcast(variants), "k")  # 48 rows


@query("canonical_item", f"""WITH given AS (SELECT p_partkey, variants.name FROM part JOIN {_VARIANTS_SQL} ON k = p_partkey % {len(_VARIANTS)})
SELECT p_partkey, name, item AS canonical FROM given LEFT JOIN {NAMES_SQL} ON folded = trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))""")
def canonical_item(spark: SparkSession, folder: str) -> DataFrame:
    return K.canonical_items(_named(spark, folder).select("p_partkey", "name"), dims.names_dim(spark), "name").select("p_partkey", "name", "canonical")


@query("schema_enrichment", f"""WITH given AS (SELECT p_partkey, variants.name FROM part JOIN {_VARIANTS_SQL} ON k = p_partkey % {len(_VARIANTS)})
SELECT classification, subclassification, s.item, count(*) AS rows FROM given JOIN {NAMES_SQL} ON folded = trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) JOIN {SCHEMA_SQL.replace("schema_dim", "s")} ON s.item = names.item GROUP BY ALL""")
def schema_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    named = K.canonical_items(_named(spark, folder), dims.names_dim(spark), "name").where("canonical IS NOT NULL")
    return named.join(F.broadcast(dims.schema_dim(spark)), F.col("canonical") == F.col("item")).groupBy("classification", "subclassification", "item").agg(F.count(F.lit(1)).alias("rows"))


def _order_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    lines = table(spark, folder, "lineitem")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1
    rows = lines.select(
        "l_orderkey",
        place.alias("ord"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("item"),
        F.when(F.col("l_partkey") % 41 == 0, "string").when(F.col("l_partkey") % 7 == 0, "null").otherwise("number").alias("answer_kind"),
        F.lit("number").alias("confidence_kind"),
        F.when(F.col("l_partkey") % 53 == 0, 1.5).otherwise(F.col("l_discount") * 10).alias("confidence_value"),
        F.when(F.col("l_partkey") % 59 == 0, "boolean").otherwise("number").alias("page_kind"),
    )
    schema = spark.createDataFrame([(k, f"line {k + 1}") for k in range(4)], "ord int, item string")
    return rows, schema


@query("contract_violations", """WITH rows_ AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS ord, 'line ' || l_linenumber AS item, CASE WHEN l_linenumber <= 4 THEN l_linenumber - 1 END AS place,
  CASE WHEN l_partkey % 41 = 0 THEN 'string' WHEN l_partkey % 7 = 0 THEN 'null' ELSE 'number' END AS ak, CASE WHEN l_partkey % 53 = 0 THEN 1.5 ELSE l_discount * 10 END AS c, CASE WHEN l_partkey % 59 = 0 THEN 'boolean' ELSE 'number' END AS pk FROM lineitem),
fields AS (SELECT l_orderkey, ord, 'unknown_item' AS code, 'unknown item ' || item AS message FROM rows_ WHERE place IS NULL UNION ALL SELECT l_orderkey, ord, 'answer_type', 'answer is ' || ak FROM rows_ WHERE ak = 'string'
  UNION ALL SELECT l_orderkey, ord, 'confidence', 'confidence is not a number from 0 to 1: number' FROM rows_ WHERE c < 0 OR c > 1 UNION ALL SELECT l_orderkey, ord, 'page_type', 'page is ' || pk FROM rows_ WHERE pk = 'boolean'),
lists AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT item) AS items, 4 - count(DISTINCT place) AS missing, list(DISTINCT item) AS have, min(CASE WHEN place <> ord THEN ord END) AS misplaced FROM rows_ WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fields) GROUP BY l_orderkey)
SELECT l_orderkey, ord, code, message FROM fields UNION ALL
SELECT l_orderkey, NULL, CASE WHEN n <> 4 THEN 'row_count' WHEN items <> n THEN 'duplicates' WHEN missing > 0 THEN 'missing' ELSE 'order' END,
  CASE WHEN n <> 4 THEN '4 rows expected, ' || n || ' found' WHEN items <> n THEN 'an item occurs more than once' WHEN missing > 0 THEN missing || ' items missing: ' || array_to_string(list_filter(['line 1', 'line 2', 'line 3', 'line 4'], lambda x: NOT list_contains(have, x)), ', ') ELSE 'row ' || misplaced || ' is out of order' END
FROM lists WHERE n <> 4 OR items <> n OR missing > 0 OR misplaced IS NOT NULL""")
def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows, schema = _order_rows(spark, folder)
    return K.violations(rows, schema, ["l_orderkey"])


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of up to four rows, wrapped in as many ways."""
    e = F.col("event_id")
    row = F.concat(F.lit('{"item": "'), F.element_at(F.array(*[F.lit(v.replace('"', "")) for v in _VARIANTS]), (e % len(_VARIANTS) + 1).cast("int")), F.lit('", "answer_m_usd": "('), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(')", "confidence": "'), (e % 101).cast("string"), F.lit('%", "source_page": "p. '), (e % 60).cast("string"), F.lit('"}'))
    said = table(spark, folder, "events").groupBy(F.floor(e / 4).alias("run_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))).getField("r"), ", ").alias("rows"))
    forms = ('{{"rows": [{}]}}', '```json\n{{"rows": [{}]}}\n```', 'Sure {{not json}}: {{"result": {{"rows": [{}]}}}} done', "[{}]", '{{"items": [{}]}}', "nothing here")
    texts = [F.concat(*[p for part in f.replace("{{", "\x01").replace("}}", "\x02").split("{}") for p in (F.lit(part.replace("\x01", "{").replace("\x02", "}")), F.col("rows"))][:-1]) for f in forms]
    return said.select("run_id", F.element_at(F.array(*texts), (F.col("run_id") % len(forms) + 1).cast("int")).alias("content"))


@query("reply_salvage_json", """WITH said AS (SELECT event_id // 4 AS run_id, count(*) AS n FROM events GROUP BY 1)
SELECT run_id, CASE WHEN run_id % 6 = 5 THEN 0 ELSE n END AS n_rows, CASE run_id % 6 WHEN 2 THEN 'result' WHEN 3 THEN 'bare rows' WHEN 4 THEN 'items' END AS unwrapped FROM said""")
def reply_salvage_json(spark: SparkSession, folder: str) -> DataFrame:
    read = K.read_replies(_replies(spark, folder))
    return read.select("run_id", F.coalesce(F.size(F.try_variant_get("rows", "$", "array<variant>")), F.lit(0)).alias("n_rows"), "unwrapped")


_REPAIRED = f"""variants AS (SELECT * FROM {_VARIANTS_SQL}), given AS (SELECT event_id // 4 AS run_id, row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) - 1 AS ord, event_id, value, name FROM events JOIN variants ON k = event_id % {len(_VARIANTS)} WHERE (event_id // 4) % 6 <> 5),
repaired AS (SELECT given.*, item IS NOT NULL AND item <> name AS renamed, coalesce(item, name) AS fixed FROM given LEFT JOIN {NAMES_SQL} ON folded = trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')))"""


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    return K.repair_rows(K.explode_rows(K.read_replies(_replies(spark, folder)), ["run_id"]), dims.names_dim(spark))


@query("repaired_rows", f"WITH {_REPAIRED} SELECT run_id, ord, fixed AS item, -(value::DECIMAL(18, 2))::DOUBLE AS value, 'number' AS answer_kind, (event_id % 101) / 100.0::DOUBLE AS sure, nullif(event_id % 60, 0) AS page_no FROM repaired")
def repaired_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _repaired(spark, folder).select("run_id", "ord", "item", "value", "answer_kind", "sure", "page_no")


@query("repair_notes", f"""WITH {_REPAIRED}, told AS (SELECT run_id, count(*) FILTER (renamed) AS n_renamed, count(*) AS n_parsed, list(fixed ORDER BY ord) FILTER (renamed) AS which FROM repaired GROUP BY run_id)
SELECT run_id, n_renamed, n_parsed, CASE WHEN n_renamed > 0 THEN 'renamed ' || n_renamed || ' item(s): ' || array_to_string(which[1:3], ', ') || CASE WHEN n_renamed > 3 THEN ' (+' || n_renamed - 3 || ' more)' ELSE '' END || '; ' ELSE '' END || 'parsed ' || n_parsed || ' value(s) sent as text' AS notes FROM told""")
def repair_notes(spark: SparkSession, folder: str) -> DataFrame:
    return K.repair_notes(_repaired(spark, folder), ["run_id"]).withColumn("notes", F.array_join("notes", "; "))


@query("canonical_order", """WITH rows_ AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_extendedprice) - 1 AS ord, CASE WHEN l_linenumber <= 4 THEN l_linenumber - 1 END AS place FROM lineitem),
whole AS (SELECT l_orderkey, count(*) = 4 AND count(DISTINCT place) = 4 AS complete FROM rows_ GROUP BY l_orderkey) SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN complete THEN place ELSE ord END AS ord FROM rows_ JOIN whole USING (l_orderkey)""")
def canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, folder, "lineitem").withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_extendedprice")) - 1).withColumn("item", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    _, schema = _order_rows(spark, folder)
    return K.reordered(rows, schema, ["l_orderkey"]).select("l_orderkey", "l_partkey", "l_linenumber", "ord")


@query("gold_materialize_overrides", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE quality END AS answer, CASE WHEN doc_id % 10 = 0 THEN 'override' ELSE 'labels' END AS origin FROM labels WHERE doc_id % 15 <> 5")
def gold_materialize_overrides(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    overrides = labels.where("doc_id % 10 = 0").select("doc_id", F.lit(2).alias("fixed"))
    omitted = labels.where("doc_id % 15 = 5").select("doc_id")
    joined = labels.join(omitted, "doc_id", "left_anti").join(overrides, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("fixed", "quality").alias("answer"), F.when(F.col("fixed").isNotNull(), "override").otherwise("labels").alias("origin"))


_SETS = f"""schema_rows AS (SELECT * FROM {SCHEMA_SQL}), rows_ AS (SELECT source AS doc, doc_id AS o, (doc_id // 20) % 27 AS ord, n_chars::DOUBLE AS answer, doc_id FROM documents), tagged AS (SELECT 0 AS k, 'audited' AS src, * FROM rows_ WHERE doc IN ('src1', 'src2') AND doc_id % 3 = 0
  UNION ALL SELECT 1, 'approved', * FROM rows_ WHERE doc IN ('src2', 'src3') UNION ALL SELECT 2, 'candidate', * FROM rows_ WHERE doc IN ('src3', 'src4', 'src5'))"""


@query("verification_resolution", f"""WITH {_SETS}, best AS (SELECT doc, min(k) AS k, arg_min(src, k) AS source FROM tagged GROUP BY doc), last AS (SELECT t.doc, s.item, arg_max(answer, o) AS answer FROM tagged t JOIN best USING (doc, k) JOIN schema_rows s USING (ord) GROUP BY t.doc, s.item)
SELECT d.doc, s.ord, s.item, coalesce(source, 'empty') AS source, answer FROM (SELECT DISTINCT source AS doc FROM documents) d CROSS JOIN schema_rows s LEFT JOIN best USING (doc) LEFT JOIN last ON last.doc = d.doc AND last.item = s.item""")
def verification_resolution(spark: SparkSession, folder: str) -> DataFrame:
    docs, schema = table(spark, folder, "documents"), dims.schema_dim(spark)
    rows = docs.withColumn("place", F.floor(F.col("doc_id") / 20) % 27).join(F.broadcast(schema.select(F.col("ord").alias("place"), "item")), "place")
    rows = rows.select(F.col("source").alias("doc"), "item", F.col("doc_id").alias("ord"), F.col("n_chars").cast("double").alias("answer"))
    sets = [("audited", rows.where("doc IN ('src1', 'src2') AND ord % 3 = 0")), ("approved", rows.where("doc IN ('src2', 'src3')")), ("candidate", rows.where("doc IN ('src3', 'src4', 'src5')"))]
    return K.verification_rows(docs.select(F.col("source").alias("doc")).distinct(), schema, sets, ["doc"])


@query("partition_check", """WITH a AS (SELECT DISTINCT o_custkey % 50 AS key, o_orderkey % 30 AS k FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT DISTINCT o_custkey % 50 AS key, o_orderkey % 30 AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0),
per AS (SELECT key, k, max(x) AS a, max(y) AS u FROM (SELECT key, k, 1 AS x, 0 AS y FROM a UNION ALL SELECT key, k, 0, 1 FROM u) GROUP BY key, k),
told AS (SELECT key, count(*) FILTER (a = 1 AND u = 1) AS overlap, count(*) FILTER (k < 27) AS covered, count(*) FILTER (k >= 27) AS "foreign" FROM per GROUP BY key)
SELECT key, overlap, covered, "foreign", overlap = 0 AND covered = 27 AND "foreign" = 0 AS valid FROM told""")
def partition_check(spark: SparkSession, folder: str) -> DataFrame:
    schema = dims.schema_dim(spark)
    places = F.concat_ws(" ", F.lit("extra"), (F.col("o_orderkey") % 30).cast("string"))
    orders = table(spark, folder, "orders").withColumn("key", F.col("o_custkey") % 50).withColumn("place", (F.col("o_orderkey") % 30).cast("int"))
    named = orders.join(F.broadcast(schema.select(F.col("ord").alias("place"), "item")), "place", "left").withColumn("item", F.coalesce("item", places))
    answers, unscorable = named.where("o_orderstatus = 'F'"), named.where("o_orderstatus = 'P' AND o_orderkey % 7 = 0")
    keys = answers.select("key").unionByName(unscorable.select("key")).distinct()
    return K.partition_check(keys, answers, unscorable, schema, ["key"])


@query("duration_parse_format", """WITH given AS (SELECT event_id, event_id % 4 AS f, event_id % 100 AS n FROM events), s AS (SELECT event_id, CASE f WHEN 0 THEN n::DOUBLE WHEN 1 THEN n + 1 * 60.0::DOUBLE WHEN 2 THEN (n * 10) * 0.001::DOUBLE END AS seconds FROM given)
SELECT event_id, round(seconds, 6) AS seconds, CASE WHEN seconds IS NULL THEN '—' WHEN seconds < 1 THEN '<1 s' WHEN seconds < 10 THEN printf('%.1f s', seconds) WHEN seconds < 60 THEN printf('%.0f s', seconds)
  WHEN round(seconds % 60) = 60 THEN (floor(seconds / 60) + 1)::BIGINT || ' min' ELSE floor(seconds / 60)::BIGINT || ' min ' || round(seconds % 60)::BIGINT || ' s' END AS shown FROM s""")
def duration_parse_format(spark: SparkSession, folder: str) -> DataFrame:
    n, f = (F.col("event_id") % 100).cast("string"), F.col("event_id") % 4
    raw = F.when(f == 0, n).when(f == 1, F.concat(F.lit("1m"), n, F.lit("s"))).when(f == 2, F.concat(((F.col("event_id") % 100) * 10).cast("string"), F.lit("ms"))).otherwise("soon")
    told = table(spark, folder, "events").select("event_id", V.parse_duration(raw).alias("seconds"))
    return told.select("event_id", F.round("seconds", 6).alias("seconds"), V.format_duration(F.col("seconds")).alias("shown"))


@query("scalar_guards", """SELECT event_id, CASE WHEN length(k) <= 8 THEN '••••••••' ELSE k[1:4] || '…' || right(k, 4) END AS masked, CASE WHEN regexp_full_match(w, '[A-Za-z0-9_-]{8,64}') THEN w ELSE 'legacy-public' END AS workspace, regexp_full_match(lower(j), '[0-9a-f]+') AS job_ok
FROM (SELECT event_id, repeat('k', 5 + event_id % 7) || event_id AS k, event_type || event_id AS w, CASE WHEN event_id % 2 = 0 THEN md5(event_type) ELSE '../' || event_id END AS j FROM events)""")
def scalar_guards(spark: SparkSession, folder: str) -> DataFrame:
    e, text = F.col("event_id"), F.col("event_id").cast("string")
    key = F.concat(F.expr("repeat('k', cast(5 + event_id % 7 as int))"), text)
    given = table(spark, folder, "events").select("event_id", key.alias("k"), F.concat("event_type", text).alias("w"), F.when(e % 2 == 0, F.md5(F.col("event_type").cast("binary"))).otherwise(F.concat(F.lit("../"), text)).alias("j"))
    workspace = F.when(F.col("w").rlike("^[A-Za-z0-9_-]{8,64}$"), F.col("w")).otherwise("legacy-public")
    return given.select("event_id", T.mask_secret(F.col("k")).alias("masked"), workspace.alias("workspace"), F.lower("j").rlike("^[0-9a-f]+$").alias("job_ok"))
