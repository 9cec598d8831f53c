"""Queries of request, retry, provider and display rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import service as X
from .catalog import query, table


def _text(c):
    return c.cast("string")


@query("bool_float_defaults", """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN true ELSE event_id % 6 IN (0, 2, 4) END AS flag, CASE event_id % 4 WHEN 0 THEN event_id + 0.5::DOUBLE WHEN 1 THEN -1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 1000.0::DOUBLE END AS number,
least(greatest(event_id / 1000.0::DOUBLE, 0.0), 1.0) AS temperature FROM events""")
def bool_float_defaults(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, (" True", "off", "1", "no", "YES "))), (F.least(e % 6, F.lit(4)) + 1).cast("int"))
    number = F.when(e % 4 == 0, F.concat(_text(e), F.lit(".5"))).when(e % 4 == 1, "x").when(e % 4 == 3, "1_000")
    return table(spark, folder, "events").select(
        "event_id", X.parse_bool(F.when(e % 6 != 5, word), True).alias("flag"), X.parse_float(number, -1.0).alias("number"), X.clamp(e / 1000.0, 0.0, 1.0).alias("temperature")
    )


@query("backoff_delays", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(60.0::DOUBLE, 2.0::DOUBLE * pow(2, least(event_id % 9, 5))) WHEN 1 THEN least(30.0::DOUBLE, 2.0::DOUBLE * pow(2, event_id % 9)) ELSE least(30.0::DOUBLE, pow(2, event_id % 9 + 1)) END AS seconds FROM events""")
def backoff_delays(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "throttled").when(e % 3 == 1, "server").otherwise("crawl")
    return table(spark, folder, "events").select("event_id", X.backoff(kind, e % 9 + 1).alias("seconds"))


@query("quota_classifier", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Usage limit reached for ' || event_type WHEN 2 THEN 'out of credit' END AS message FROM events""")
def quota_classifier(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    body = (
        F.when(e % 4 == 0, F.concat(F.lit('{"error": {"code": 1308, "message": "Usage limit reached for '), F.col("event_type"), F.lit('"}}')))
        .when(e % 4 == 1, '{"error": {"message": "slow down"}}')
        .when(e % 4 == 2, '{"error": "out of credit"}')
        .otherwise("quota but no json")
    )
    return table(spark, folder, "events").select("event_id", X.quota_message(body).alias("message"))


@query("retry_delays", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90)::DOUBLE WHEN 1 THEN 60.0::DOUBLE + event_id % 60 WHEN 2 THEN (event_id % 30) + 0.5::DOUBLE END AS seconds FROM events""")
def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    none = F.create_map(F.lit("X-Other"), F.lit("1"))
    headers = F.when(e % 4 == 0, F.create_map(F.lit("Retry-After"), _text(e % 90))).when(e % 4 == 1, F.create_map(F.lit("X-RateLimit-Reset"), F.concat(F.lit("1m"), _text(e % 60), F.lit("s")))).otherwise(none)
    body = F.when(e % 4 == 2, F.concat(F.lit("try again in "), _text(e % 30), F.lit(".5 seconds"))).otherwise("later")
    return table(spark, folder, "events").select("event_id", X.retry_after(headers, body).alias("seconds"))


@query("provider_payloads", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'openrouter' WHEN 1 THEN 'zai' WHEN 2 THEN 'openai' END AS provider,
CASE WHEN event_id % 4 = 1 THEN '{"thinking":{"type":"' || CASE WHEN event_id % 3 = 0 THEN 'disabled' ELSE 'enabled' END || '"}}' ELSE '{"reasoning":{"effort":"' || CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'high' ELSE 'medium' END || '"}}' END AS payload FROM events""")
def provider_payloads(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    url = F.when(e % 4 == 0, "https://OpenRouter.ai/api/v1/").when(e % 4 == 1, "https://api.z.ai/api/paas/v4").when(e % 4 == 2, "https://api.openai.com/v1//").otherwise("https://x.example")
    named = X.match_providers(table(spark, folder, "events").select("event_id", url.alias("url")), "url")
    effort = F.when(F.col("event_id") % 3 == 0, " None").when(F.col("event_id") % 3 == 1, "high").otherwise("extreme")
    style = F.when(F.col("provider") == "zai", "thinking").otherwise("reasoning")
    return named.select("event_id", "provider", X.reasoning_payload(style, effort).alias("payload"))


@query("sse_round_trip", "SELECT user_id AS stream, event_type AS event, props AS data, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def sse_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), X.sse(F.col("event_type"), F.col("props")).alias("frame"))
    # fragments cut inside a frame
    chunks = frames.select("stream", F.col("seq"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.substring("frame", 1, 9).alias("chunk")), F.struct(F.lit(1).alias("k"), F.expr("substring(frame, 10)").alias("chunk")))).alias("c"))
    return X.read_sse(chunks.select("stream", (F.col("seq") * 2 + F.col("c.k")).alias("seq"), "c.chunk"))


@query("request_guards", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN true ELSE page_id % 3 = 1 AND page_id % 2 = 0 END AS allowed, '10.0.0.' || page_id AS client, substring(trim(regexp_replace(url, '\\s+', ' ', 'g')), 1, 40) AS path FROM pages""")
def request_guards(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id")
    origin = F.when(p % 2 == 0, "https://a.example/").otherwise("https://b.example")
    allowed = X.origins(F.when(p % 3 == 0, "https://z.example, *").when(p % 3 == 1, " https://a.example/ ,").otherwise(""))
    return table(spark, folder, "pages").select(
        "page_id", X.origin_allowed(origin, allowed).alias("allowed"), X.first_hop(F.concat(F.lit(" 10.0.0."), _text(p), F.lit(" , 10.1.1.1"))).alias("client"), X.clean(F.concat(F.lit("  "), F.col("url"), F.lit("\t \n")), 40).alias("path")
    )


@query("company_lines", """SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'https://n' || n_nationkey || '.example' ELSE '' END AS official_url, CASE WHEN n_nationkey % 3 = 0 THEN 'JP' ELSE 'US' END AS country,
CASE n_nationkey % 3 WHEN 0 THEN '2020,2025' WHEN 1 THEN '2021' ELSE '' END AS years, CASE WHEN n_nationkey % 2 = 0 THEN '2,3' ELSE '1,7' END AS pages FROM nation""")
def company_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    line = F.concat(F.lit(" "), F.col("n_name"), F.when(n % 2 == 0, F.concat(F.lit(" | https://n"), _text(n), F.lit(".example"))).otherwise(" | "), F.when(n % 3 == 0, " | jp").otherwise(""))
    years = F.when(n % 3 == 0, F.array(*map(F.lit, ("2025", "2020", "2019", "2025", "x")))).when(n % 3 == 1, F.array(F.lit("2021"), F.lit("2026"))).otherwise(F.array(F.lit("")))
    numbers = F.when(n % 2 == 0, F.array(*map(F.lit, ("3", "2", "0", "-4", "x", "3")))).otherwise(F.array(F.lit(" 7"), F.lit("+1"), F.lit("1.5")))
    parsed = table(spark, folder, "nation").select("n_nationkey", X.company_line(line).alias("c"), X.requested_years(years).alias("y"), X.page_numbers(numbers).alias("p"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return parsed.select("n_nationkey", "c.name", "c.official_url", "c.country", join("y").alias("years"), join("p").alias("pages"))


@query("display_formats", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN '—' ELSE printf('%.1f', l_quantity) || '%' END AS metric,
CASE WHEN l_partkey % 2 = 0 THEN '(' || format('{:,}', (l_quantity * 1000)::BIGINT) || ')' ELSE format('{:,}', (l_quantity * 1000)::BIGINT) END AS money FROM lineitem""")
def display_formats(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("l_quantity") * 1000 * F.when(F.col("l_partkey") % 2 == 0, -1.0).otherwise(1.0)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.format_metric(F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))).alias("metric"), X.format_money(value).alias("money")
    )


@query("display_names", r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') || '_annual_report_2024.pdf' END AS shown FROM part""")
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    # the first year in a name is its stamp's, where it has one
    p = F.col("p_partkey")
    name = F.when(p % 4 == 3, F.concat(F.lit("up/"), F.col("p_name"))).otherwise(F.concat(F.lit(r"C:\in\20240102T030405Z_001_"), F.col("p_name"), F.lit(" Annual-Report "), _text(2018 + p % 7), F.lit(".PDF")))
    return table(spark, folder, "part").select("p_partkey", X.display_name(name, F.lit("")).alias("shown"))


@query("relevant_outline", """WITH entries AS (SELECT user_id AS doc, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Notes to ' || event_type WHEN 1 THEN 'Weather' ELSE 'Total ASSETS ' || event_id % 20 END AS label, event_id % 90 AS page FROM events),
first AS (SELECT * FROM entries WHERE label <> 'Weather' QUALIFY row_number() OVER (PARTITION BY doc, lower(label) ORDER BY seq) = 1), placed AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY doc ORDER BY seq) <= 5)
SELECT doc, string_agg('p' || page || ': ' || label, '; ' ORDER BY seq) AS outline FROM placed GROUP BY doc""")
def relevant_outline(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    title = F.when(e % 3 == 0, F.concat(F.lit(" Notes  to "), F.col("event_type"))).when(e % 3 == 1, "Weather").otherwise(F.concat(F.lit("Total ASSETS\t"), _text(e % 20)))
    entries = table(spark, folder, "events").select(F.col("user_id").alias("doc"), e.alias("seq"), title.alias("title"), (e % 90).alias("page"))
    return X.relevant_outline(entries, 5).select("doc", F.array_join("outline", "; ").alias("outline"))


@query("label_dictionary", "SELECT event_type, CASE event_type WHEN 'view' THEN '閲覧' WHEN 'click' THEN 'クリック' ELSE event_type END AS label, count(*) AS events FROM events GROUP BY event_type")
def label_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.createDataFrame([("view", "閲覧"), ("click", "クリック")], "event_type string, ja string")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).join(F.broadcast(labels), "event_type", "left").select("event_type", F.coalesce("ja", "event_type").alias("label"), "events")
