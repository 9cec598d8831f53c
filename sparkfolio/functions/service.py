"""Request, retry, provider and display rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from . import values as V

# Truths, quota words, providers (key, base address, reasoning style) and efforts.
TRUE_WORDS = ("true", "1", "yes", "on")
QUOTA_WORDS = ("1308", "usage limit reached", "quota", "insufficient balance", "credit")
PROVIDERS = (
    ("openrouter", "https://openrouter.ai/api/v1", "reasoning"),
    ("zai", "https://api.z.ai/api/paas/v4", "thinking"),
    ("zai-coding", "https://api.z.ai/api/coding/paas/v4", "thinking"),
    ("openai", "https://api.openai.com/v1", "reasoning"),
    ("custom", "", "reasoning"),
)
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh", "max")
RETRY_HEADERS = ("retry-after", "x-ratelimit-reset-requests", "x-ratelimit-reset")
FINANCIAL_HINTS = (
    "balance sheet", "financial position", "statement of", "consolidated", "notes to", "note ", "property", "plant", "equipment", "asset", "inventor",
    "goodwill", "intangible", "receivable", "supplemental", "financial statements",
)


def parse_bool(raw: Column, default: bool) -> Column:
    return F.when(raw.isNull(), F.lit(default)).otherwise(F.lower(F.trim(raw)).isin(*TRUE_WORDS))


def parse_float(raw: Column, default: float) -> Column:
    return F.coalesce(F.when(F.trim(raw).rlike(V.NUMBER), F.replace(F.trim(raw), F.lit("_"), F.lit("")).try_cast("double")), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def backoff(kind: Column, attempt: Column) -> Column:
    """Seconds before retry ``attempt`` (from 1) without its jitter: throttled, server or crawl errors."""
    return (
        F.when(kind == "throttled", F.least(F.lit(60.0), F.lit(2.0) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(5)))))
        .when(kind == "server", F.least(F.lit(30.0), F.lit(2.0) * F.pow(F.lit(2.0), attempt - 1)))
        .when(kind == "crawl", F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt)))
    )


def quota_message(body: Column) -> Column:
    """The provider's message where a JSON error body means a spent allowance, else null."""
    read = F.try_parse_json(body)
    error = F.coalesce(F.try_variant_get(read, "$.error", "variant"), read)
    shown = F.to_json(error)
    hit = F.schema_of_variant(read).startswith("OBJECT") & F.lower(shown).rlike("|".join(QUOTA_WORDS))
    return F.when(hit, F.coalesce(F.try_variant_get(error, "$.message", "string"), F.regexp_replace(shown, '^"|"$', "")))


def retry_after(headers: Column, body: Column) -> Column:
    """Delay of the first header that reads as a duration, else of "N seconds" in the body."""
    lowered = F.transform_keys(headers, lambda k, v: F.lower(k))
    said = F.regexp_extract(body, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:seconds?|s)\b", 1)
    return F.coalesce(*[V.parse_duration(F.try_element_at(lowered, F.lit(h))) for h in RETRY_HEADERS], F.nullif(said, F.lit("")).try_cast("double"))


def providers_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PROVIDERS)], "ord int, provider string, base_url string, style string")


def match_providers(rows: DataFrame, url: str) -> DataFrame:
    """Adds ``provider`` by saved base address, or null."""
    known = providers_dim(rows.sparkSession).where("base_url <> ''").select("provider", F.col("base_url").alias("_url"))
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "/+$", ""))
    return rows.withColumn("_key", plain).join(F.broadcast(known), F.col("_key") == F.col("_url"), "left").drop("_key", "_url")


def reasoning_payload(style: Column, effort: Column) -> Column:
    """The reasoning setting as each provider expects it, as JSON; unknown efforts count as medium."""
    asked = F.lower(F.trim(F.coalesce(effort, F.lit("medium"))))
    known = F.when(asked.isin(*EFFORTS), asked).otherwise("medium")
    thinking = F.format_string('{"thinking":{"type":"%s"}}', F.when(known == "none", "disabled").otherwise("enabled"))
    return F.when(style == "thinking", thinking).otherwise(F.format_string('{"reasoning":{"effort":"%s"}}', known))


def sse(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def read_sse(chunks: DataFrame) -> DataFrame:
    """(stream, seq, event, data) from fragments (stream, seq, chunk): buffered across
    fragments, parted at blank lines; what follows the last blank line is incomplete."""
    whole = chunks.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("t"))
    frames = whole.select("stream", F.posexplode(F.split("t", "\n\n")).alias("seq", "frame"), F.size(F.split("t", "\n\n")).alias("n")).where("seq < n - 1")
    return frames.select("stream", "seq", F.regexp_extract("frame", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("frame", r"(?m)^data: (.*)$", 1).alias("data"))


def origins(raw: Column) -> Column:
    """Allowed origins of a comma list, without trailing slashes and empties."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), "/+$", "")), lambda x: x != "")


def origin_allowed(origin: Column, allowed: Column) -> Column:
    return F.array_contains(allowed, "*") | F.array_contains(allowed, F.regexp_replace(origin, "/+$", ""))


def clean(raw: Column, limit: int) -> Column:
    """White space squeezed, cut to ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")), 1, limit)


def first_hop(forwarded: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), 1))


def company_line(raw: Column) -> Column:
    """(name, url, country) of a line "name | url | country"."""
    part = lambda k: F.trim(F.coalesce(F.try_element_at(F.split(raw, r"\|"), F.lit(k)), F.lit("")))
    return F.struct(part(1).alias("name"), part(2).alias("official_url"), F.upper(F.coalesce(F.nullif(part(3), F.lit("")), F.lit("US"))).alias("country"))


def requested_years(raw: Column) -> Column:
    """Sorted distinct years 2020 to 2025 of a list of texts."""
    years = F.transform(F.filter(raw, lambda x: x.rlike("^[0-9]{1,9}$")), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(2020, 2025))))


def page_numbers(raw: Column) -> Column:
    """Sorted distinct page numbers from 1 of a list of texts; the rest is dropped."""
    numbers = F.transform(raw, lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]{1,9}$"), F.trim(x).cast("int")))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x >= 1)))


def display_name(name: Column, fiscal_year: Column) -> Column:
    """A report's shown file name; without a year its own."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    year = T.year_in(F.coalesce(F.nullif(fiscal_year, F.lit("")), T.year_in(base)))
    x = F.regexp_replace(F.regexp_replace(base, r"(?i)\.pdf$", ""), "^[0-9]{8}T[0-9]{6}Z_[0-9]{3}_", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)annual[\s_-]*report|form[\s_-]*10[\s_-]*k", "_"), "(?:19|20)[0-9]{2}", "_")
    x = F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    shown = F.concat(F.when(x == "", "Unknown_Company").otherwise(x), F.lit("_annual_report_"), year, F.lit(".pdf"))
    return F.when(year == "", F.when(base == "", "Annual report").otherwise(base)).otherwise(shown)


def format_metric(value: Column, suffix: str = "%") -> Column:
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.concat(F.format_string("%.1f", value), F.lit(suffix)))


def format_money(value: Column) -> Column:
    shown = F.regexp_replace(F.format_number(F.abs(value), 1), r"\.0$", "")
    return F.when(value.isNull(), "—").when(value < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def relevant_outline(entries: DataFrame, limit: int = 28) -> DataFrame:
    """(doc, outline): the first ``limit`` distinct entries (doc, seq, title, page) that point at financial content."""
    from pyspark.sql import Window as W

    label = F.trim(F.regexp_replace("title", r"(?U)\s+", " "))
    kept = entries.withColumn("label", label).where((F.col("label") != "") & F.lower("label").rlike("|".join(FINANCIAL_HINTS)))
    first = kept.withColumn("_rn", F.row_number().over(W.partitionBy("doc", F.lower("label")).orderBy("seq"))).where("_rn = 1")
    placed = first.withColumn("_rn", F.row_number().over(W.partitionBy("doc").orderBy("seq"))).where(F.col("_rn") <= limit)
    shown = F.substring(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": "), F.col("label")), 1, 110)
    return placed.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", shown.alias("s")))), lambda x: x["s"]).alias("outline"))
