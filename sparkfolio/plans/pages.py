"""Queries over ``documents`` as pages: a hundred pages of a source are a document, doc_id is the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import documents as D
from ..operators import ranking as R
from .catalog import query, table


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(document().alias("doc"), F.col("doc_id").alias("page"), "text")


def document() -> Column:
    """The report that a page stands in: documents come from 20 sources in turn."""
    return F.concat_ws("/", "source", F.floor(F.col("doc_id") / 2000).cast("string"))


DOC = "source || '/' || doc_id // 2000"


def _scored(spark: SparkSession, folder: str, layout: DataFrame | None = None) -> DataFrame:
    vocabulary = table(spark, folder, "benchmark").select(F.explode(R.tokens_of(F.col("text"))).alias("term")).distinct()
    vocabulary = vocabulary.union(R.accounting_vocabulary(spark)).distinct()
    return R.score_pages(pages(spark, folder), vocabulary, layout)


def _any(column: str, patterns) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN 1 ELSE 0 END" for p in patterns)


_SCORES = rf"""
vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{R.TOKEN}')) AS term FROM (SELECT text FROM benchmark UNION ALL SELECT unnest({[*R.ACCOUNTING, *(x for row in dims.SCHEMA for x in row), *dims.DESCRIPTIONS]}))),
usable AS (SELECT {DOC} AS doc, doc_id AS page, text, regexp_extract_all(lower(text), '{R.TOKEN}') AS tokens FROM documents WHERE regexp_matches(text, '\S')),
facts AS (
  SELECT doc, page, len(tokens) AS n_tokens, len(list_filter(tokens, lambda t: regexp_matches(t, '\p{{Nd}}'))) AS n_numeric, length(text) AS characters,
    {_any("text", R.HEADINGS)} AS heading_hits, {_any("text", R.REJECTS)} AS reject_hits, regexp_matches(text, '{R.TABLE_ROW}') AS table_signal,
    {_any("text", [p for _, p in R.CRITICAL])} AS critical_hits, {" + ".join(f"CASE WHEN contains(text, '{t}') THEN 1 ELSE 0 END" for t in R.JAPANESE_TERMS)} AS japanese_hits,
    contains(text, '連結貸借対照表') AS consolidated, contains(text, '貸借対照表') AS statement
  FROM usable
),
docs AS (SELECT doc, count(*) AS n_pages, CASE WHEN sum(n_tokens) > 0 THEN sum(n_tokens)::DOUBLE / count(*) ELSE 1.0 END AS average, bool_or(consolidated) AS has_consolidated FROM facts GROUP BY doc),
counts AS (SELECT doc, page, term, count(*) AS tf FROM (SELECT doc, page, unnest(tokens) AS term FROM usable) JOIN vocabulary USING (term) GROUP BY ALL),
spread AS (SELECT *, count(*) OVER (PARTITION BY doc, term) AS df FROM counts),
bm25 AS (
  SELECT doc, page, count(*) AS n_terms, sum(CAST(
    ln(1 + (n_pages - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(n_tokens, 1) / average)))
    AS DECIMAL(38, 12)))::DOUBLE AS bm25
  FROM spread JOIN docs USING (doc) JOIN facts USING (doc, page) GROUP BY doc, page
),
scored AS (
  SELECT doc, page, characters, heading_hits, reject_hits, table_signal, coalesce(n_terms, 0) AS schema_term_hits, round_even(coalesce(bm25, 0), 4) AS bm25,
    round_even(n_numeric::DOUBLE / greatest(n_tokens, 1), 4) AS numeric_density,
    round_even(coalesce(bm25, 0) + least(10.0::DOUBLE, coalesce(n_terms, 0) * 0.28::DOUBLE) + heading_hits * 4.0::DOUBLE + CASE WHEN table_signal THEN 4.0::DOUBLE ELSE 0 END
      + least(2.0::DOUBLE, n_numeric::DOUBLE / greatest(n_tokens, 1) * 8.0::DOUBLE) + least(16.0::DOUBLE, critical_hits * 16.0::DOUBLE) + least(18.0::DOUBLE, japanese_hits * 0.9::DOUBLE)
      - reject_hits * CASE WHEN heading_hits > 0 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END - CASE WHEN has_consolidated AND statement AND NOT consolidated THEN 12.0::DOUBLE ELSE 0 END, 4) AS score
  FROM facts JOIN docs USING (doc) LEFT JOIN bm25 USING (doc, page)
)"""

_SELECTED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS rank, count(*) OVER (PARTITION BY doc) AS n FROM scored),
barred AS (SELECT *, greatest(1.0::DOUBLE, max(CASE WHEN rank = least(3, n) THEN score END) OVER (PARTITION BY doc)) * 0.45::DOUBLE AS bar FROM ranked),
chosen AS (SELECT *, bool_and(rank <= least(3, n) OR (rank <= 5 AND score >= bar)) OVER (PARTITION BY doc ORDER BY rank) AS selected FROM barred)"""


@query("page_score_bm25", f"WITH {_SCORES} SELECT doc, page, score, bm25, schema_term_hits, heading_hits, reject_hits, table_signal, numeric_density, characters FROM scored")
def page_score_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc", "page", "score", "bm25", "schema_term_hits", "heading_hits", "reject_hits", "table_signal", "numeric_density", "characters")


# A parser's layout: of two pages in three, every fourth has a table and every fifth has columns.
_LAYOUT = _SCORES.replace("CASE WHEN table_signal THEN 4.0::DOUBLE ELSE 0 END", "CASE WHEN table_signal OR (page % 3 > 0 AND page % 4 = 0) THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN page % 3 > 0 AND page % 5 = 0 THEN 0.75::DOUBLE ELSE 0 END").replace(
    "reject_hits, table_signal, coalesce(n_terms", "reject_hits, table_signal OR (page % 3 > 0 AND page % 4 = 0) AS table_signal, page % 3 > 0 AND page % 5 = 0 AS column_signal, coalesce(n_terms"
)


@query("page_score_layout", f"WITH {_LAYOUT} SELECT doc, page, score, table_signal, column_signal FROM scored")
def page_score_layout(spark: SparkSession, folder: str) -> DataFrame:
    all_pages = pages(spark, folder).where(F.col("page") % 3 > 0)
    layout = all_pages.select("doc", "page", (F.col("page") % 4 == 0).alias("has_table"), (F.col("page") % 5 == 0).alias("has_column"))
    return _scored(spark, folder, layout).select("doc", "page", "score", "table_signal", "column_signal")


@query("page_rank", f"WITH {_SCORES}, {_SELECTED} SELECT doc, page, rank, score, selected FROM chosen")
def page_rank(spark: SparkSession, folder: str) -> DataFrame:
    return R.select_pages(_scored(spark, folder)).select("doc", "page", "rank", "score", "selected")


@query(
    "evidence_pages_adaptive_topk",
    f"""WITH {_SCORES}, {_SELECTED},
told AS (SELECT doc, string_agg(page::VARCHAR, ', ' ORDER BY page) FILTER (selected) AS selected_pages, count(*) FILTER (selected) AS selected_count,
  count(*) AS candidate_count, sum(CASE WHEN selected THEN characters ELSE 0 END) AS selected_characters FROM chosen GROUP BY doc),
size AS (SELECT {DOC} AS doc, sum(length(text)) AS full_characters FROM documents GROUP BY 1)
SELECT doc, selected_pages, selected_count, candidate_count, selected_characters, full_characters,
  CASE WHEN full_characters > 0 THEN round_even((1 - selected_characters::DOUBLE / full_characters) * 100, 2) ELSE 0.0 END AS reduction_percent
FROM told JOIN size USING (doc)""",
)
def evidence_pages_adaptive_topk(spark: SparkSession, folder: str) -> DataFrame:
    told = R.evidence_summary(pages(spark, folder), R.select_pages(_scored(spark, folder)))
    return told.withColumn("selected_pages", F.array_join("selected_pages", ", "))


_GARBLE = r"CASE WHEN length({0}) > 0 THEN (length({0}) - length(regexp_replace({0}, '[\x00-\x08\x0b-\x1f\x7f-\x9f\p{{Co}}\x{{FFFD}}]', '', 'g')))::DOUBLE / length({0}) ELSE 0.0::DOUBLE END"
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace({0}, '<br\s*/?>', ' ', 'g'), '[\s|*#`_~\[\]()]+'), lambda t: length(t) >= 3)"
_MIXED = r"CASE WHEN len(toks) >= 25 THEN len(list_filter(toks, lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\p{Nd}')))::DOUBLE / len(toks) ELSE 0.0::DOUBLE END"


@query(
    "text_health",
    f"""WITH cut AS (SELECT doc_id, text, {_TOKENS.format("text")} AS toks FROM documents),
health AS (SELECT doc_id, {_GARBLE.format("text")} AS garble_ratio, {_MIXED} AS mixed_ratio FROM cut)
SELECT doc_id, round(garble_ratio, 6) AS garble_ratio, round(mixed_ratio, 6) AS mixed_ratio, garble_ratio >= 0.15 OR mixed_ratio >= 0.15 AS unreadable FROM health""",
)
def text_health(spark: SparkSession, folder: str) -> DataFrame:
    told = D.text_health(table(spark, folder, "documents").select("doc_id", "text"))
    return told.select("doc_id", F.round("garble_ratio", 6).alias("garble_ratio"), F.round("mixed_ratio", 6).alias("mixed_ratio"), "unreadable")


_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(translate({0}, chr(160) || chr(8199) || chr(8239) || chr(8201) || chr(8722) || chr(8211) || chr(8212) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173),
    '    ---' || chr(39) || chr(39) || '""'), chr(64257), 'fi'), chr(64258), 'fl'),
  '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n\z', ''), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"""


@query(
    "document_assembly",
    f"""WITH plain AS (SELECT {DOC} AS doc, doc_id AS page, {_NORMAL.format("text")} AS text FROM documents),
cut AS (SELECT *, {_TOKENS.format("text")} AS toks FROM plain),
health AS (SELECT *, ({_GARBLE.format("text")}) >= 0.15 OR ({_MIXED}) >= 0.15 AS bad, NOT regexp_matches(text, '\\S') AS blank FROM cut),
told AS (SELECT doc, count(*) AS page_count, count(*) FILTER (bad) AS garbled, count(*) FILTER (blank AND NOT bad) AS empty_pages, count(*) FILTER (NOT bad AND NOT blank) AS readable_pages,
  coalesce(string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) FILTER (NOT bad AND NOT blank), '') AS text FROM health GROUP BY doc)
SELECT doc, page_count, garbled, empty_pages, readable_pages, length(text) AS char_count, greatest(1, length(text) // 4) AS approx_tokens, md5(text) AS text_md5 FROM told""",
)
def document_assembly(spark: SparkSession, folder: str) -> DataFrame:
    told = D.assemble(pages(spark, folder))
    return told.select(
        "doc", "page_count", F.size("garbled_pages").alias("garbled"), "empty_pages", "readable_pages", "char_count", "approx_tokens", F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


@query(
    "page_ranges_compressed",
    """WITH island AS (SELECT source, lang, page, page - row_number() OVER (PARTITION BY source, lang ORDER BY page) AS island FROM (SELECT DISTINCT source, lang, doc_id // 20 AS page FROM documents)),
runs AS (SELECT source, lang, min(page) AS a, max(page) AS b FROM island GROUP BY source, lang, island)
SELECT source, lang, string_agg(CASE WHEN b > a THEN a || '-' || b ELSE a::VARCHAR END, ', ' ORDER BY a) AS pages, count(*) AS n_runs FROM runs GROUP BY source, lang""",
)
def page_ranges_compressed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "lang", F.floor(F.col("doc_id") / 20).alias("page"))
    return D.page_ranges(docs, ["source", "lang"])


_LOAD = f"""placed AS (SELECT {DOC} AS doc, {_NORMAL.format("text")} AS text, row_number() OVER (PARTITION BY {DOC} ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY {DOC}) AS n FROM documents),
taken AS (SELECT *, k % greatest(1, n // 12) = 0 AND k // greatest(1, n // 12) < 12 AS taken FROM placed),
sampled AS (SELECT doc, any_value(n) AS pages, count(*) FILTER (taken) AS sampled_pages, sum(length(text)) FILTER (taken) AS chars FROM taken GROUP BY doc),
loads AS (SELECT doc, pages, sampled_pages, floor(chars::DOUBLE / sampled_pages * pages)::BIGINT + pages * 20 AS approx_characters FROM sampled)"""


@query("strided_load_estimate", f"WITH {_LOAD} SELECT *, greatest(1, approx_characters // 4) AS approx_tokens FROM loads")
def strided_load_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return D.estimate_load(pages(spark, folder))


@query(
    "batch_plan",
    f"""WITH {_LOAD}, files AS (SELECT *, greatest(1, approx_characters // 4) AS t FROM loads),
told AS (SELECT count(*) AS file_count, sum(pages) AS total_pages, sum(t) AS total_approx_tokens FROM files),
wide AS (SELECT *, greatest(1, least(6, file_count, CASE WHEN total_approx_tokens::DOUBLE / file_count >= 180000 THEN 2 WHEN total_approx_tokens::DOUBLE / file_count >= 120000 THEN 3
  WHEN total_approx_tokens::DOUBLE / file_count >= 80000 THEN 4 ELSE 6 END)) AS recommended_concurrency FROM told)
SELECT *, ceil(file_count::DOUBLE / recommended_concurrency)::BIGINT AS waves FROM wide""",
)
def batch_plan(spark: SparkSession, folder: str) -> DataFrame:
    return D.batch_plan(D.estimate_load(pages(spark, folder)), 6)


_GENERIC = ("(?i)tion", "(?i)que", "(?i)ung", "(?i)ado", "(?i)the")
_HEADING = r"(?i)\b(?:the|de|der|la)\b"


@query(
    "screen_verdict",
    rf"""WITH judged AS (SELECT {DOC} AS doc, doc_id AS page, text, {_any("text", _GENERIC)} AS terms FROM documents),
scored AS (SELECT *, CASE WHEN regexp_matches(text, '{_HEADING}') AND terms >= 3 THEN terms + {" + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {s}::DOUBLE ELSE 0 END" for s, p in R.SIGNALS)}
  + least(3.0::DOUBLE, len(regexp_extract_all(text, '{R.NUMERIC_LINE}')) / 8.0::DOUBLE) END AS score FROM judged),
best AS (SELECT doc, count(*) FILTER (trim(text) <> '') AS readable_pages, arg_max(text, (score, -page)) FILTER (score IS NOT NULL) AS statement,
  arg_max(page, (score, -page)) FILTER (score IS NOT NULL) AS balance_sheet_page, max(score) AS balance_sheet_score,
  bool_or({" OR ".join(f"list_contains(regexp_extract_all(text, '{p}', 1), '2004')" for p in R.YEARS)}) AS mentioned FROM scored GROUP BY doc),
years AS (SELECT *, list_max(list_transform(list_filter(regexp_extract_all(coalesce(statement, ''), '[0-9]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]{{2}}$')), lambda x: x::INTEGER)) AS reporting_year FROM best),
told AS (SELECT *, CASE WHEN reporting_year IS NOT NULL THEN reporting_year = 2004 ELSE mentioned END AS year_confirmed FROM years)
SELECT doc, 2004 AS year, CASE WHEN readable_pages = 0 THEN 'unreadable' WHEN NOT year_confirmed OR balance_sheet_page IS NULL THEN 'review' ELSE 'ok' END AS verdict,
  concat_ws('; ', CASE WHEN NOT year_confirmed THEN 'year not confirmed' END, CASE WHEN readable_pages = 0 THEN 'no readable text' END, CASE WHEN balance_sheet_page IS NULL THEN 'no balance sheet' END) AS reasons,
  balance_sheet_page, round(balance_sheet_score, 6) AS balance_sheet_score, reporting_year,
  CASE WHEN regexp_matches(coalesce(statement, ''), '{R.JPY}') THEN 'JPY' WHEN regexp_matches(coalesce(statement, ''), '{R.USD}') THEN 'USD' ELSE 'unknown' END AS currency, year_confirmed, readable_pages
FROM told""",
)
def screen_verdict(spark: SparkSession, folder: str) -> DataFrame:
    given = pages(spark, folder)
    told = R.screen_documents(given, given.select("doc").distinct().withColumn("year", F.lit(2004)), balance_sheet=_HEADING, groups=_GENERIC)
    return told.withColumn("reasons", F.array_join("reasons", "; ")).withColumn("balance_sheet_score", F.round("balance_sheet_score", 6))


@query(
    "prompt_assembly",
    """SELECT conv_id, 'Follow the schema.' || chr(10) || chr(10) || string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '[' || role || ']' || chr(10) || text) AS prompt, count(*) AS n_parts
FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
)
def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role <> 'system'")
    parts = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.col("role").alias("label"), F.col("text").alias("body"))
    return D.assemble_prompts(parts, "Follow the schema.\n\n").withColumnRenamed("doc", "conv_id")


@query(
    "repair_messages",
    """WITH base AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS ask, arg_max(text, (turn, text)) AS reply FROM conversations WHERE role <> 'system' GROUP BY conv_id),
parts AS (SELECT conv_id, unnest([{'seq': 1, 'role': 'system', 'content': 'Follow the schema.'}, {'seq': 2, 'role': 'user', 'content': ask}, {'seq': 3, 'role': 'assistant', 'content': reply},
  {'seq': 4, 'role': 'user', 'content': 'Correct the reply: return all rows once, in order.'}]) AS m FROM base)
SELECT conv_id, m.seq AS seq, m.role AS role, m.content AS content FROM parts""",
)
def repair_messages(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role <> 'system'")
    base = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("ask"), F.max_by("text", F.struct("turn", "text")).alias("reply"))
    message = lambda k, role, body: F.struct(F.lit(k).alias("seq"), F.lit(role).alias("role"), body.alias("content"))
    four = F.array(
        message(1, "system", F.lit("Follow the schema.")),
        message(2, "user", F.col("ask")),
        message(3, "assistant", F.col("reply")),
        message(4, "user", F.lit("Correct the reply: return all rows once, in order.")),
    )
    return base.select("conv_id", F.inline(four))


@query(
    "render_diagnostics",
    """SELECT source AS doc, 'Documents: ' || count(*) || chr(10) || 'Languages: ' || count(DISTINCT lang) || CASE WHEN max(n_chars) > 10000 THEN chr(10) || 'Longest: ' || max(n_chars) ELSE '' END AS text
FROM documents GROUP BY source""",
)
def render_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    told = table(spark, folder, "documents").groupBy(F.col("source").alias("doc")).agg(
        F.count(F.lit(1)).cast("string").alias("documents"), F.count_distinct("lang").cast("string").alias("languages"), F.max("n_chars").alias("longest")
    )
    told = told.withColumn("longest", F.when(F.col("longest") > 10_000, F.col("longest").cast("string")))
    facts = told.select("doc", F.expr("stack(3, 'documents', documents, 'languages', languages, 'longest', longest) AS (key, value)"))
    labels = spark.createDataFrame([(1, "documents", "Documents"), (2, "languages", "Languages"), (3, "longest", "Longest")], "ord int, key string, label string")
    return D.render_diagnostics(facts, labels)


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    given = docs.select(
        document().alias("doc"),
        F.col("doc_id").alias("page"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("text"),
        (F.col("doc_id") % 7 == 0).alias("flagged"),
        (F.col("doc_id") % 11 == 0).alias("hinted"),
        (F.col("doc_id") % 3 == 0).alias("encoding_issue"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("fallback_text"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("ocr_text"),
    )
    return D.route_ocr(given)


_ROUTED = f"""given AS (SELECT {DOC} AS doc, doc_id AS page, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text, doc_id % 7 = 0 AS flagged, doc_id % 11 = 0 AS hinted, doc_id % 3 = 0 AS issue,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS fallback, CASE WHEN doc_id % 4 = 0 THEN text END AS ocr FROM documents),
f AS (SELECT *, {_TOKENS.format("fallback")} AS toks FROM given),
g AS (SELECT * EXCLUDE (toks), trim(fallback) <> '' AND ({_GARBLE.format("fallback")}) < 0.15 AND (NOT issue OR NOT (({_GARBLE.format("fallback")}) >= 0.15 OR ({_MIXED}) >= 0.15)) AS accepted FROM f),
h AS (SELECT *, {_TOKENS.format("text")} AS toks FROM g),
routed AS (SELECT *, flagged OR hinted OR trim(text) = '' OR (NOT accepted AND (({_GARBLE.format("text")}) >= 0.15 OR ({_MIXED}) >= 0.15)) AS needs_ocr FROM h),
told AS (SELECT *, CASE WHEN needs_ocr AND ocr IS NOT NULL AND trim(ocr) <> '' THEN 'ocr' WHEN accepted THEN 'fallback' WHEN needs_ocr THEN 'missing' ELSE 'native' END AS provenance FROM routed)"""


@query("ocr_routing", f"WITH {_ROUTED} SELECT doc, page, accepted, needs_ocr FROM told")
def ocr_routing(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("doc", "page", "accepted", "needs_ocr")


@query("provenance", f"WITH {_ROUTED} SELECT doc, provenance, count(*) AS pages, sum(CASE provenance WHEN 'ocr' THEN length(ocr) WHEN 'fallback' THEN length(fallback) WHEN 'native' THEN length(text) END) AS characters FROM told GROUP BY doc, provenance")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).groupBy("doc", "provenance").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("chosen")).alias("characters"))
