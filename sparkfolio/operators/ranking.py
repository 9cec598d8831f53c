"""Deterministic page ranking and adaptive selection of evidence pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import DESCRIPTIONS, SCHEMA
from ..sources.tables import settled

# BM25 constants, and weights and bounds of the other signals.
K1, B = 1.5, 0.75
TOKEN = r"[a-z][a-z0-9&-]+|\p{Nd}+(?:[.,]\p{Nd}+)*"

# Navigation terms of Japanese statements, found by substring.
JAPANESE_TERMS = (
    "貸借対照表", "財務諸表", "資産の部", "流動資産", "固定資産", "資産合計", "現金及び預金", "売掛金", "受取手形", "棚卸資産", "商品及び製品", "原材料及び貯蔵品",
    "有形固定資産", "建物及び構築物", "機械装置", "土地", "建設仮勘定", "減価償却累計額", "無形固定資産", "のれん", "投資その他の資産", "投資有価証券", "敷金及び保証金", "繰延税金資産",
)

# Patterns of statement headings, of pages to avoid, and of critical evidence.
HEADINGS = (
    r"(?im)^#{1,4}\s+.*(?:balance sheets?|financial position)",
    r"(?im)^#{1,4}\s+.*(?:property,? plant|equipment|intangible|goodwill|inventor|receiv)",
    r"(?i)(?:consolidated\s+)?balance sheets?",
    r"(?i)statements? of financial position",
    r"(?i)notes? to (?:the )?(?:consolidated )?financial statements",
    r"(?:連結)?貸借対照表",
    r"(?:連結)?財務諸表",
    r"資産の部",
)
REJECTS = (
    r"(?i)proxy statement",
    r"(?i)board of directors",
    r"(?i)executive compensation",
    r"(?i)shareholder proposal",
    r"(?i)corporate governance",
    r"(?i)table of contents",
    r"取締役|役員の状況|コーポレート.?ガバナンス|株主総会|目次",
)
CRITICAL = (
    ("right_of_use_assets", r"(?i)(?:operating\s+lease\s+)?right[-\s]+of[-\s]+use\s+assets?"),
    ("japanese_investment_breakdown", r"市場価格のない株式等"),
    ("japanese_accumulated_depreciation", r"減価償却累計額"),
    ("japanese_loan_maturity", r"金銭債権の連結決算日後の償還予定額"),
)

# Words of accounting that point to statement pages.
ACCOUNTING = (
    "balance sheet", "statement of financial position", "financial statements", "current assets", "total assets", "cash and cash equivalents", "accounts receivable", "trade receivables", "inventories",
    "marketable securities", "prepaid expenses", "other current assets", "property plant and equipment", "property, plant and equipment", "pp&e", "land", "buildings", "machinery", "construction in progress",
    "equipment", "accumulated depreciation", "goodwill", "intangible assets", "investments", "financial assets", "other assets", "operating lease", "right of use assets", "right-of-use assets", "rou assets",
    "notes to consolidated financial statements",
)
TABLE_ROW = r"(?m)^\s*\|.+\|\s*$"

# Of these, lower-cased, a text must hold one for the pattern to match: a scan for it costs a tenth of the pattern.
NEEDED = {
    **dict(zip(HEADINGS, (("#",), ("#",), ("balance sheet",), ("financial position",), ("financial statements",), ("貸借対照表",), ("財務諸表",), ("資産の部",)), strict=True)),
    **{p: (p.removeprefix("(?i)"),) for p in REJECTS[:-1]},
    REJECTS[-1]: ("取締役", "役員の状況", "ガバナンス", "株主総会", "目次"),
    **dict(zip((p for _, p in CRITICAL), (("right",), *((p,) for _, p in CRITICAL[1:])), strict=True)),
    TABLE_ROW: ("|",),
}
#: Terms that a join may broadcast.
SMALL_VOCABULARY = 500_000


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def accounting_vocabulary(spark: SparkSession) -> DataFrame:
    """(term): the tokens of the schema's names and descriptions and of the accounting words."""
    words = [(w,) for w in (*ACCOUNTING, *(x for row in SCHEMA for x in row), *DESCRIPTIONS)]
    return spark.createDataFrame(words, "w string").select(F.explode(tokens_of(F.col("w"))).alias("term")).distinct()


def _hits(text: Column, patterns) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def _matches(text: Column, lowered: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, asked of those texts only that hold what the pattern needs."""
    held = [F.contains(lowered, F.lit(x)) for x in NEEDED[pattern]]
    return reduce(lambda a, b: a | b, held) & text.rlike(pattern)


def score_pages(pages: DataFrame, vocabulary: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Explainable score of every page with text.

    ``pages``: doc, page, text. ``vocabulary``: term (distinct). ``layout``: doc,
    page, has_table, has_column, at most one row a page. Tokens are kept to the
    vocabulary before anything is shuffled; document statistics are aggregates
    over (doc, term) and (doc). Texts are looked at once: what is told of a page is
    written, and the rest reads that.

    BM25 terms are summed as decimals, so the sum does not depend on its order.
    """
    usable = pages.where(F.col("text").rlike(r"(?U)\S")).withColumn("lowered", F.lower("text"))
    usable = usable.withColumn("tokens", F.regexp_extract_all("lowered", F.lit(TOKEN), 0))
    text, lowered = F.col("text"), F.col("lowered")
    hits = lambda patterns: sum((_matches(text, lowered, p).cast("int") for p in patterns), F.lit(0))
    told = usable.select(
        "doc",
        "page",
        "tokens",
        F.size("tokens").alias("n_tokens"),
        F.size(F.filter("tokens", lambda t: t.rlike(r"\p{Nd}"))).alias("n_numeric"),
        F.length("text").alias("characters"),
        hits(HEADINGS).alias("heading_hits"),
        hits(REJECTS).alias("reject_hits"),
        _matches(text, lowered, TABLE_ROW).alias("markdown_table"),
        F.array_compact(F.array(*[F.when(_matches(text, lowered, p), n) for n, p in CRITICAL])).alias("critical_evidence"),
        F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), t) for t in JAPANESE_TERMS])).alias("japanese_hits"),
        F.contains("text", F.lit("連結貸借対照表")).alias("consolidated"),
        F.contains("text", F.lit("貸借対照表")).alias("statement"),
    )
    told = settled(told)
    facts = told.drop("tokens")
    terms = vocabulary.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= SMALL_VOCABULARY else terms
    held = told.select("doc", "page", "n_tokens", F.explode("tokens").alias("term")).join(terms, "term")
    counts = held.groupBy("doc", "page", "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))
    docs = facts.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_tokens").alias("all_tokens"), F.bool_or("consolidated").alias("has_consolidated"))
    spread = W.partitionBy("term", "doc")  # terms first: they tell rows apart sooner when they are sorted
    weighed = counts.withColumn("df", F.count(F.lit(1)).over(spread)).join(docs, "doc")
    average = F.when(F.col("all_tokens") > 0, F.col("all_tokens") / F.col("n_pages")).otherwise(F.lit(1.0))
    idf = F.log(1 + (F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("n_tokens", F.lit(1)) / average)))
    bm25 = weighed.groupBy("doc", "page").agg(
        F.sum(part.cast("decimal(38,12)")).cast("double").alias("bm25"), F.count(F.lit(1)).alias("n_terms"), F.slice(F.sort_array(F.collect_list("term")), 1, 24).alias("matched_terms")
    )
    joined = facts.join(docs.select("doc", "has_consolidated"), "doc").join(bm25, ["doc", "page"], "left")
    if layout is not None:
        joined = joined.join(layout.select("doc", "page", "has_table", "has_column"), ["doc", "page"], "left")
    else:
        joined = joined.withColumn("has_table", F.lit(False)).withColumn("has_column", F.lit(False))
    raw, n_terms = F.coalesce("bm25", F.lit(0.0)), F.coalesce("n_terms", F.lit(0))
    table = F.coalesce("has_table", F.lit(False)) | F.col("markdown_table")
    column = F.coalesce("has_column", F.lit(False))
    density = F.col("n_numeric") / F.greatest("n_tokens", F.lit(1))
    alone = F.col("has_consolidated") & F.col("statement") & ~F.col("consolidated")
    score = (
        raw
        + F.least(F.lit(10.0), n_terms * 0.28)
        + F.col("heading_hits") * 4.0
        + F.when(table, 4.0).otherwise(0.0)
        + F.when(column, 0.75).otherwise(0.0)
        + F.least(F.lit(2.0), density * 8.0)
        + F.least(F.lit(16.0), F.size("critical_evidence") * 16.0)
        + F.least(F.lit(18.0), F.size("japanese_hits") * 0.9)
        - F.col("reject_hits") * F.when(F.col("heading_hits") > 0, 1.0).otherwise(3.0)
        - F.when(alone, 12.0).otherwise(0.0)
    )
    return joined.select(
        "doc",
        "page",
        F.bround(score, 4).alias("score"),
        F.bround(raw, 4).alias("bm25"),
        n_terms.cast("bigint").alias("schema_term_hits"),
        F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"),
        "heading_hits",
        table.alias("table_signal"),
        column.alias("column_signal"),
        F.bround(density, 4).alias("numeric_density"),
        "reject_hits",
        alone.alias("standalone_penalty"),
        "critical_evidence",
        "japanese_hits",
        "characters",
    )


def select_pages(scored: DataFrame, minimum: int = 3, maximum: int = 5, share: float = 0.45) -> DataFrame:
    """Ranked pages with ``selected``: the best ``minimum``, then up to ``maximum``
    while each still has ``share`` of the last sure page's score; the first that has not ends it."""
    by_doc = W.partitionBy("doc")
    ranked = scored.withColumn("rank", F.row_number().over(by_doc.orderBy(F.desc("score"), "page"))).withColumn("n", F.count(F.lit(1)).over(by_doc))
    sure = F.least(F.lit(minimum), F.col("n"))
    bar = F.greatest(F.lit(1.0), F.max(F.when(F.col("rank") == sure, F.col("score"))).over(by_doc)) * share
    flagged = ranked.withColumn("bar", bar).withColumn("holds", (F.col("rank") <= sure) | ((F.col("rank") <= maximum) & (F.col("score") >= F.col("bar"))))
    so_far = by_doc.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return flagged.withColumn("selected", F.min(F.col("holds")).over(so_far)).drop("n", "bar", "holds")


def evidence_summary(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per document: pages selected, characters before and after, reduction in percent."""
    size = pages.groupBy("doc").agg(F.sum(F.length("text")).alias("full_characters"))
    told = chosen.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.when(F.col("selected"), F.col("page")))).alias("selected_pages"),
        F.count_if("selected").alias("selected_count"),
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum(F.when(F.col("selected"), F.col("characters")).otherwise(0)).alias("selected_characters"),
    )
    reduction = F.when(F.col("full_characters") > 0, F.bround((1 - F.col("selected_characters") / F.col("full_characters")) * 100, 2)).otherwise(0.0)
    return told.join(size, "doc").withColumn("reduction_percent", reduction)


# Balance-sheet screening.
BALANCE_SHEET = r"(?i)(?:consolidated\s+)?balance\s+sheets?|statement\s+of\s+financial\s+position|貸借対照表|財政状態計算書"
TERM_GROUPS = (
    r"(?i)current\s+assets|流動資産",
    r"(?i)cash\s+and\s+cash|現金(?:及び)?(?:預金|現金同等物)|現金預金",
    r"(?i)inventor|(?:棚卸|たな卸)資産|未成工事支出金|材料貯蔵品",
    r"(?i)total\s+assets|資産(?:合計|の部合計)",
    r"(?i)liabilit|負債(?:合計|の部)",
)
SIGNALS = (
    (8.0, r"(?i)consolidated\s+balance\s+sheets?"),
    (3.0, r"(?i)\bassets\s*\n\s*current\s+assets\b"),
    (3.0, r"(?i)\btotal\s+assets\b"),
    (1.5, r"(?i)\b(?:goodwill|intangible\s+assets)\b"),
    (1.5, r"(?i)\baccumulated\s+depreciation\b"),
)
NUMERIC_LINE = r"(?m)^.*[0-9][0-9,().$ -]*$"
YEARS = (
    r"(?i)(?:at|as\s+of)\s+(?:december|january|september|june|march)[^\n]{0,45}\b((?:19|20)[0-9]{2})\b",
    r"(?i)for\s+the\s+year\s+ended[^\n]{0,45}\b((?:19|20)[0-9]{2})\b",
    r"(?i)fiscal\s+year\s+((?:19|20)[0-9]{2})",
    r"事業年度[^\n]{0,100}?((?:19|20)[0-9]{2})年",
    r"((?:19|20)[0-9]{2})年\s*[0-9]{1,2}月期",
)
JPY = r"(?i)yen\s+in\s+(?:thousands|millions)|Japanese\s+yen|(?:単位\s*[:：]?\s*)?(?:千円|百万円)|日本円"
USD = r"(?i)(?:U\.S\.\s*)?dollars|\$\s*in\s+millions|millions\s+of\s+dollars"


def split_pages(texts: DataFrame) -> DataFrame:
    """(doc, page, text) from (doc, text) with ``--- PAGE n ---`` lines; text before the first is dropped."""
    parts = texts.select("doc", F.explode(F.slice(F.split("text", r"(?m)^--- PAGE (?=[0-9]+ ---$)"), F.lit(2), F.greatest(F.size(F.split("text", r"(?m)^--- PAGE (?=[0-9]+ ---$)")) - 1, F.lit(0)))).alias("part"))
    return parts.select("doc", F.regexp_extract("part", "^([0-9]+)", 1).cast("int").alias("page"), F.regexp_replace("part", r"^[0-9]+ ---", "").alias("text"))


def statement_years(text: Column) -> Column:
    """Sorted distinct 4-digit years that are whole digit runs."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), 0)
    return F.array_sort(F.array_distinct(F.transform(F.filter(runs, lambda x: x.rlike("^(19|20)[0-9]{2}$")), lambda x: x.cast("int"))))


def year_mentions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in YEARS])))


def statement_currency(text: Column) -> Column:
    return F.when(text.rlike(JPY), "JPY").when(text.rlike(USD), "USD").otherwise("unknown")


def screen_documents(pages: DataFrame, expected: DataFrame, balance_sheet: str = BALANCE_SHEET, groups: tuple[str, ...] = TERM_GROUPS, minimum: int = 3) -> DataFrame:
    """Verdict for each document of ``expected`` (doc, year) from its pages (doc, page, text).

    The balance-sheet page is the best-scored candidate, the lowest page on
    ties. The year is confirmed by the newest year printed there, else by a year
    mention anywhere.
    """
    text = F.col("text")
    terms = _hits(text, groups)
    score = terms.cast("double") + sum((F.when(text.rlike(p), s).otherwise(0.0) for s, p in SIGNALS), F.lit(0.0)) + F.least(F.lit(3.0), F.regexp_count(text, F.lit(NUMERIC_LINE)) / 8.0)
    judged = pages.withColumn("ranked", F.when(text.rlike(balance_sheet) & (terms >= minimum), F.struct(score.alias("score"), (-F.col("page")).alias("low"), F.col("page"))))
    whole = judged.groupBy("doc").agg(
        F.max("ranked").alias("best"),
        F.count_if(F.trim("text") != "").alias("readable_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(year_mentions(text))))).alias("mentions"),
    )
    told = expected.join(whole, "doc", "left").withColumn("page", F.col("best.page"))  # the page's text is read again, not carried
    told = told.join(pages.select("doc", "page", text.alias("statement")), ["doc", "page"], "left").withColumn("statement", F.coalesce("statement", F.lit("")))
    years = statement_years(F.col("statement"))
    newest = F.array_max(years)
    confirmed = F.when(newest.isNotNull(), newest == F.col("year")).otherwise(F.coalesce(F.array_contains("mentions", F.col("year").cast("string")), F.lit(False)))
    told = told.withColumn("year_confirmed", confirmed).withColumn("readable_pages", F.coalesce("readable_pages", F.lit(0)))
    reasons = F.array_compact(F.array(F.when(~F.col("year_confirmed"), "year not confirmed"), F.when(F.col("readable_pages") == 0, "no readable text"), F.when(F.col("best").isNull(), "no balance sheet")))
    return told.select(
        "doc",
        "year",
        F.when(F.col("readable_pages") == 0, "unreadable").when(F.size(reasons) > 0, "review").otherwise("ok").alias("verdict"),
        reasons.alias("reasons"),
        F.col("best.page").alias("balance_sheet_page"),
        F.col("best.score").alias("balance_sheet_score"),
        newest.alias("reporting_year"),
        statement_currency(F.col("statement")).alias("currency"),
        "year_confirmed",
        "readable_pages",
    )
