"""Discovery, admission, manifest upkeep and availability of corpus documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import compatible
from ..functions.udfs import identity

# Words of annual reports, of other filings, of penalised pages, and trusted hosts.
REPORT_WORDS = r"(?i)annual[-_\s]?report|form[-_\s]?10[-_\s]?k|10-k|有価証券報告書|有報|統合報告書|年次報告書"
NON_ANNUAL = r"(?i)quarter(?:ly)?|interim|半期報告書|四半期|決算短信|決算説明"
PENALISED = r"(?i)proxy|sustainability|esg|quarter|presentation"
FILING_HOSTS = ("disclosure.edinet-fsa.go.jp", "disclosure2.edinet-fsa.go.jp", "disclosure2dl.edinet-fsa.go.jp")
STAGES = ("map", "page", "search", "deep_search")
VERIFIED = ("assignment_supplied", "human_verified", "independently_verified")


def host(url: Column) -> Column:
    """Lower-cased host without port or user."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def on_domain(url: Column, domain: Column) -> Column:
    return (domain != "") & ((host(url) == domain) | F.endswith(host(url), F.concat(F.lit("."), domain)))


def looks_like_report(url: Column, title: Column, description: Column, year: Column) -> Column:
    """Year and report words in the joined fields, and no other filing's words, spaced or not."""
    text = F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    packed = F.regexp_replace(compatible(text), r"(?U)\s+", "")
    return text.contains(year.cast("string")) & text.rlike(REPORT_WORDS) & ~text.rlike(NON_ANNUAL) & ~packed.rlike(NON_ANNUAL)


def _years(text: Column) -> Column:
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), 0)
    return F.array_max(F.transform(F.filter(runs, lambda x: x.rlike("^(19|20)[0-9]{2}$")), lambda x: x.cast("int")))


def primary_year(title: Column, url: Column, description: Column, requested: list[int]) -> Column:
    """The newest year of the first field that has one, if requested."""
    year = F.coalesce(_years(title), _years(url), _years(description))
    return F.when(year.isin(*requested), year)


def candidate_score(url: Column, title: Column, description: Column, year: Column, domain: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return (
        F.when((host(url) == domain) | F.endswith(host(url), F.concat(F.lit("."), domain)), 7).otherwise(0)
        + F.when(F.endswith(F.lower(url_path(url)), F.lit(".pdf")), 5).otherwise(0)
        + F.when(text.contains(year.cast("string")), 4).otherwise(0)
        + F.when(text.rlike(REPORT_WORDS), 3).otherwise(0)
        - F.when(text.rlike(PENALISED), 4).otherwise(0)
    )


def _filing_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "").isin(*FILING_HOSTS)


def trusted_filing(url: Column, company_key: Column, result_key: Column) -> Column:
    """Whether a public filing host holds the page and the result names the company."""
    return _filing_host(url) & (company_key != "") & result_key.contains(company_key)


def _hit_year(years: Column) -> Column:
    """The year that a result is a report of, if it is among ``years``."""
    url, title, description = (F.col(c) for c in ("url", "title", "description"))
    year = F.coalesce(_years(title), _years(url), _years(description))
    return F.when(F.array_contains(years, year) & looks_like_report(url, title, description, year), year)


def staged(results: DataFrame, companies: DataFrame, years: list[int], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """The results that discovery in stages comes to see, with ``stage`` (counted from 0) and ``supplied``.

    A stage is asked for a company only while the stages before it, in the order of ``stages``,
    leave one of ``years`` open; ``deep_search`` for an open year alone, the one it was asked for (column ``asked``).
    The site's own stages, ``map`` and ``page``, need a domain. A result supplies a year if it is a report of it
    and no earlier stage has one; ``supplied`` is that year or null. Results of other stages are left out.

    The stage that first holds a year is a minimum, and a company's last such stage a maximum, so the stages need one
    aggregate and not a pass each: a stage counts only where all before it left a year open.
    """
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("discovery")).cast("int") - 1
    own = (F.col("domain") != "") | ~F.col("discovery").isin("map", "page")
    seen = results.join(companies.select("company", "domain"), "company").withColumn("stage", order).where((F.col("stage") >= 0) & own)
    seen = seen.withColumn("_hit", _hit_year(F.array(*map(F.lit, years))))
    last = len(stages)
    first = seen.where("_hit IS NOT NULL").groupBy("company", "_hit").agg(F.min("stage").alias("_first"))
    by_year = first.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("_hit", "_first"))).alias("_by_year"))
    told = seen.join(by_year, "company", "left")
    since = lambda y: F.coalesce(F.try_element_at("_by_year", y), F.lit(last))
    done = F.greatest(*[since(F.lit(y)) for y in years]) if len(years) > 1 else since(F.lit(years[0]))
    asked = F.col("asked").cast("int") if "asked" in results.columns else F.lit(None).cast("int")
    deep = F.col("discovery") == "deep_search"
    kept = told.where(F.when(deep, asked.isin(*years) & (since(asked) >= F.col("stage"))).otherwise(done >= F.col("stage")))
    return kept.withColumn("supplied", F.when(since(F.col("_hit")) == F.col("stage"), F.col("_hit"))).drop("_by_year", "_hit", "domain")


def open_years(results: DataFrame, companies: DataFrame, years: list[int], stages: tuple[str, ...]) -> DataFrame:
    """(company, year) that ``stages`` leave open: what the next stage's source is to be asked for."""
    asked = companies.select("company", F.explode(F.array(*map(F.lit, years))).alias("year"))
    held = staged(results, companies, years, stages).where("supplied IS NOT NULL").select("company", F.col("supplied").alias("year"))
    return asked.join(held, ["company", "year"], "left_anti")


def discover(results: DataFrame, companies: DataFrame, years: list[int], best: int = 5, stages: tuple[str, ...] | None = None) -> DataFrame:
    """Best candidates for each company and year; with ``stages``, among what ``staged`` sees.

    ``results``: company, seq, discovery, url, title, description. ``companies``:
    company, domain. Search hits off an official domain are dropped, but for
    filings on public filing hosts that name the company; the first hit of
    (company, year, url) counts; ties go to the smaller url. ``source_verified``
    tells filings and what the official site holds or leads to.
    """
    if stages is not None:
        results = staged(results, companies, years, stages).drop("stage", "supplied")
    companies = companies.withColumn("_company_key", identity("company"))
    joined = results.join(companies, "company").where(F.col("url").rlike("^https?://"))
    dated = joined.withColumn("year", primary_year(F.col("title"), F.col("url"), F.col("description"), years)).where("year IS NOT NULL")
    report = dated.where(looks_like_report(F.col("url"), F.col("title"), F.col("description"), F.col("year")))
    searched = F.col("discovery").isin("search", "deep_search")
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    told = report.withColumn("_key", identity(F.when(_filing_host(F.col("url")), said))).withColumn("_trusted", trusted_filing(F.col("url"), F.col("_company_key"), F.col("_key")))
    own = on_domain(F.col("url"), F.col("domain"))
    told = told.withColumn("source_verified", F.col("_trusted") | ((F.col("domain") != "") & (own | ~searched)))
    kept = told.where(~searched | (F.col("domain") == "") | own | F.col("_trusted")).drop("_company_key", "_key", "_trusted")
    first = kept.withColumn("_rn", F.row_number().over(W.partitionBy("company", "year", "url").orderBy("seq"))).where("_rn = 1")
    scored = first.withColumn("score", candidate_score(F.col("url"), F.col("title"), F.col("description"), F.col("year"), F.col("domain")))
    return top_candidates(scored, best).drop("_rn")


def found_years(results: DataFrame, requested: DataFrame) -> DataFrame:
    """(company, found, missing): requested years with and without a report among a company's results.

    ``results``: company, url, title, description. ``requested``: company, years (sorted, distinct).
    """
    args = [F.col(c) for c in ("url", "title", "description")]
    joined = results.join(requested, "company")
    year = F.coalesce(_years(args[1]), _years(args[0]), _years(args[2]))
    hit = joined.withColumn("year", F.when(F.array_contains("years", year), year)).where(F.col("year").isNotNull() & looks_like_report(*args, F.col("year")))
    found = hit.groupBy("company").agg(F.array_sort(F.collect_set("year")).alias("found"))
    told = requested.join(found, "company", "left").withColumn("found", F.coalesce("found", F.array().cast("array<int>")))
    return told.select("company", "found", F.array_except(F.col("years").cast("array<int>"), "found").alias("missing"))


def top_candidates(scored: DataFrame, best: int, by: tuple[str, ...] = ("company", "year")) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "url")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_rn = 1").drop("_rn")


def links_of(markdown: DataFrame) -> DataFrame:
    """(doc, seq, label, url, year) of ``[label](http…)`` links; a link takes the
    year in its label, else the nearest one in the 180 characters before it."""
    found = markdown.select("doc", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\[[^\]\n]*\]\(https?://[^)\s]+\))"), 1)).alias("seq", "link"))
    at = found.withColumn("at", F.expr("instr(text, link)"))
    before = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("at") - 180), F.least(F.lit(180), F.col("at") - 1))
    label = F.regexp_extract("link", r"^\[([^\]]*)\]", 1)
    last = F.try_element_at(F.regexp_extract_all(before, F.lit("((?:19|20)[0-9]{2})"), 1), F.lit(-1))
    year = F.coalesce(F.nullif(F.regexp_extract(label, "((?:19|20)[0-9]{2})", 1), F.lit("")), last)
    return at.select("doc", "seq", label.alias("label"), F.regexp_extract("link", r"\((https?://[^)\s]+)\)$", 1).alias("url"), year.alias("year"))


# A labelled link up to its closing parenthesis, and a year before one.
LABELLED = r"(?U)\[([^\]]+)\]\((https?://[^)\s]+)"
YEAR_BEFORE = r"(?U)(20\d{2})(?:年|\b)"
#: Characters before a link that are searched, and pieces that hold them: a link has 12 characters at least.
NEARBY, PIECES = 180, 2 * (180 // 12) + 2


def scraped_links(pages: DataFrame) -> DataFrame:
    """(doc, seq, url, title): a page's links, each address once, labelled ones first.

    ``pages``: doc, markdown, links (array<struct<url, text>>). A labelled link's title is its label, after the last
    year in the characters before it if the label lacks that year. Raw links follow in their order; one without
    a text has an empty title.

    A split at the links gives the text between them, so that the characters before each link are the end of a
    bounded number of pieces, and equal links keep places of their own.
    """
    given = pages.select("doc", F.coalesce("markdown", F.lit("")).alias("markdown"), F.coalesce("links", F.array().cast("array<struct<url: string, text: string>>")).alias("links"))
    between = F.split("markdown", LABELLED, -1)
    links = F.regexp_extract_all("markdown", F.lit(LABELLED), 0)
    pieces = F.flatten(F.zip_with(between, links, lambda t, link: F.array(t, F.coalesce(link, F.lit("")))))
    split = given.select("doc", pieces.alias("pieces")).where(F.size("pieces") > 2)

    def placed(k: Column) -> Column:
        before = F.slice("pieces", F.greatest(F.lit(1), 2 * k + 2 - PIECES), F.least(F.lit(PIECES), 2 * k + 1))
        return F.struct(F.get("pieces", 2 * k + 1).alias("link"), F.right(F.array_join(before, ""), F.lit(NEARBY)).alias("before"))

    each = split.select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("pieces") / 2).cast("int") - 2), placed)).alias("seq", "p"))
    label = F.trim(F.regexp_replace(F.regexp_extract("p.link", LABELLED, 1), r"(?U)^\s+|\s+$", ""))
    year = F.try_element_at(F.regexp_extract_all("p.before", F.lit(YEAR_BEFORE), 1), F.lit(-1))
    title = F.when(year.isNotNull() & ~F.contains(label, year), F.trim(F.concat_ws(" ", year, label))).otherwise(label)
    labelled = each.select("doc", F.lit(0).alias("kind"), "seq", F.regexp_extract("p.link", LABELLED, 2).alias("url"), title.alias("title"))
    raw = given.select("doc", F.posexplode("links").alias("seq", "x")).where(F.coalesce("x.url", F.lit("")) != "")
    raw = raw.select("doc", F.lit(1).alias("kind"), "seq", "x.url", F.coalesce("x.text", F.lit("")).alias("title"))
    first = labelled.unionByName(raw).groupBy("doc", "url").agg(F.min(F.struct("kind", "seq", "title")).alias("f"))
    order = F.row_number().over(W.partitionBy("doc").orderBy("f.kind", "f.seq")) - 1
    return first.select("doc", order.alias("seq"), "url", "f.title")


def upsert(existing: DataFrame, incoming: DataFrame, digest: str, key: list[str], verification: str) -> DataFrame:
    """The manifest after an upsert: incoming documents replace those of the same
    digest or key; a verification survives only with an identical digest. Two equality
    anti joins stand for the OR. ``incoming`` has one row for each digest and key."""
    kept = existing.join(incoming.select(digest), digest, "left_anti").join(incoming.select(*key), key, "left_anti")
    prior = existing.where(F.col(verification).isNotNull()).groupBy(digest).agg(F.max(verification).alias("_prior"))
    carried = incoming.join(prior, digest, "left").withColumn(verification, F.coalesce(verification, "_prior")).drop("_prior")
    return kept.unionByName(carried.select(*existing.columns))


def priority_merge(first: DataFrame, second: DataFrame, key: list[Column]) -> DataFrame:
    """All identities of both; ``first`` wins."""
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)))
    keyed = both.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    rank = F.row_number().over(W.partitionBy(*names).orderBy("_p"))
    return keyed.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_p", *names)


def availability(requested: DataFrame, downloaded: DataFrame, failed: DataFrame, searched: DataFrame) -> DataFrame:
    """Status of each requested (company, year): downloaded, not_downloaded (with
    reasons), candidate_found or not_found, else pending.

    ``failed``: company, year, reason. ``searched``: company, candidates.
    """
    got = downloaded.select("company", "year", F.lit(True).alias("_got")).distinct()
    reasons = failed.groupBy("company", "year").agg(F.array_join(F.array_sort(F.collect_set("reason")), " | ").alias("reason"))
    joined = requested.join(got, ["company", "year"], "left").join(reasons, ["company", "year"], "left").join(searched, "company", "left")
    status = (
        F.when(F.col("_got"), "downloaded")
        .when(F.col("reason").isNotNull(), "not_downloaded")
        .when(F.col("candidates") > 0, "candidate_found")
        .when(F.col("candidates") == 0, "not_found")
        .otherwise("pending")
    )
    return joined.select("company", "year", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(~F.coalesce("_got", F.lit(False)), F.col("reason")).alias("reason"))


def targets(stored: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """Stored companies, then seeds not stored yet, at most ``cap`` (a report's limit)."""
    new = seeds.join(stored.select("key"), "key", "left_anti").withColumn("origin", F.lit("seed"))
    both = stored.withColumn("origin", F.lit("stored")).unionByName(new)
    return both.orderBy(F.desc("origin"), "key").limit(cap)


def verified(status: Column) -> Column:
    return status.isin(*VERIFIED)


def corpus_counts(documents: DataFrame) -> DataFrame:
    """One row of counts over (company, screened, verification)."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("company").alias("companies"),
        *[F.count_if(F.col("screened") == s).alias(f"screened_{s}") for s in ("ok", "review", "unreadable")],
        F.count_if(verified(F.col("verification"))).alias("verified"),
        F.count_if(F.col("verification") == "candidate").alias("candidates"),
    )


def company_states(documents: DataFrame) -> DataFrame:
    """State of each company: pending, unreadable (any), verified (all) or review; pages and year range."""
    known = F.col("doc").isNotNull()
    told = documents.groupBy("company").agg(
        F.count("doc").alias("documents"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_if(known & verified(F.col("verification"))).alias("verified"),
        F.bool_or(F.col("screened") == "unreadable").alias("_bad"),
    )
    state = F.when(F.col("documents") == 0, "pending").when(F.col("_bad"), "unreadable").when(F.col("verified") == F.col("documents"), "verified").otherwise("review")
    return told.withColumn("state", state).drop("_bad")


def contains_markers(sources: DataFrame, markers: DataFrame, on: list[str]) -> DataFrame:
    """Whether every marker of a source stands in its text, white space aside."""
    packed = sources.select(*on, F.regexp_replace("text", r"(?U)\s+", "").alias("packed"))
    joined = markers.join(packed, on, "left")
    hit = F.coalesce(F.contains("packed", F.regexp_replace("marker", r"(?U)\s+", "")), F.lit(False))
    return joined.groupBy(*on).agg(F.count(F.lit(1)).alias("markers"), F.count_if(hit).alias("found"), F.bool_and(hit).alias("verified"))
