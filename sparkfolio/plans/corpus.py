"""Queries over discovery, manifests and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import documents as D
from ..operators import verification as V
from .catalog import query, table

_HOST = "lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("url_domain_match", f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') AS on_domain FROM pages")
def url_domain_match(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", C.host(url).alias("host"), C.url_path(url).alias("path"), C.on_domain(url, F.lit("example.net")).alias("on_domain"))


# Pages as crawl results: titles are made so that years and report words occur, and some are
# filings on a public host, of which every other one names the company.
_RESULTS = f"""given AS (SELECT split_part({_HOST}, '.', -3) || '.' || split_part({_HOST}, '.', -2) || '.' || split_part({_HOST}, '.', -1) AS company, page_id AS seq,
  CASE page_id % 4 WHEN 0 THEN 'map' WHEN 1 THEN 'page' WHEN 2 THEN 'search' ELSE 'deep_search' END AS discovery, url,
  CASE page_id % 3 WHEN 0 THEN 'Annual Report ' || (2019 + page_id % 8) WHEN 1 THEN 'Form 10-K' ELSE 'Quarterly news ' || (2020 + page_id % 5) END AS title,
  'filed ' || (2020 + page_id % 6) || ' or ' || (2018 + page_id % 3) AS description FROM pages),
results AS (SELECT company, seq, discovery, CASE WHEN seq % 12 = 6 THEN 'https://disclosure2.edinet-fsa.go.jp/d/' || seq || '.pdf' ELSE url END AS url, title, description || CASE WHEN seq % 24 = 6 THEN ' for ' || company ELSE '' END AS description FROM given)"""


def _results(spark: SparkSession, folder: str) -> DataFrame:
    labels = F.split(C.host(F.col("url")), r"\.")
    k = F.col("page_id")
    last = lambda n: F.coalesce(F.try_element_at(labels, F.lit(-n)), F.lit(""))
    say = lambda s, n: F.concat(F.lit(s), n.cast("string"))
    company = F.concat_ws(".", last(3), last(2), last(1))
    filed = F.concat(F.lit("https://disclosure2.edinet-fsa.go.jp/d/"), k.cast("string"), F.lit(".pdf"))
    return table(spark, folder, "pages").select(
        company.alias("company"),
        k.alias("seq"),
        F.element_at(F.array(*map(F.lit, ("map", "page", "search", "deep_search"))), (k % 4 + 1).cast("int")).alias("discovery"),
        F.when(k % 12 == 6, filed).otherwise(F.col("url")).alias("url"),
        F.when(k % 3 == 0, say("Annual Report ", 2019 + k % 8)).when(k % 3 == 1, "Form 10-K").otherwise(say("Quarterly news ", 2020 + k % 5)).alias("title"),
        F.concat(say("filed ", 2020 + k % 6), say(" or ", 2018 + k % 3), F.when(k % 24 == 6, F.concat(F.lit(" for "), company)).otherwise("")).alias("description"),
    )


_NEWEST = "list_max(list_transform(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]{{2}}$')), lambda x: x::INTEGER))"
_YEARED = f"{_RESULTS}, yeared AS (SELECT *, CASE WHEN y BETWEEN 2020 AND 2025 THEN y END AS year FROM (SELECT *, coalesce({_NEWEST.format('title')}, {_NEWEST.format('url')}, {_NEWEST.format('description')}) AS y FROM results))"
_TEXT = "concat_ws(' ', url, title, description)"
_KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_TRUSTED = f"({_HOST} IN {C.FILING_HOSTS} AND contains({_KEY.format("concat_ws(' ', title, description)")}, {_KEY.format('company')}))"
_OWN = f"({_HOST} = domain OR ends_with({_HOST}, '.' || domain))"
_FOUND = f"""{_YEARED}, reports AS (SELECT * FROM yeared WHERE year IS NOT NULL AND regexp_matches(url, '^https?://') AND contains({_TEXT}, year::VARCHAR) AND regexp_matches({_TEXT}, '{C.REPORT_WORDS}')
  AND NOT regexp_matches({_TEXT}, '{C.NON_ANNUAL}') AND NOT regexp_matches(regexp_replace({_TEXT}, '\\s+', '', 'g'), '{C.NON_ANNUAL}')),
kept AS (SELECT *, 'example.' || CASE WHEN contains(company, 'example.net') THEN 'net' ELSE 'org' END AS domain FROM reports),
first AS (SELECT *, {_TRUSTED} OR {_OWN} OR discovery NOT IN ('search', 'deep_search') AS source_verified FROM kept WHERE discovery NOT IN ('search', 'deep_search') OR {_OWN} OR {_TRUSTED} QUALIFY row_number() OVER (PARTITION BY company, year, url ORDER BY seq) = 1),
scored AS (SELECT *, CASE WHEN {_HOST} = domain OR ends_with({_HOST}, '.' || domain) THEN 7 ELSE 0 END + CASE WHEN ends_with(lower({_PATH}), '.pdf') THEN 5 ELSE 0 END + CASE WHEN contains({_TEXT}, year::VARCHAR) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches({_TEXT}, '{C.REPORT_WORDS}') THEN 3 ELSE 0 END - CASE WHEN regexp_matches({_TEXT}, '{C.PENALISED}') THEN 4 ELSE 0 END AS score FROM first),
ranked AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY score DESC, url) AS rank FROM scored)"""


def _found(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    domain = F.concat(F.lit("example."), F.when(F.contains("company", F.lit("example.net")), "net").otherwise("org"))
    return C.discover(results, results.select("company").distinct().withColumn("domain", domain), [*range(2020, 2026)])


@query("candidate_score_top5", f"WITH {_FOUND} SELECT company, year, url, score, rank, source_verified FROM ranked WHERE rank <= 5")
def candidate_score_top5(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("company", "year", "url", "score", "rank", "source_verified")


@query("found_years", f"""WITH {_YEARED}, hits AS (SELECT DISTINCT company, year FROM yeared WHERE year IS NOT NULL AND contains({_TEXT}, year::VARCHAR) AND regexp_matches({_TEXT}, '{C.REPORT_WORDS}') AND NOT regexp_matches({_TEXT}, '{C.NON_ANNUAL}') AND NOT regexp_matches(regexp_replace({_TEXT}, '\\s+', '', 'g'), '{C.NON_ANNUAL}'))
SELECT c.company, y.year, h.year IS NOT NULL AS found FROM (SELECT DISTINCT company FROM results) c CROSS JOIN (SELECT unnest(range(2020, 2026))::INTEGER AS year) y LEFT JOIN hits h ON h.company = c.company AND h.year = y.year""")
def found_years(spark: SparkSession, folder: str) -> DataFrame:
    results = _results(spark, folder)
    wanted = results.select("company").distinct().withColumn("years", F.array(*map(F.lit, range(2020, 2026))))
    told = C.found_years(results, wanted)
    flags = F.concat(F.transform("found", lambda y: F.struct(y.alias("year"), F.lit(True).alias("found"))), F.transform("missing", lambda y: F.struct(y.alias("year"), F.lit(False).alias("found"))))
    return told.select("company", F.explode(flags).alias("y")).select("company", "y.year", "y.found")


_STAGED = f"""{_RESULTS}, asked AS (SELECT *, 2020 + seq % 6 AS asked, CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS stage,
  CASE WHEN contains(company, 'example.net') THEN '' ELSE 'example.org' END AS domain FROM results),
hits AS (SELECT *, CASE WHEN y BETWEEN 2020 AND 2023 AND contains({_TEXT}, y::VARCHAR) AND regexp_matches({_TEXT}, '{C.REPORT_WORDS}') AND NOT regexp_matches({_TEXT}, '{C.NON_ANNUAL}')
  AND NOT regexp_matches(regexp_replace({_TEXT}, '\\s+', '', 'g'), '{C.NON_ANNUAL}') THEN y END AS hit
  FROM (SELECT *, coalesce({_NEWEST.format('title')}, {_NEWEST.format('url')}, {_NEWEST.format('description')}) AS y FROM asked WHERE stage > 1 OR domain <> '')),
years AS (SELECT company, year FROM (SELECT DISTINCT company FROM results), (SELECT unnest(range(2020, 2024)) AS year)),
s0 AS (SELECT * FROM hits WHERE stage = 0),
o0 AS (SELECT * FROM years y WHERE NOT EXISTS (SELECT 1 FROM s0 h WHERE h.company = y.company AND h.hit = y.year)),
s1 AS (SELECT * FROM hits WHERE stage = 1 AND company IN (SELECT company FROM o0)),
o1 AS (SELECT * FROM o0 y WHERE NOT EXISTS (SELECT 1 FROM s1 h WHERE h.company = y.company AND h.hit = y.year)),
s2 AS (SELECT * FROM hits WHERE stage = 2 AND company IN (SELECT company FROM o1)),
o2 AS (SELECT * FROM o1 y WHERE NOT EXISTS (SELECT 1 FROM s2 h WHERE h.company = y.company AND h.hit = y.year)),
s3 AS (SELECT h.* FROM hits h JOIN o2 ON o2.company = h.company AND o2.year = h.asked WHERE stage = 3),
pool AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
supplied AS (SELECT company, hit AS year, min(stage) AS stage FROM pool WHERE hit IS NOT NULL GROUP BY 1, 2)"""


def _staged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    results = _results(spark, folder).withColumn("asked", (2020 + F.col("seq") % 6).cast("int"))
    domain = F.when(F.contains("company", F.lit("example.net")), "").otherwise("example.org")
    return results, results.select("company").distinct().withColumn("domain", domain)


@query("staged_results", f"WITH {_STAGED} SELECT p.seq AS page_id, p.company, p.discovery, CASE WHEN s.stage = p.stage THEN p.hit END AS supplied FROM pool p LEFT JOIN supplied s ON s.company = p.company AND s.year = p.hit")
def staged_results(spark: SparkSession, folder: str) -> DataFrame:
    return C.staged(*_staged(spark, folder), [*range(2020, 2024)]).select(F.col("seq").alias("page_id"), "company", "discovery", "supplied")


@query("staged_years", f"""WITH {_STAGED} SELECT y.company, y.year, ['map', 'page', 'search', 'deep_search'][s.stage + 1] AS supplied_by, count(p.seq) AS results FROM years y
LEFT JOIN supplied s ON s.company = y.company AND s.year = y.year LEFT JOIN pool p ON p.company = y.company AND p.hit = y.year AND p.stage = s.stage GROUP BY ALL""")
def staged_years(spark: SparkSession, folder: str) -> DataFrame:
    results, companies = _staged(spark, folder)
    years = [*range(2020, 2024)]
    told = C.staged(results, companies, years).where("supplied IS NOT NULL").groupBy("company", F.col("supplied").alias("year"), F.col("discovery").alias("supplied_by")).agg(F.count(F.lit(1)).alias("results"))
    left = C.open_years(results, companies, years, C.STAGES).select("company", "year", F.lit(None).cast("string").alias("supplied_by"), F.lit(0).cast("bigint").alias("results"))
    return told.unionByName(left)


@query("staged_open_years", f"WITH {_STAGED} SELECT company, year FROM o1")
def staged_open_years(spark: SparkSession, folder: str) -> DataFrame:
    return C.open_years(*_staged(spark, folder), [*range(2020, 2024)], C.STAGES[:2])


@query("fallback_fetch", f"""WITH {_FOUND}, tried AS (SELECT *, seq % 3 <> 1 AS passed FROM ranked WHERE rank <= 5),
told AS (SELECT company, year, min(CASE WHEN passed THEN rank END) AS used FROM tried GROUP BY company, year)
SELECT t.company, t.year, any_value(used) AS used_rank, max(CASE WHEN rank = used THEN url END) AS url, coalesce(string_agg('rejected ' || url, '; ' ORDER BY rank) FILTER (NOT passed AND rank < coalesce(used, 99)), '') AS failures FROM tried t JOIN told USING (company, year) GROUP BY t.company, t.year""")
def fallback_fetch(spark: SparkSession, folder: str) -> DataFrame:
    tried = _found(spark, folder).withColumn("passed", F.col("seq") % 3 != 1)
    told = tried.withColumn("used", F.min(F.when(F.col("passed"), F.col("rank"))).over(W.partitionBy("company", "year")))
    bad = ~F.col("passed") & (F.col("rank") < F.coalesce("used", F.lit(99)))
    failures = F.array_sort(F.collect_list(F.when(bad, F.struct("rank", F.concat(F.lit("rejected "), F.col("url")).alias("s")))))
    return told.groupBy("company", "year").agg(
        F.first("used").alias("used_rank"), F.max(F.when(F.col("rank") == F.col("used"), F.col("url"))).alias("url"), F.array_join(F.transform(failures, lambda x: x["s"]), "; ").alias("failures")
    )


@query("first_seen_dedupe", "SELECT sha, doc_id, source FROM (SELECT md5(text) AS sha, doc_id, source FROM documents) QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1")
def first_seen_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.md5(F.col("text").cast("binary")).alias("sha"), "doc_id", "source")
    return C.first_seen(docs, ["sha"], "doc_id")


@query("primary_year", f"WITH {_YEARED} SELECT seq AS page_id, year FROM yeared")
def primary_year(spark: SparkSession, folder: str) -> DataFrame:
    year = C.primary_year(F.col("title"), F.col("url"), F.col("description"), [*range(2020, 2026)])
    return _results(spark, folder).select(F.col("seq").alias("page_id"), year.alias("year"))


@query("report_predicate", f"WITH {_YEARED} SELECT seq AS page_id, coalesce(contains({_TEXT}, year::VARCHAR), false) AND regexp_matches({_TEXT}, '{C.REPORT_WORDS}') AND NOT regexp_matches({_TEXT}, '{C.NON_ANNUAL}') AS is_report FROM yeared")
def report_predicate(spark: SparkSession, folder: str) -> DataFrame:
    args = [F.col(c) for c in ("url", "title", "description")]
    year = C.primary_year(args[1], args[0], args[2], [*range(2020, 2026)])
    return _results(spark, folder).select(F.col("seq").alias("page_id"), F.coalesce(C.looks_like_report(*args, year), F.lit(False)).alias("is_report"))


_MARKDOWN = "markdown AS (SELECT page_id AS doc, regexp_replace(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', '[\\2 ' || (2015 + page_id % 12) || '](http://x.org/\\1) ', 'g') AS text FROM pages)"


@query("html_links_nearest_year", rf"""WITH {_MARKDOWN}, links AS (SELECT doc, unnest(range(len(l))) AS seq, unnest(l) AS link, text FROM (SELECT doc, text, regexp_extract_all(text, '(\[[^\]\n]*\]\(https?://[^)\s]+\))', 1) AS l FROM markdown)),
placed AS (SELECT *, instr(text, link) AS p, regexp_extract(link, '^\[([^\]]*)\]', 1) AS label FROM links)
SELECT doc, seq, label, regexp_extract(link, '\((https?://[^)\s]+)\)$', 1) AS url, coalesce(nullif(regexp_extract(label, '((?:19|20)[0-9]{{2}})', 1), ''), regexp_extract_all(substring(text, greatest(1, p - 180), least(180, p - 1)), '((?:19|20)[0-9]{{2}})', 1)[-1]) AS year FROM placed""")
def html_links_nearest_year(spark: SparkSession, folder: str) -> DataFrame:
    made = F.concat(F.lit("[$2 "), (2015 + F.col("page_id") % 12).cast("string"), F.lit("](http://x.org/$1) "))
    markdown = table(spark, folder, "pages").select(F.col("page_id").alias("doc"), F.regexp_replace(F.col("html"), F.lit('<a href="/([^"]*)">([^<]*)</a>'), made).alias("text"))
    return C.links_of(markdown).select("doc", F.col("seq").cast("bigint").alias("seq"), "label", "url", "year")


# Pages as scraped sites: anchors are labelled links under headings of a year, and every href is a raw link too.
_SCRAPED = r"""scraped AS (SELECT page_id AS doc, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs,
  regexp_replace(regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[\2](http://x.org/\1) ', 'g'), '<(p|h[0-9])>', (2015 + page_id % 12) || CASE WHEN page_id % 2 = 0 THEN '年' ELSE ' ' END, 'g') AS markdown FROM pages)"""


@query("scraped_links", rf"""WITH {_SCRAPED}, parts AS (SELECT doc, hrefs, regexp_extract_all(markdown, '\[[^\]]+\]\(https?://[^)\s]+') AS l, string_split_regex(markdown, '\[[^\]]+\]\(https?://[^)\s]+') AS t FROM scraped),
each AS (SELECT doc, k, l[k + 1] AS link, right(array_to_string(list_transform(range(0, k + 1), lambda j: t[j + 1] || CASE WHEN j < k THEN l[j + 1] ELSE '' END), ''), 180) AS before FROM (SELECT doc, l, t, unnest(range(len(l))) AS k FROM parts)),
told AS (SELECT doc, k, regexp_extract(link, '\((https?://.*)$', 1) AS url, trim(regexp_extract(link, '^\[([^\]]+)\]', 1)) AS label, regexp_extract_all(before, '(20[0-9]{{2}})(年|[^\p{{L}}\p{{N}}_]|$)', 1)[-1] AS year FROM each),
every AS (SELECT doc, 0 AS kind, k, url, CASE WHEN year IS NOT NULL AND NOT contains(label, year) THEN trim(year || ' ' || label) ELSE label END AS title FROM told
  UNION ALL SELECT doc, 1, k, 'http://x.org' || hrefs[k + 1], CASE WHEN k % 2 = 0 THEN 'raw ' || k ELSE '' END FROM (SELECT doc, hrefs, unnest(range(len(hrefs))) AS k FROM parts)),
first AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc, url ORDER BY kind, k) = 1)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY kind, k) - 1 AS seq, url, title FROM first""")
def scraped_links(spark: SparkSession, folder: str) -> DataFrame:
    html, k = F.col("html"), F.col("page_id")
    made = F.regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', r"[$2](http://x.org/$1) ")
    heading = F.concat((2015 + k % 12).cast("string"), F.when(k % 2 == 0, "年").otherwise(" "))
    raw = F.transform(F.regexp_extract_all(html, F.lit('href="(/[^"]*)"'), 1), lambda h, i: F.struct(F.concat(F.lit("http://x.org"), h).alias("url"), F.when(i % 2 == 0, F.concat(F.lit("raw "), i.cast("string"))).alias("text")))
    pages = table(spark, folder, "pages").select(k.alias("doc"), F.regexp_replace(made, F.lit("<(p|h[0-9])>"), heading).alias("markdown"), raw.alias("links"))
    return C.scraped_links(pages).select("doc", F.col("seq").cast("bigint").alias("seq"), "url", "title")


@query("all_markers", r"SELECT d.doc_id, b.text AS marker FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g'))")
def all_markers(spark: SparkSession, folder: str) -> DataFrame:
    return V.markers_in(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select(F.col("text").alias("marker")), id_col="doc_id")


_SOURCES = r"""sources AS (SELECT doc_id, text AS text_a, CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END AS text_b, md5(text) AS sha256, n_chars AS pages,
  CASE WHEN doc_id % 7 <> 3 THEN md5(text) END AS registered_sha256, n_chars + CASE WHEN doc_id % 11 = 2 THEN 1 ELSE 0 END AS registered_pages FROM documents),
markers AS (SELECT doc_id, substring(text, 20, 15) AS marker FROM documents WHERE doc_id % 3 > 0 AND length(text) > 40 UNION SELECT doc_id, b.text FROM documents, benchmark b WHERE doc_id % 40 = b.item_id)"""


@query("verified_sources", rf"""WITH {_SOURCES}, told AS (SELECT doc_id, count(*) AS markers, count(*) FILTER (contains(regexp_replace(text_a, '\s+', '', 'g'), regexp_replace(marker, '\s+', '', 'g'))) AS in_a,
  count(*) FILTER (contains(regexp_replace(text_b, '\s+', '', 'g'), regexp_replace(marker, '\s+', '', 'g'))) AS in_b FROM markers JOIN sources USING (doc_id) GROUP BY doc_id),
gates AS (SELECT doc_id, coalesce(sha256 = registered_sha256, false) AS digest_ok, pages = registered_pages AS pages_ok, coalesce(markers, 0) AS markers, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM sources LEFT JOIN told USING (doc_id))
SELECT *, digest_ok AND pages_ok AND in_a = markers AND in_b = markers AS verified, CASE WHEN NOT digest_ok THEN 'digest' WHEN NOT pages_ok THEN 'pages' WHEN in_a < markers THEN 'first text' WHEN in_b < markers THEN 'second text' END AS reason FROM gates""")
def verified_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs, k, text = table(spark, folder, "documents"), F.col("doc_id"), F.col("text")
    digest = F.md5(text.cast("binary"))
    sources = docs.select("doc_id", text.alias("text_a"), F.when(k % 5 == 0, F.upper(text)).otherwise(text).alias("text_b"), digest.alias("sha256"), F.col("n_chars").alias("pages"),
        F.when(k % 7 != 3, digest).alias("registered_sha256"), (F.col("n_chars") + F.when(k % 11 == 2, 1).otherwise(0)).alias("registered_pages"))
    own = docs.where((k % 3 > 0) & (F.length(text) > 40)).select("doc_id", F.substring(text, 20, 15).alias("marker"))
    items = docs.select("doc_id", (k % 40).alias("item_id")).join(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("marker")), "item_id")
    return V.verify_sources(sources, own.unionByName(items.select("doc_id", "marker")), id_col="doc_id")


@query("deletion_outcomes", """WITH runs AS (SELECT o_orderkey::VARCHAR AS run_id, CASE o_custkey % 3 WHEN 0 THEN 'workspace-a' WHEN 1 THEN '' ELSE 'workspace-b' END AS workspace_id FROM orders),
wanted AS (SELECT DISTINCT (l_orderkey + l_linenumber % 2)::VARCHAR AS run_id FROM lineitem), running AS (SELECT DISTINCT o_orderkey::VARCHAR AS run_id FROM orders WHERE o_orderstatus = 'P')
SELECT w.run_id, CASE WHEN r.run_id IS NULL THEN 'missing' WHEN coalesce(nullif(workspace_id, ''), 'legacy-public') <> 'workspace-a' THEN 'foreign' WHEN b.run_id IS NOT NULL THEN 'running' ELSE 'deleted' END AS outcome
FROM wanted w LEFT JOIN runs r USING (run_id) LEFT JOIN running b USING (run_id)""")
def deletion_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    run = F.col("o_orderkey").cast("string").alias("run_id")
    space = F.element_at(F.array(*map(F.lit, ("workspace-a", "", "workspace-b"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    wanted = lines.select((F.col("l_orderkey") + F.col("l_linenumber") % 2).cast("string").alias("run_id"))
    return V.deletions(wanted, orders.select(run, space.alias("workspace_id")), "workspace-a", orders.where("o_orderstatus = 'P'").select(run))


def _manifest(spark: SparkSession, folder: str, live: bool) -> DataFrame:
    docs = table(spark, folder, "documents")
    own = docs.where(F.col("doc_id") % 2 == 0) if live else docs.where(F.col("doc_id") % 3 == 0)
    named = own.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("sha"), F.col("source").alias("slug"), F.when(F.lit(live), F.col("doc_id") % 40).otherwise(F.col("doc_id") % 60).alias("fy"), F.when((F.col("doc_id") % 4 == 0) & F.lit(live), F.lit("human_verified")).alias("verification")
    )
    return C.first_seen(C.first_seen(named, ["sha"], "doc_id"), ["slug", "fy"], "doc_id")


def _manifest_sql(name: str, divisor: int, years: int, verification: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT * FROM (SELECT doc_id, md5(text) AS sha, source AS slug, doc_id % {years} AS fy, {verification} AS verification FROM documents WHERE doc_id % {divisor} = 0)
  QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY slug, fy ORDER BY doc_id) = 1)"""


_BOTH = _manifest_sql("live", 2, 40, "CASE WHEN doc_id % 4 = 0 THEN 'human_verified' END") + ", " + _manifest_sql("incoming", 3, 60, "CAST(NULL AS VARCHAR)")


@query("manifest_upsert", f"""WITH {_BOTH} SELECT * FROM live WHERE sha NOT IN (SELECT sha FROM incoming) AND (slug, fy) NOT IN (SELECT (slug, fy) FROM incoming)
UNION ALL SELECT doc_id, sha, slug, fy, (SELECT max(verification) FROM live WHERE live.sha = incoming.sha) AS verification FROM incoming""")
def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return C.upsert(_manifest(spark, folder, True), _manifest(spark, folder, False), "sha", ["slug", "fy"], "verification")


@query("priority_merge", f"WITH {_BOTH}, both_sides AS (SELECT *, 0 AS p FROM live UNION ALL SELECT *, 1 AS p FROM incoming) SELECT doc_id, sha, slug, fy, verification FROM both_sides QUALIFY row_number() OVER (PARTITION BY lower(slug), fy ORDER BY p) = 1")
def priority_merge(spark: SparkSession, folder: str) -> DataFrame:
    return C.priority_merge(_manifest(spark, folder, True), _manifest(spark, folder, False), [F.lower("slug"), F.col("fy")])


@query("delete_by_key", f"WITH {_BOTH} SELECT * FROM live WHERE sha NOT IN (SELECT sha FROM incoming)")
def delete_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder, True).join(_manifest(spark, folder, False).select("sha"), "sha", "left_anti").select("doc_id", "sha", "slug", "fy", "verification")


@query("availability_status", """WITH years AS (SELECT unnest(range(1995, 2002)) AS year), requested AS (SELECT n_name AS company, year FROM nation, years),
orders_of AS (SELECT n_name AS company, year(o_orderdate) AS year, o_orderstatus AS s, o_orderpriority AS p FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
got AS (SELECT DISTINCT company, year FROM orders_of WHERE s = 'F' AND p = '1-URGENT' AND (year % 2 = 0)),
failed AS (SELECT company, year, string_agg(p, ' | ' ORDER BY p) AS reason FROM (SELECT DISTINCT company, year, p FROM orders_of WHERE s = 'P' AND year % 3 = 0) GROUP BY company, year),
searched AS (SELECT n_name AS company, n_nationkey % 3 AS candidates FROM nation WHERE n_nationkey % 4 <> 0)
SELECT company, year, CASE WHEN got.company IS NOT NULL THEN 'downloaded' WHEN reason IS NOT NULL THEN 'not_downloaded' WHEN candidates > 0 THEN 'candidate_found' WHEN candidates = 0 THEN 'not_found' ELSE 'pending' END AS status,
  coalesce(candidates, 0) AS candidates, CASE WHEN got.company IS NULL THEN reason END AS reason FROM requested LEFT JOIN got USING (company, year) LEFT JOIN failed USING (company, year) LEFT JOIN searched USING (company)""")
def availability_status(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    orders = orders.select(F.col("n_name").alias("company"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderpriority")
    requested = nation.select(F.col("n_name").alias("company"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    got = orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND year % 2 = 0")
    failed = orders.where("o_orderstatus = 'P' AND year % 3 = 0").withColumn("reason", F.col("o_orderpriority"))
    searched = nation.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("company"), (F.col("n_nationkey") % 3).alias("candidates"))
    return C.availability(requested, got, failed, searched)


@query("targets_union_anti_limit", "SELECT key, origin FROM (SELECT DISTINCT 'NATION_' || s_nationkey AS key, 'stored' AS origin FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT n_name, 'seed' FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0)) ORDER BY origin DESC, key LIMIT 20")
def targets_union_anti_limit(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "supplier").where("s_nationkey % 2 = 0").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("key")).distinct()
    return C.targets(stored, table(spark, folder, "nation").select(F.col("n_name").alias("key")), 20)


_DOCS = """docs AS (SELECT d.doc_id AS doc, source AS company, n_chars AS pages, 2019 + doc_id % 6 AS year, CASE WHEN doc_id % 50 = 7 THEN 'unreadable' WHEN n_chars < 500 THEN 'review' ELSE 'ok' END AS screened,
  CASE l.quality WHEN 1 THEN 'human_verified' WHEN 0 THEN 'candidate' END AS verification FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("doc"),
        F.col("source").alias("company"),
        F.col("n_chars").alias("pages"),
        (2019 + F.col("doc_id") % 6).alias("year"),
        F.when(F.col("doc_id") % 50 == 7, "unreadable").when(F.col("n_chars") < 500, "review").otherwise("ok").alias("screened"),
        F.when(F.col("quality") == 1, "human_verified").when(F.col("quality") == 0, "candidate").alias("verification"),
    )


@query("corpus_summary_counts", f"WITH {_DOCS} SELECT count(*) AS documents, count(DISTINCT company) AS companies, count(*) FILTER (screened = 'ok') AS screened_ok, count(*) FILTER (screened = 'review') AS screened_review, count(*) FILTER (screened = 'unreadable') AS screened_unreadable, count(*) FILTER (verification = 'human_verified') AS verified, count(*) FILTER (verification = 'candidate') AS candidates FROM docs")
def corpus_summary_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus_counts(_docs(spark, folder))


@query("corpus_group_states", f"""WITH {_DOCS}, all_companies AS (SELECT * FROM docs WHERE company <> 'src7' UNION ALL SELECT NULL, 'src7', NULL, NULL, NULL, NULL),
told AS (SELECT company, count(doc) AS documents, coalesce(sum(pages), 0) AS pages, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (doc IS NOT NULL AND verification = 'human_verified') AS verified, bool_or(screened = 'unreadable') AS bad FROM all_companies GROUP BY company)
SELECT * EXCLUDE (bad), CASE WHEN documents = 0 THEN 'pending' WHEN bad THEN 'unreadable' WHEN verified = documents THEN 'verified' ELSE 'review' END AS state FROM told""")
def corpus_group_states(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    none = spark.createDataFrame([(None, "src7", None, None, None, None)], "doc long, company string, pages long, year long, screened string, verification string")
    return C.company_states(docs.where("company <> 'src7'").unionByName(none))


@query("status_histogram", f"WITH {_DOCS} SELECT screened, count(*) AS documents, count(DISTINCT company) AS companies FROM docs GROUP BY screened")
def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).groupBy("screened").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("company").alias("companies"))


@query("source_marker_verify", r"""WITH packed AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS packed FROM documents), markers AS (SELECT d.doc_id, b.text AS marker FROM documents d, benchmark b WHERE d.doc_id % 40 = b.item_id),
told AS (SELECT doc_id, contains(packed, regexp_replace(marker, '\s+', '', 'g')) AS hit FROM markers JOIN packed USING (doc_id)) SELECT doc_id, count(*) AS markers, count(*) FILTER (hit) AS found, bool_and(hit) AS verified FROM told GROUP BY doc_id""")
def source_marker_verify(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    markers = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("marker")), "item_id")
    return C.contains_markers(docs, markers.select("doc_id", "marker"), ["doc_id"])


@query("identity_keys", rf"""WITH given AS (SELECT p_partkey, p_name || '_annual_report_' || (2018 + p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN '_final' ELSE '' END || '.pdf' AS name, CASE WHEN p_partkey % 5 = 0 THEN 'FY' || (2010 + p_partkey % 9) ELSE '' END AS fy FROM part),
cut AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem FROM given),
keyed AS (SELECT p_partkey, coalesce(nullif(regexp_extract(fy, '((?:19|20)[0-9]{{2}})', 1), ''), nullif(regexp_extract(stem, '((?:19|20)[0-9]{{2}})', 1), ''), 'unknown') AS year,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)annual[_\s-]*report|form[_\s-]*10[_\s-]*k', '_', 'g'), '(19|20)[0-9]{{2}}', '_', 'g'), '(?i)updated|final|online|pdfa|web', '_', 'g'), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_') AS x, name, fy FROM cut)
SELECT p_partkey, CASE WHEN x = '' THEN 'Unknown_Company' ELSE x END AS company, year, CASE WHEN x = '' THEN 'Unknown_Company' ELSE x END || '_annual_report_' || year || '.pdf' AS filename, regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]', '', 'g') AS company_key,
  CASE WHEN regexp_extract(fy, '((?:19|20)[0-9]{{2}})', 1) <> '' THEN 'FY' || regexp_extract(fy, '((?:19|20)[0-9]{{2}})', 1) ELSE 'FY-unknown' END AS folder,
  CASE WHEN regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') END || '::' || year || '::' || lower(name) AS cohort FROM keyed""")
def identity_keys(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.lit("_annual_report_"), (2018 + k % 7).cast("string"), F.when(k % 3 == 0, "_final").otherwise(""), F.lit(".pdf"))
    fy = F.when(k % 5 == 0, F.concat(F.lit("FY"), (2010 + k % 9).cast("string"))).otherwise("")
    given = table(spark, folder, "part").select("p_partkey", name.alias("name"), fy.alias("fy")).withColumn("r", T.report_identity(F.col("name"), F.col("fy")))
    return given.select(
        "p_partkey", "r.company", "r.year", "r.filename", T.company_key(F.col("name")).alias("company_key"), T.fiscal_year_folder(F.col("fy")).alias("folder"), T.cohort_key(F.col("r.company"), F.col("r.year"), F.lit(None).cast("string"), F.col("name")).alias("cohort")
    )


@query("storage_paths", "SELECT doc_id, source || '/FY' || (2019 + doc_id % 6) || '/' || md5(text) || '.pdf' AS path, 'legacy/' || doc_id || '.pdf' AS old_path FROM documents WHERE doc_id % 2 = 1")
def storage_paths(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fy = T.fiscal_year_folder((2019 + F.col("doc_id") % 6).cast("string"))
    path = F.concat_ws("/", "source", fy, F.concat(F.md5(F.col("text").cast("binary")), F.lit(".pdf")))
    old = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("legacy/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(path)
    return docs.select("doc_id", path.alias("path"), old.alias("old_path")).where("path <> old_path")


_UNITS = (" (In Thousands)", " millions of yen", " 単位：円", "")


@query("value_quantum", f"""WITH said AS (SELECT doc_id, lower(substring(text || {[*_UNITS]}[1 + doc_id % 4], 1, 200000)) AS head FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(head, '単位\\s*[：:]\\s*千円|in thousands|thousands of') THEN 0.001::DOUBLE WHEN regexp_matches(head, '単位\\s*[：:]\\s*百万円|in millions|millions of') THEN 1.0::DOUBLE WHEN regexp_matches(head, '単位\\s*[：:]\\s*円') THEN 0.000001::DOUBLE ELSE 0.0::DOUBLE END AS quantum FROM said""")
def value_quantum(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", T.value_quantum(F.concat("text", unit)).alias("quantum"))


@query("compressed_page_lists", "WITH island AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, day(ts) AS d FROM events)), runs AS (SELECT user_id, min(d) AS a, max(d) AS b FROM island GROUP BY user_id, g) SELECT user_id, string_agg(CASE WHEN b > a THEN a || '-' || b ELSE a::VARCHAR END, ', ' ORDER BY a) AS pages FROM runs GROUP BY user_id")
def compressed_page_lists(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "events").groupBy("user_id").agg(F.collect_set(F.dayofmonth("ts")).alias("days"))
    return days.select("user_id", T.compressed_ranges(F.col("days")).alias("pages"))
