"""URL filtering: host rules, then pattern rules fetched by their rarest token.

Built-in column functions only. A pattern rule names tokens (runs of a-z and
0-9) that every URL it matches must hold; it is indexed by the one that fewest
URLs hold. The distinct tokens of each distinct URL fetch candidate rules with
an equi-join, and only candidates run their regular expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` (for the lower-cased URL) only matches URLs that hold all ``tokens``; one without tokens runs on every distinct URL."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


# The host rules of the query's contract.
HOST_RULES = (
    HostRule("block", "net"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

# Pattern rules of unwanted sites and pages.
PATTERN_RULES = (
    *(PatternRule(f"host-{w}", rf"^[a-z0-9+.-]+://([^/?#]*[.-])?{w}[.-]", (w,)) for w in ("adult", "porn", "xxx", "casino", "poker", "viagra", "warez", "torrent", "doubleclick", "adserver")),
    *(PatternRule(f"page-{w}", rf"^[a-z0-9+.-]+://[^/?#]*/([^?#]*/)?{w}([/.?#]|$)", (w,)) for w in ("login", "signin", "signup", "register", "cart", "checkout", "unsubscribe")),
    PatternRule("wp-admin", r"^[a-z0-9+.-]+://[^/?#]*/([^?#]*/)?wp-admin([/.?#]|$)", ("wp", "admin")),
    PatternRule("cgi-bin", r"^[a-z0-9+.-]+://[^/?#]*/([^?#]*/)?cgi-bin/", ("cgi", "bin")),
)

#: Most rules that a join may broadcast.
SMALL_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(rule: HostRule) -> Column:
    return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def pattern_hits(urls: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """(_url, pattern_rule): for each distinct URL that a rule matches, the first such rule."""
    spark = urls.sparkSession
    rows = [(k, r.name, r.pattern, t) for k, r in enumerate(rules) for t in r.tokens]
    listed = spark.createDataFrame(rows, "k int, name string, pattern string, token string")
    small = (lambda df: F.broadcast(df)) if len(rows) <= SMALL_RULES else (lambda df: df)
    tokens = urls.select("_url", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_url"), F.lit("[a-z0-9]+"), 0))).alias("token"))
    held = tokens.join(small(listed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    rated = listed.join(held, "token", "left")
    rarest = rated.groupBy("k", "name", "pattern").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))["token"].alias("token"))
    found = tokens.join(small(rarest), "token").where(F.expr("lower(_url) rlike pattern"))
    found = found.select("_url", "k", "name")
    bare = [(k, r) for k, r in enumerate(rules) if not r.tokens]
    if bare:
        hits = F.array(*[F.when(F.lower("_url").rlike(r.pattern), F.struct(F.lit(k).alias("k"), F.lit(r.name).alias("name"))) for k, r in bare])
        found = found.unionByName(urls.select("_url", F.explode(F.array_compact(hits)).alias("h")).select("_url", "h.k", "h.name"))
    return found.groupBy("_url").agg(F.min(F.struct("k", "name"))["name"].alias("pattern_rule"))


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """Host, path, the longest fitting host rule and the verdict of each URL.

    Returns one row per input row: the id, host, path, rule (like ``net/``, else
    null), verdict (the rule's; without one, block if a pattern rule matches,
    else allow) and pattern_rule. Of host rules of one length, the first in
    ``host_rules`` wins.

    A null URL, or one without ``://``, has an empty host and path, no rule and
    the verdict allow unless a pattern matches. Null ids and repeated rows stay
    as they are; an empty table gives an empty result. Other columns are not
    read, so their names cannot clash. Rules are given by parameter, so their
    number is known.
    """
    given = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    cut = given.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(host_rules), key=lambda r: len(r.text)):
        rule = F.when(_fits(r), r.text).otherwise(rule)
        verdict = F.when(_fits(r), r.verdict).otherwise(verdict)
    ruled = cut.withColumn("rule", rule).withColumn("_verdict", verdict)
    hits = pattern_hits(given.select("_url").where("_url IS NOT NULL").distinct(), pattern_rules)
    out = ruled.join(hits, "_url", "left")
    method = F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "pattern_rule")


def _sql_case(column: str) -> str:
    ordered = sorted(HOST_RULES, key=lambda r: -len(r.text))
    value = {"rule": lambda r: r.text, "verdict": lambda r: r.verdict}[column]
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered) + " END"


SQL = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path, {_sql_case("rule")} AS rule, {_sql_case("verdict")} AS ruled,
    CASE {" ".join(f"WHEN regexp_matches(lower(url), '{r.pattern}') THEN '{r.name}'" for r in PATTERN_RULES)} END AS pattern_rule
  FROM parts
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN pattern_rule IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern_rule FROM judged
"""
