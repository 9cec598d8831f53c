"""Pattern rules without tokens run on every URL."""

from sparkfolio.llm.url_filters import PATTERN_RULES, PatternRule, filter_urls


def test_rules_without_tokens(spark):
    urls = [(1, "http://a.example/12345"), (2, "http://a.example/x"), (3, None), (4, "http://casino.example/12345"), (5, "HTTP://A.example/99999")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    digits = PatternRule("digits", "/[0-9]{5}$", ())
    got = {r.page_id: (r.verdict, r.pattern_rule) for r in filter_urls(pages, host_rules=(), pattern_rules=(*PATTERN_RULES, digits)).collect()}
    assert got == {1: ("block", "digits"), 2: ("allow", None), 3: ("allow", None), 4: ("block", "host-casino"), 5: ("block", "digits")}
    alone = filter_urls(pages, host_rules=(), pattern_rules=(digits,)).where("verdict = 'block'")
    assert {r.page_id for r in alone.collect()} == {1, 4, 5}
