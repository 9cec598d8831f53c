"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of text health.
GARBLE_LIMIT = MIXED_LIMIT = 0.15
MIXED_MIN_TOKENS, MIXED_MIN_LENGTH = 25, 3

# Characters folded one to one, ligatures, and invisible ones.
FOLDED_FROM, FOLDED_TO = "\u00a0\u2007\u202f\u2009\u2212\u2013\u2014\u2018\u2019\u201c\u201d", "    ---''\"\""
LIGATURES = (("\ufb01", "fi"), ("\ufb02", "fl"))
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"
#: What ends a line besides \n.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def normalize_text(text: Column) -> Column:
    """Folds spaces, dashes, quotes and ligatures, deletes invisible characters,
    strips line ends, and shortens runs of four or more line feeds to three."""
    x = F.translate(F.coalesce(text, F.lit("")), FOLDED_FROM + INVISIBLE, FOLDED_TO)
    for a, b in LIGATURES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, LINE_ENDS, "\n")
    x = F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|$)", "")
    x = F.regexp_replace(x, r"\n\z", "")
    return F.regexp_replace(x, r"\n{4,}", "\n\n\n")


def garble_ratio(text: Column) -> Column:
    """Share of characters that are control, private, unassigned or U+FFFD; 0 for no text."""
    good = F.regexp_replace(text, r"[\p{Cc}\p{Co}\p{Cn}\x{FFFD}&&[^\n\t]]", "")
    n = F.length(text)
    return F.when(n > 0, (n - F.length(good)) / n).otherwise(F.lit(0.0))


def mixed_token_ratio(text: Column) -> Column:
    """Share of tokens with both letters and digits; 0 under 25 tokens of three characters."""
    plain = F.regexp_replace(text, r"<br\s*/?>", " ")
    tokens = F.filter(F.split(plain, r"(?U)[\s|*#`_~\[\]()]+"), lambda t: F.length(t) >= MIXED_MIN_LENGTH)
    mixed = F.size(F.filter(tokens, lambda t: t.rlike("[A-Za-z]") & t.rlike(r"\p{Nd}")))
    return F.when(F.size(tokens) >= MIXED_MIN_TOKENS, mixed / F.size(tokens)).otherwise(F.lit(0.0))


def unreadable(text: Column) -> Column:
    return (garble_ratio(text) >= GARBLE_LIMIT) | (mixed_token_ratio(text) >= MIXED_LIMIT)


@cache
def _compatibility() -> tuple[str, str]:
    """Characters whose NFKC form is one other character, and these forms."""
    pairs = [(c, f) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(f := unicodedata.normalize("NFKC", c)) == 1 and f != c]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


def compatible(text: Column) -> Column:
    """NFKC of the characters that it maps to one other: full-width, raised and styled
    forms. The UDF ``nfkc`` also does those that it spells out or joins."""
    return F.translate(text, *_compatibility())


def fold_name(name: Column) -> Column:
    """Lower-cased name in compatible characters with ``&`` spelled out and other marks blanked."""
    spelled = F.replace(F.lower(compatible(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def company_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


def year_in(text: Column) -> Column:
    """First 19xx or 20xx, or an empty string."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), "((?:19|20)[0-9]{2})", 1)


def fiscal_year_folder(text: Column) -> Column:
    return F.when(year_in(text) != "", F.concat(F.lit("FY"), year_in(text))).otherwise("FY-unknown")


def report_identity(name: Column, fiscal_year: Column) -> Column:
    """(company, year, filename) of a report's name."""
    base = F.regexp_extract(F.coalesce(name, F.lit("annual_report.pdf")), "([^/]*)/*$", 1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), "^[0-9]{8}T[0-9]{6}Z_[0-9]{3}_", "")
    year = F.coalesce(F.nullif(year_in(fiscal_year), F.lit("")), F.nullif(year_in(stem), F.lit("")), F.lit("unknown"))
    x = F.regexp_replace(stem, r"(?i)annual[_\s-]*report|form[_\s-]*10[_\s-]*k", "_")
    x = F.regexp_replace(x, "(19|20)[0-9]{2}", "_")
    x = F.regexp_replace(x, "(?i)updated|final|online|pdfa|web", "_")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", "_"), F.lit("_"))
    company = F.when(x == "", "Unknown_Company").otherwise(x)
    return F.struct(company.alias("company"), year.alias("year"), F.concat(company, F.lit("_annual_report_"), year, F.lit(".pdf")).alias("filename"))


def run_stamp(run_id: Column) -> Column:
    """The UTC time in a run id, or null."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(run_id, "([0-9]{8}T[0-9]{6})Z", 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))


def safe_filename(name: Column) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), "([^/]*)/*$", 1), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.when(x == "", "annual_report.pdf").otherwise(x)


def cohort_key(company: Column, fiscal_year: Column, sha: Column, file: Column) -> Column:
    """company::year::(digest or file name); empty without a file."""
    base = F.lower(F.trim(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/\\]*)$", 1)))
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(company, F.lit("")))), "[^a-z0-9]+", "")
    digest = F.lower(F.trim(F.coalesce(sha, F.lit(""))))
    joined = F.concat_ws("::", F.when(plain == "", "unknown").otherwise(plain), year_in(fiscal_year), F.when(digest == "", base).otherwise(digest))
    return F.when(base == "", "").otherwise(joined)


def value_quantum(text: Column) -> Column:
    """Displayed precision of a report in millions: thousands, millions, yen, else 0."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200_000))
    return (
        F.when(head.rlike(r"単位\s*[：:]\s*千円|in thousands|thousands of"), 0.001)
        .when(head.rlike(r"単位\s*[：:]\s*百万円|in millions|millions of"), 1.0)
        .when(head.rlike(r"単位\s*[：:]\s*円"), 0.000001)
        .otherwise(0.0)
    )


def mask_secret(key: Column) -> Column:
    shown = F.concat(F.substring(key, 1, 4), F.lit("…"), F.expr(f"right({_name(key)}, 4)"))
    return F.when(F.length(key) <= 8, F.repeat(F.lit("•"), 8)).otherwise(shown)


def _name(column: Column) -> str:
    return str(column).split("'")[1]


def approx_tokens(chars: Column) -> Column:
    """At least one token, else four characters each."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / 4))


def compressed_ranges(numbers: Column) -> Column:
    """[6,7,8,10,11] -> "6-8, 10-11", by a fold over the sorted distinct numbers."""
    ordered = F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.cast("bigint"))))
    start = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def step(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        one = F.array(F.struct(x.alias("a"), x.alias("b")))
        longer = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), x.alias("b"))))
        return F.when((F.size(runs) > 0) & (last["b"] == x - 1), longer).otherwise(F.concat(runs, one))

    runs = F.aggregate(ordered, start, step)
    return F.array_join(F.transform(runs, lambda r: F.when(r["b"] > r["a"], F.concat_ws("-", r["a"], r["b"])).otherwise(r["a"].cast("string"))), ", ")
