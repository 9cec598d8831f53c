"""Line-first quality rules in built-in column functions only.

Lines are judged one by one; a document is rejected when its good lines, each
counted once, hold too little of its text. Everything is an expression over one
row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of page furniture, the marks that end a sentence, the
# marks that part the items of a navigation line, and symbols of junk text.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "skip to content",
    "sign up for our newsletter",
    "click here to",
    "lorem ipsum",
)
ENDS = "[.!?…。！？]"
PARTS = "[|•·»›]"
SYMBOLS = "#*$%&|<>"

#: Failing lines of a text among which each line is looked up; beyond that it is judged again.
LOOKED_UP = 64
#: Characters between words.
_SEPARATORS = " \\t\\n\\u000B\\u000C\\r"
_WORD_GAP = r"[ \\t\\n\\u000B\\f\\r]+"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _trimmed(x: str) -> str:
    return f"trim(BOTH '{_SEPARATORS}' FROM {x})"


_words = _let(_trimmed("_text"), "t", f"if(t = '', cast(array() as array<string>), split(t, '{_WORD_GAP}'))")

#: Of words ``ws``, those in three-word windows that occur again: windows are
#: sorted by hash, the places of equal neighbours put in order, and their union measured.
_repeated = _let(
    "transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2]))",
    "h",
    "if(size(array_distinct(h)) = size(h), 0L, "
    + _let(
        "sort_array(transform(h, (x, i) -> struct(x, i)))",
        "s",
        "aggregate(sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k + 1 < size(s) AND s[k + 1].x = e.x)), e -> e.i)), "
        "struct(0L AS n, -3 AS last), (acc, i) -> struct(acc.n + least(3, i - acc.last) AS n, i AS last), acc -> acc.n)",
    )
    + ")",
)


_SHOUTS = ("!!", "??", "!?", "?!")
#: What a text holds at all, so that its lines are not looked at for what it does not hold.
_flags = (
    f"struct(cast(regexp_count(_text, '[{SYMBOLS}]') as bigint) AS symbols, "
    + " OR ".join(f"contains(_text, '{x}')" for x in _SHOUTS)
    + f" AS shouts, _text rlike '{PARTS}' AS parts, "
    + _let("lower(_text)", "low", " OR ".join(f"contains(low, '{x}')" for x in BOILERPLATE))
    + " AS boiler)"
)


def _line_passes(max_symbols: float, max_shouts: float, max_parts: float, boiler_words: int) -> str:
    """Whether ``line`` of a text with ``flags`` passes."""
    phrases = "|".join(BOILERPLATE)
    return _let(
        _trimmed("line"),
        "t",
        _let(
            f"size(split(t, '{_WORD_GAP}'))",
            "n",
            f"(n < 3 OR t rlike '{ENDS}')"
            f" AND (flags.symbols = 0 OR regexp_count(t, '[{SYMBOLS}]') <= {max_symbols} * n)"
            f" AND (NOT flags.shouts OR regexp_count(t, '[!?]{{2,}}') <= {max_shouts} * n)"
            f" AND (NOT flags.parts OR regexp_count(t, '{PARTS}') <= greatest(2, {max_parts} * n))"
            f" AND NOT (flags.boiler AND n <= {boiler_words} AND lower(t) rlike '{phrases}')",
        ),
    )


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_loss: float = 0.5,
    max_symbols: float = 0.3,
    max_shouts: float = 0.2,
    max_parts: float = 0.1,
    boiler_words: int = 30,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts and verdict of each whole text.

    A line with words passes if it has a sentence mark (or under three words),
    at most ``max_symbols`` symbols, ``max_shouts`` runs of two or more ! and ? and
    ``max_parts`` navigation separators a word (two always pass), and, in a line
    of up to ``boiler_words`` words, no boilerplate phrase. A line equal to an
    earlier one does not count again. The document is kept unless base_failed
    (under 50 words, or over half of them in repeated three-word windows) or more
    than ``max_loss`` of its lines' characters is lost.

    Returns one row per input row: the id, the columns named in ``carry``,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, line_chars, passed_chars and clean_text: the text without its failing
    lines (a line that passes stays each time, and blank lines stay).

    Null and empty texts have no words, fail the base rules and have an empty
    clean_text. Null ids and repeated rows stay as they are; an empty table
    gives an empty result. Other columns are not read, so their names cannot
    clash; ``carry`` may not name a result column. Memory per task grows with the
    longest single text.
    """
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    given = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    passes = _line_passes(max_symbols, max_shouts, max_parts, boiler_words)
    blank = f"{_trimmed('line')} = ''"
    total = "aggregate({}, 0L, (n, line) -> n + length(line))"
    # One expression with bound names, so that nothing shared is spelled out in
    # lambdas; the id, always at least 0, keeps the optimizer from pushing a filter
    # on the verdict below it, which would compute everything once per column.
    counted = (
        "struct(cast(size(ws) as bigint) AS n_words, "
        "cast(length(array_join(ws, '')) as bigint) AS word_chars, "
        "flags.symbols AS n_symbols, "
        "cast(size(lines) - size(once) as bigint) AS n_dup_lines, "
        f"{_repeated} AS n_repeat_words, "
        f"{total.format('lines')} AS line_chars, "
        f"{total.format('once')} - {total.format('bad')} AS passed_chars, "
        "if(size(bad) = 0, _text, array_join(filter(split(_text, '\\n'), "
        f"line -> if(size(bad) <= {LOOKED_UP}, NOT array_contains(bad, line), {blank} OR {passes})), '\\n')) AS clean_text)"
    )
    lines = f"filter(split(_text, '\\n'), line -> NOT {blank})"
    bad = f"filter(once, line -> NOT ({passes}))"
    judged = _let(_flags, "flags", _let(_words, "ws", _let(lines, "lines", _let("array_distinct(lines)", "once", _let(bad, "bad", counted)))))
    told = given.selectExpr(*names, f"if(monotonically_increasing_id() >= 0, {judged}, NULL) AS _j").select(*names, "_j.*")
    base = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    kept = f"NOT {base} AND line_chars - passed_chars <= {max_loss} * line_chars"
    out = told.selectExpr(*names, *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), f"{base} AS base_failed", f"{kept} AS kept", "line_chars", "passed_chars", "clean_text")
    return out.withColumnsRenamed(dict(zip(names, [id_col, *carry])))


#: DuckDB SQL of the query's columns, by sets of words and lines.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS ws FROM docs),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, line, trim(line, E' \t\n\x0b\f\r') AS t FROM (SELECT r, unnest(string_split(text, E'\n')) AS line FROM docs)),
judged AS (
  SELECT r, line, count(*) AS copies, len(regexp_split_to_array(any_value(t), '[ \t\n\x0b\f\r]+')) AS n, any_value(t) AS t
  FROM lines WHERE t <> '' GROUP BY r, line
),
verdicts AS (
  SELECT r, copies, length(line) AS chars,
    (n < 3 OR regexp_matches(t, '{ENDS}'))
    AND length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) <= 0.3 * n
    AND len(regexp_extract_all(t, '[!?][!?]+')) <= 0.2 * n
    AND len(regexp_extract_all(t, '{PARTS}')) <= greatest(2, 0.1 * n)
    AND NOT (n <= 30 AND regexp_matches(lower(t), '{"|".join(BOILERPLATE)}')) AS ok
  FROM judged
),
totals AS (SELECT r, sum(copies - 1) AS dups, sum(copies * chars) AS line_chars, coalesce(sum(chars) FILTER (ok), 0) AS passed FROM verdicts GROUP BY r),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(passed, 0)::BIGINT AS passed_chars
  FROM docs JOIN words USING (r) LEFT JOIN repeats USING (r) LEFT JOIN totals USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_chars - passed_chars <= 0.5 * line_chars AS kept,
  line_chars, passed_chars
FROM counted
"""
