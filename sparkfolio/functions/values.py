"""Repair of model-written values: money, confidences, pages, years, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compatible

# Words that stand for an absent number.
NULL_TOKENS = ("", "-", "--", "—", "–", "n/a", "na", "n.a.", "none", "null", "nil", "not found", "not disclosed", "not applicable", "not presented")
#: What may be cast to a number: SQL casts accept more, such as a trailing d.
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def parse_money(raw: Column) -> Column:
    """struct(value, status): a text cell as a number ("ok"), nothing ("null"),
    or left alone for the contract to refuse ("unreadable")."""
    text = F.trim(F.regexp_replace(compatible(raw), r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(F.trim(text, F.lit("()")), "−", "-")
    bare = F.regexp_replace(bare, r"(?U)[$¥€£,\s]", "")
    bare = F.regexp_replace(bare, "(?i)(usd|mm|millions|million|m)$", "")
    sign = F.when(text.startswith("(") & text.endswith(")"), -1.0).otherwise(1.0)
    absent = raw.isNull() | F.lower(text).isin(*NULL_TOKENS) | bare.isin("", "-", "+")
    value = F.when(~absent, _number(bare) * sign)
    return F.struct(value.alias("value"), F.when(absent, "null").when(value.isNull(), "unreadable").otherwise("ok").alias("status"))


def parse_confidence(raw: Column) -> Column:
    """struct(value, status): "95%", 92 and 0.5 folded to 0..1 and clamped."""
    text = F.trim(raw)
    number = _number(F.trim(F.regexp_replace(text, "%+$", "")))
    number = F.when(text.endswith("%"), number / 100.0).otherwise(number)
    number = F.when((number > 1.0) & (number <= 100.0), number / 100.0).otherwise(number)
    value = F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))
    value = F.when(number.isNotNull(), value)
    return F.struct(value.alias("value"), F.when(raw.isNull(), "null").when(value.isNull(), "unreadable").otherwise("ok").alias("status"))


def parse_page(raw: Column) -> Column:
    """First run of digits if positive, else null."""
    page = F.nullif(F.regexp_extract(raw, "[0-9]+", 0), F.lit("")).try_cast("bigint")
    return F.when(page > 0, page)


def parse_page_number(number: Column) -> Column:
    """struct(page, kind) of a page sent as a number: positive whole numbers stay,
    other whole ones are null, and a fraction is left for the contract to refuse."""
    whole = number == F.floor(number)
    page = F.when(whole & (number > 0), number.cast("bigint"))
    kind = F.when(number.isNotNull() & ~whole, "fraction").when(page.isNull(), "null").otherwise("number")
    return F.struct(page.alias("page"), kind.alias("kind"))


def parse_year(raw: Column) -> Column:
    """First 19xx or 20xx, else the text unchanged."""
    year = F.regexp_extract(raw, "((?:19|20)[0-9]{2})", 1)
    return F.when(raw.isNull(), None).when(year == "", raw).otherwise(year)


def parse_duration(raw: Column) -> Column:
    """Seconds of "30", "30s", "1m30s" or "500ms"; null when nothing is read."""
    text = F.trim(raw)
    units = {"ms": 0.001, "h": 3600.0, "m": 60.0, "s": 1.0}
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9.]+\s*(?:ms|h|m|s))"), 1)

    def seconds(p: Column) -> Column:
        unit = F.regexp_extract(p, "(ms|h|m|s)$", 1)
        scale = F.lit(0.0)
        for k, v in units.items():
            scale = F.when(unit == k, v).otherwise(scale)
        return F.coalesce(F.regexp_extract(p, "^[0-9.]+", 0).try_cast("double"), F.lit(0.0)) * scale

    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + seconds(p))
    return F.coalesce(_number(text), F.when(F.size(parts) > 0, total))


def format_duration(seconds: Column) -> Column:
    """"<1 s", "2.5 s" under ten seconds, "42 s", "3 min 5 s", and a full minute carried."""
    minutes, rest = F.floor(seconds / 60), F.round(seconds % 60).cast("bigint")
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "—")
        .when(seconds < 1, "<1 s")
        .when(seconds < 10, F.format_string("%.1f s", seconds))
        .when(seconds < 60, F.format_string("%.0f s", seconds))
        .when(rest == 60, F.format_string("%d min", minutes + 1))
        .otherwise(F.format_string("%d min %d s", minutes, rest))
    )


def rounded_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def ratio_percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, null for an empty whole."""
    return F.bround(part / F.nullif(whole, F.lit(0)) * 100, 1)
