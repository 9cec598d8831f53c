"""The few functions Spark lacks, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.str.casefold()


@F.pandas_udf(StringType())
def identity(values: pd.Series) -> pd.Series:
    """Letters and digits of the NFKC form, case folded; empty for a null."""
    return values.map(lambda x: "".join(c for c in unicodedata.normalize("NFKC", x or "").casefold() if c.isalnum()))


def _balanced(text: str, at: int) -> int:
    """End of the bracket-balanced slice that starts at ``at``, or -1; strings are skipped."""
    opener, closer = text[at], {"{": "}", "[": "]"}[text[at]]
    depth, k, quoted = 0, at, False
    while k < len(text):
        c = text[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in (opener, closer):
            depth += 1 if c == opener else -1
            if not depth:
                return k + 1
        k += 1
    return -1


def _candidates(text: str) -> Iterator[str]:
    yield text
    for opener in "{[":
        at = text.find(opener)
        while at >= 0:
            if (end := _balanced(text, at)) > 0:
                yield text[at:end]
            at = text.find(opener, at + 1)


def salvaged(reply: str | None) -> str | None:
    """Canonical JSON of a reply: code fence stripped, then the whole text, else
    the first balanced object that parses, else the first such array."""
    text = (reply or "").strip()
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        text = "\n".join(lines[:-1] if lines and lines[-1].strip().startswith("```") else lines).strip()
    for part in _candidates(text):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def salvage_json(replies: pd.Series) -> pd.Series:
    return replies.map(salvaged)
