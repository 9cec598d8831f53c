"""License scan by MinHash bands over overlapping windows, in built-in functions only.

A text's words give five-word shingles. Long templates (``LONG`` shingles or
more) are retrieved by windows of ``WINDOW`` shingles that start every
``STRIDE``: a window inside a verbatim copy equals one of the template's own
windows, which are indexed at every offset, and collides in every band. With
containment c of at least 0.8, some window shares that share of shingles with
the template's window, a Jaccard similarity of c / (2 - c) >= 2/3; ``BANDS``
bands of one row each then miss one window with probability under 1/80, and a
copy holds several. Short templates have no whole window; their windows are
single shingles, whose MinHash is the shingle, so any shared shingle retrieves
them. Candidates are verified by exact containment of the template's shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, STRIDE, BANDS = 5, 16, 8, 4
#: A copy this long holds a whole window wherever windows start.
LONG = WINDOW + STRIDE - 1
#: Most index keys that are looked for in place, and most rows of the index that are broadcast.
INLINED, SMALL_INDEX = 20_000, 500_000
#: One odd number per band, to permute shingle hashes by xor.
PERMUTATIONS = [0x1E3779B97F4A7C15 * (2 * k + 1) % (1 << 63) for k in range(BANDS)]


@dataclass(frozen=True)
class Template:
    name: str
    text: str


# License notices and grants in their usual wording.
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("MIT", "This project is licensed under the MIT License"),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template(
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: Letters and digits make words; A-Z is folded alone, as SQL engines differ beyond.
_NOT_WORD = r"[^\\p{L}\\p{N}]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _plain(text: str) -> str:
    return f"trim(regexp_replace({_FOLD.format(text)}, '{_NOT_WORD}', ' '))"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hashed(body: str) -> str:
    """``body`` with ``h`` bound to the shingle hashes of the column ``plain``."""
    words = "if(plain = '', cast(array() as array<string>), split(plain, ' '))"
    return _let(words, "ws", _let("transform(slice(ws, 1, greatest(size(ws) - 4, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]))", "h", body))


def _bands(stride: int) -> str:
    """Band keys of the windows of ``h`` that start every ``stride``."""
    cut = f"if(size(h) < {WINDOW}, cast(array() as array<array<bigint>>), transform(sequence(1, greatest(1, size(h) - {WINDOW - 1}), {stride}), i -> slice(h, i, {WINDOW})))"
    keys = ", ".join(f"transform(windows, s -> xxhash64({k}, array_min(transform(s, x -> x ^ {c}L))))" for k, c in enumerate(PERMUTATIONS))
    return _let(cut, "windows", f"concat({keys})")


def _index(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(template, license, shingles, key): the templates under each of their keys."""
    given = docs.sparkSession.createDataFrame([(k, t.name, t.text) for k, t in enumerate(templates)], "template int, license string, _text string")
    cut = given.selectExpr("template", "license", f"{_plain('_text')} AS plain")
    shingles = _let("split(plain, ' ')", "ws", "array_distinct(transform(slice(ws, 1, greatest(size(ws) - 4, 0)), (w, i) -> concat_ws(' ', slice(ws, i + 1, 5))))")
    keys = _hashed(f"array_distinct(if(size(h) < {LONG}, h, {_bands(1)}))")
    return cut.selectExpr("template", "license", f"{shingles} AS shingles", f"explode({keys}) AS key")


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, containment: float = 0.8
) -> DataFrame:
    """Templates of which a text holds at least ``containment`` of the distinct shingles.

    Returns one row per id and template found: the id, template (its place in
    ``templates``), license, n_found and n_shingles. Templates of fewer than
    five words cannot be found and raise a ValueError. The index is counted: up
    to ``INLINED`` keys are looked for in place, a larger one is joined, and up to
    ``SMALL_INDEX`` of its rows are broadcast.

    Null, empty and short texts give no rows. Null ids are kept. Repeated rows
    give one row, rows of one id but other texts one row for each outcome. An
    empty table gives an empty result. Other columns are not read, so their
    names cannot clash.
    """
    if any(len("".join(c if c.isalnum() else " " for c in t.text).split()) < SHINGLE for t in templates):
        raise ValueError("a template needs five words")
    index = _index(docs, templates)
    n_keys = index.count()  # a constant dimension
    cut = docs.select(F.col(id_col).alias("_id"), F.expr(_plain(f"`{text_col}`")).alias("plain"))
    found = _hashed(f"array_distinct(concat(h, {_bands(STRIDE)}))")
    if n_keys <= INLINED:
        keys = sorted({r["key"] for r in index.select("key").collect()})
        known_keys = ", ".join(f"{k}L" if k > -(1 << 63) else "(-9223372036854775807L - 1L)" for k in keys)
        found = _hashed(f"array_intersect(concat(h, {_bands(STRIDE)}), array({known_keys}))")
    # explode_outer, as a filter inferred from explode would compute the keys twice
    hits = cut.selectExpr("_id", "concat(' ', plain, ' ') AS plain", f"explode_outer({found}) AS key")
    pairs = hits.join(F.broadcast(index) if n_keys <= SMALL_INDEX else index, "key")
    told = pairs.selectExpr("_id", "template", "license", "cast(size(filter(shingles, s -> contains(plain, concat(' ', s, ' ')))) as bigint) AS n_found", "cast(size(shingles) as bigint) AS n_shingles")
    return told.where(F.col("n_found") >= containment * F.col("n_shingles")).distinct().withColumnRenamed("_id", id_col)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: DuckDB SQL that compares every text with every template.
SQL = rf"""
WITH templates(template, license, text) AS (VALUES {", ".join(f"({k}, {_quoted(t.name)}, {_quoted(t.text)})" for k, t in enumerate(TEMPLATES))}),
words AS (SELECT template, license, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM templates),
shingles AS (SELECT DISTINCT template, license, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT template, license, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)),
plain AS (
  SELECT DISTINCT doc_id, ' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS plain
  FROM documents WHERE text IS NOT NULL
),
found AS (
  SELECT doc_id, plain, template, license, count(*) FILTER (contains(plain, ' ' || s || ' ')) AS n_found, count(*) AS n_shingles
  FROM plain, shingles GROUP BY ALL
)
SELECT DISTINCT doc_id, template::INTEGER AS template, license, n_found, n_shingles FROM found WHERE n_found >= 0.8 * n_shingles
"""
