"""Text health, document assembly, page ranges, load estimates, prompts and OCR routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def text_health(pages: DataFrame) -> DataFrame:
    """Adds garble_ratio, mixed_ratio and unreadable to (…, text)."""
    return pages.withColumn("garble_ratio", T.garble_ratio(F.col("text"))).withColumn("mixed_ratio", T.mixed_token_ratio(F.col("text"))).withColumn(
        "unreadable", (F.col("garble_ratio") >= T.GARBLE_LIMIT) | (F.col("mixed_ratio") >= T.MIXED_LIMIT)
    )


def assemble(pages: DataFrame) -> DataFrame:
    """One row per document from (doc, page, text): the readable pages in order
    under page markers, which pages are garbled or empty, and warnings."""
    plain = pages.select("doc", "page", T.normalize_text(F.col("text")).alias("text"))
    judged = text_health(plain).withColumn("blank", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "")
    keep = ~F.col("unreadable") & ~F.col("blank")
    marked = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    told = judged.groupBy("doc").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_sort(F.collect_list(F.when(F.col("unreadable"), F.col("page")))).alias("garbled_pages"),
        F.count_if(F.col("blank") & ~F.col("unreadable")).alias("empty_pages"),
        F.count_if(keep).alias("readable_pages"),
        F.sum(F.when(F.col("unreadable"), F.length("text")).otherwise(0)).alias("dropped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page", marked.alias("t"))))), lambda x: x["t"]), "\n\n").alias("text"),
    )
    shown = F.array_join(F.slice("garbled_pages", 1, 12), ", ")
    more = F.when(F.size("garbled_pages") > 12, F.concat(F.lit(" (+"), (F.size("garbled_pages") - 12).cast("string"), F.lit(" more)"))).otherwise("")
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("garbled_pages") > 0,
                F.concat(F.lit("unreadable text layer: pages "), shown, more, F.lit("; about "), T.approx_tokens(F.col("dropped")).cast("string"), F.lit(" tokens left out")),
            ),
            F.when(F.col("empty_pages") > 0, F.concat(F.col("empty_pages").cast("string"), F.lit(" empty pages"))),
            F.when(F.col("readable_pages") == 0, "no readable page text"),
        )
    )
    return told.withColumn("warnings", warnings).withColumn("char_count", F.length("text")).withColumn("approx_tokens", T.approx_tokens(F.length("text"))).drop("dropped")


def page_ranges(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages of each group as "6-8, 10-11", by gaps and islands."""
    one = pages.select(*by, "page").distinct()
    island = one.withColumn("island", F.col("page") - F.row_number().over(W.partitionBy(*by).orderBy("page")))
    runs = island.groupBy(*by, "island").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    shown = F.when(F.col("b") > F.col("a"), F.concat_ws("-", "a", "b")).otherwise(F.col("a").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return runs.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ", ").alias("pages"), F.count(F.lit(1)).alias("n_runs"))


def estimate_load(pages: DataFrame, samples: int = 12) -> DataFrame:
    """Size of each document as a prompt, from every n-th page, at most ``samples``."""
    by = W.partitionBy("doc")
    counted = pages.withColumn("k", F.row_number().over(by.orderBy("page")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / samples))
    taken = (F.col("k") % step == 0) & (F.floor(F.col("k") / step) < samples)
    told = counted.groupBy("doc").agg(
        F.first("n").alias("pages"), F.count_if(taken).alias("sampled_pages"), F.sum(F.when(taken, F.length(T.normalize_text(F.col("text")))).otherwise(0)).alias("chars")
    )
    total = F.floor(F.col("chars") / F.col("sampled_pages") * F.col("pages")) + F.col("pages") * 20
    return told.withColumn("approx_characters", total).withColumn("approx_tokens", T.approx_tokens(total)).drop("chars")


def batch_plan(files: DataFrame, concurrency: int) -> DataFrame:
    """One row: totals, the recommended width for the mean load, and its waves."""
    told = files.agg(F.count(F.lit(1)).alias("file_count"), F.sum("pages").alias("total_pages"), F.sum("approx_tokens").alias("total_approx_tokens"))
    mean = F.col("total_approx_tokens") / F.col("file_count")
    ceiling = F.when(mean >= 180_000, 2).when(mean >= 120_000, 3).when(mean >= 80_000, 4).otherwise(concurrency)
    width = F.greatest(F.lit(1), F.least(F.lit(concurrency), F.col("file_count"), ceiling))
    return told.withColumn("recommended_concurrency", width.cast("int")).withColumn("waves", F.ceil(F.col("file_count") / F.col("recommended_concurrency")))


def assemble_prompts(parts: DataFrame, prefix: str) -> DataFrame:
    """(doc, prompt) from (doc, seq, label, body): the fixed prefix, then labelled parts in order."""
    shown = F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("body"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", shown.alias("s"))))
    return parts.groupBy("doc").agg(F.concat(F.lit(prefix), F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n")).alias("prompt"), F.count(F.lit(1)).alias("n_parts"))


def render_diagnostics(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, text) of labelled facts: ``labels`` (ord, key, label) order the rows of (doc, key, value); missing ones are skipped."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "label", "value").alias("s"))))
    return facts.where("value IS NOT NULL AND value <> ''").join(labels, "key").groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("text"))


def route_ocr(pages: DataFrame) -> DataFrame:
    """Which pages need OCR and which text is taken.

    ``pages``: doc, page, text, flagged, hinted, encoding_issue, fallback_text,
    ocr_text. A fallback is accepted if it has text, little garble, and either no
    encoding issue or healthy tokens.
    """
    fallback = F.coalesce("fallback_text", F.lit(""))
    healthy = ~T.unreadable(fallback)
    accepted = (F.trim(fallback) != "") & (T.garble_ratio(fallback) < T.GARBLE_LIMIT) & (~F.col("encoding_issue") | healthy)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    needs = F.col("flagged") | F.col("hinted") | blank | (~F.col("accepted") & T.unreadable(F.coalesce("text", F.lit(""))))
    routed = pages.withColumn("accepted", accepted).withColumn("needs_ocr", needs)
    source = (
        F.when(F.col("needs_ocr") & F.col("ocr_text").isNotNull() & (F.trim("ocr_text") != ""), "ocr")
        .when(F.col("accepted"), "fallback")
        .when(F.col("needs_ocr"), "missing")
        .otherwise("native")
    )
    routed = routed.withColumn("provenance", source)
    return routed.withColumn("chosen", F.when(F.col("provenance") == "ocr", F.col("ocr_text")).when(F.col("provenance") == "fallback", F.col("fallback_text")).when(F.col("provenance") == "native", F.col("text")))
