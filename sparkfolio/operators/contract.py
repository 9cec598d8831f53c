"""Reading, repairing and strictly validating model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import fold_name
from ..functions.udfs import salvage_json

#: Wrapper keys, in the order they are tried.
WRAPPERS = ("result", "data", "balance_sheet", "output", "items")


def canonical_items(rows: DataFrame, names: DataFrame, item: str = "item") -> DataFrame:
    """Adds ``canonical``: the schema's name of an item or a known variant, else null. ``names`` is a small dimension."""
    folded = rows.withColumn("_folded", fold_name(F.col(item)))
    return folded.join(F.broadcast(names.select(F.col("folded").alias("_folded"), F.col("item").alias("canonical"))), "_folded", "left").drop("_folded")


def read_replies(replies: DataFrame) -> DataFrame:
    """Adds payload (variant), rows (variant array or null) and unwrapped (the wrapper used) to (…, content)."""
    read = replies.withColumn("payload", F.try_parse_json(salvage_json(F.col("content"))))
    kind = F.schema_of_variant("payload")
    direct = F.when(kind.startswith("ARRAY"), F.col("payload")).otherwise(F.try_variant_get("payload", "$.rows", "variant"))
    rows, used = direct, F.when(kind.startswith("ARRAY"), "bare rows")
    nested = F.lit(None).cast("variant")
    name, boxed = F.lit(None).cast("string"), F.lit(False)
    for key in reversed(WRAPPERS):
        at = F.try_variant_get("payload", f"$.{key}", "variant")
        inner = F.try_variant_get("payload", f"$.{key}.rows", "variant")
        hit = F.coalesce(F.schema_of_variant(at).startswith("ARRAY"), F.lit(False))
        nested = F.when(inner.isNotNull(), inner).when(hit, at).otherwise(nested)
        name = F.when(inner.isNotNull() | hit, key).otherwise(name)
        boxed = F.when(inner.isNotNull(), True).when(hit, False).otherwise(boxed)
    told = read.withColumn("rows", F.coalesce(rows, nested)).withColumn("unwrapped", F.coalesce(used, F.when(direct.isNull(), name)))
    told = told.withColumn("boxed", F.coalesce(direct.isNull() & boxed, F.lit(False)))
    year = F.try_variant_get("payload", "$.detected_fiscal_year", "string")
    return told.withColumn("said_year", F.when(kind.startswith("OBJECT"), year)).withColumn("year", V.parse_year(F.col("said_year")))


def reply_violations(read: DataFrame, by: list[str]) -> DataFrame:
    """Breaches of a whole reply: (by…, code, message). ``read`` as ``read_replies`` gives it."""
    kind = F.schema_of_variant("payload")
    listed = F.coalesce(F.schema_of_variant("rows").startswith("ARRAY"), F.lit(False))
    code = F.when(F.col("payload").isNull(), "payload").when(~kind.rlike("^(OBJECT|ARRAY)"), "payload").when(~listed, "rows")
    message = F.when(F.col("payload").isNull(), "no JSON was found in the reply").when(~kind.rlike("^(OBJECT|ARRAY)"), F.concat(F.lit("an object with rows is expected, found "), F.lower(kind))).otherwise("rows are required")
    bad_year = F.col("year").isNotNull() & ~F.trim("year").rlike("^[0-9]{4}$")
    checks = F.array_compact(
        F.array(
            F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message"))),
            F.when(bad_year, F.struct(F.lit("fiscal_year").alias("code"), F.concat(F.lit("fiscal year has not four digits: "), F.col("year")).alias("message"))),
        )
    )
    return read.select(*by, F.explode(checks).alias("c")).select(*by, "c.code", "c.message")


def all_notes(read: DataFrame, repaired: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """(by…, notes): what was repaired in each reply, in the order of the steps: wrapped or
    unwrapped, fiscal year read, items renamed, values parsed, rows put in schema order."""
    n = schema.count()  # a constant dimension
    at = repaired.join(F.broadcast(schema.select("item", F.col("ord").alias("place"))), "item", "left")
    step = W.partitionBy(*by).orderBy("ord")
    order = at.withColumn("k", F.row_number().over(step) - 1).groupBy(*by).agg(
        ((F.count(F.lit(1)) == n) & (F.count_distinct("place") == n) & F.bool_or(F.col("place") != F.col("k"))).alias("moved")
    )
    counted = repair_notes(repaired, by).withColumnRenamed("notes", "counted")
    whole = read.select(*by, "unwrapped", "boxed", "said_year", "year").join(counted, by, "left").join(order, by, "left")
    first = F.array_compact(
        F.array(
            F.when(F.col("unwrapped") == "bare rows", "wrapped a bare array of rows"),
            F.when((F.col("unwrapped") != "bare rows") & F.col("boxed"), F.concat(F.lit("unwrapped the object under "), F.col("unwrapped"))),
            F.when((F.col("unwrapped") != "bare rows") & ~F.col("boxed"), F.concat(F.lit("took "), F.col("unwrapped"), F.lit(" as rows"))),
            F.when(F.col("year") != F.col("said_year"), F.concat(F.lit("read fiscal year "), F.col("year"), F.lit(" out of "), F.col("said_year"))),
        )
    )
    last = F.when(F.col("moved"), F.array(F.lit("put rows in schema order"))).otherwise(F.array().cast("array<string>"))
    return whole.select(*by, F.concat(first, F.coalesce("counted", F.array().cast("array<string>")), last).alias("notes"))


def explode_rows(read: DataFrame, by: list[str]) -> DataFrame:
    """One row per reply row: by…, ord, item, and each field's text and kind."""
    array = F.coalesce(F.try_variant_get("rows", "$", "array<variant>"), F.array().cast("array<variant>"))
    out = read.select(*by, F.posexplode(array).alias("ord", "row"))
    fields = {"item": "item", "answer": "answer_m_usd", "confidence": "confidence", "page": "source_page"}
    cols = []
    for name, key in fields.items():
        value = F.try_variant_get("row", f"$.{key}", "variant")
        cols += [F.try_variant_get("row", f"$.{key}", "string").alias(name), kind_of(value).alias(f"{name}_kind")]
    return out.select(*by, "ord", *cols)


def kind_of(value: Column) -> Column:
    """absent, null, boolean, number, string or other."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "absent")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "number")
        .when(kind == "STRING", "string")
        .otherwise("other")
    )


def repair_rows(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical names and parsed values; what cannot be read keeps its kind, for the contract to refuse."""
    named = canonical_items(rows, names).withColumn("renamed", F.col("canonical").isNotNull() & (F.col("canonical") != F.col("item")))
    money, sure = V.parse_money(F.col("answer")), V.parse_confidence(F.col("confidence"))
    out = named.withColumn("item", F.coalesce("canonical", "item")).drop("canonical")
    text_money, text_sure = F.col("answer_kind") == "string", F.col("confidence_kind").isin("string", "number")
    out = out.withColumn("reformatted", text_money & (money["status"] != "unreadable"))
    out = out.withColumn("value", F.when(F.col("answer_kind").isin("string", "number"), money["value"]))
    out = out.withColumn("answer_kind", F.when(text_money & (money["status"] == "ok"), "number").when(text_money & (money["status"] == "null"), "null").otherwise(F.col("answer_kind")))
    out = out.withColumn("sure", F.when(text_sure, sure["value"]))
    out = out.withColumn("confidence_kind", F.when(F.col("confidence_kind") == "string", F.when(sure["status"] == "ok", "number").otherwise("string")).otherwise(F.col("confidence_kind")))
    number = V.parse_page_number(F.col("page").try_cast("double"))
    out = out.withColumn("page_no", F.when(F.col("page_kind") == "string", V.parse_page(F.col("page"))).when(F.col("page_kind") == "number", number["page"]))
    read = F.when(F.col("page_no").isNull(), "null").otherwise("number")
    return out.withColumn("page_kind", F.when(F.col("page_kind") == "string", read).when(F.col("page_kind") == "number", number["kind"]).otherwise(F.col("page_kind")))


def repair_notes(repaired: DataFrame, by: list[str]) -> DataFrame:
    """Plain-language notes per reply: renamed and parsed counts."""
    told = repaired.groupBy(*by).agg(
        F.count_if("renamed").alias("n_renamed"), F.count_if("reformatted").alias("n_parsed"), F.array_sort(F.collect_list(F.when(F.col("renamed"), F.struct("ord", "item")))).alias("which")
    )
    shown = F.array_join(F.transform(F.slice("which", 1, 3), lambda x: x["item"]), ", ")
    more = F.when(F.col("n_renamed") > 3, F.concat(F.lit(" (+"), (F.col("n_renamed") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    notes = F.array_compact(
        F.array(
            F.when(F.col("n_renamed") > 0, F.concat(F.lit("renamed "), F.col("n_renamed").cast("string"), F.lit(" item(s): "), shown, more)),
            F.when(F.col("n_parsed") > 0, F.concat(F.lit("parsed "), F.col("n_parsed").cast("string"), F.lit(" value(s) sent as text"))),
        )
    )
    return told.select(*by, "n_renamed", "n_parsed", notes.alias("notes"))


def reordered(rows: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """Rows in schema order where a reply has exactly the schema's items, else as they came."""
    n = schema.count()  # a constant dimension
    joined = rows.join(F.broadcast(schema.select("item", F.col("ord").alias("place"))), "item", "left")
    whole = W.partitionBy(*by)
    complete = (F.count(F.lit(1)).over(whole) == n) & (F.size(F.collect_set("place").over(whole)) == n)
    order = F.when(complete, F.col("place")).otherwise(F.col("ord"))
    return joined.withColumn("ord", order).drop("place")


def violations(rows: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """Every breach of the contract, as data: (by…, ord, code, message).

    ``rows``: by…, ord, item, answer_kind, confidence_kind, confidence_value,
    page_kind. Field rules come first; only a reply that passes them is held to the
    list rules (row count, duplicates, missing items, order), of which the first
    that fails is told.
    """
    n = schema.count()  # a constant dimension
    known = rows.join(F.broadcast(schema.select("item", F.col("ord").alias("place"))), "item", "left")
    sure = F.col("confidence_value")
    checks = F.array_compact(
        F.array(
            F.when(F.col("place").isNull(), F.struct(F.lit("unknown_item").alias("code"), F.concat(F.lit("unknown item "), F.coalesce("item", F.lit("null"))).alias("message"))),
            F.when(~F.col("answer_kind").isin("number", "null", "absent"), F.struct(F.lit("answer_type").alias("code"), F.concat(F.lit("answer is "), F.col("answer_kind")).alias("message"))),
            F.when(
                (F.col("confidence_kind") != "number") | sure.isNull() | (sure < 0) | (sure > 1),
                F.struct(F.lit("confidence").alias("code"), F.concat(F.lit("confidence is not a number from 0 to 1: "), F.col("confidence_kind")).alias("message")),
            ),
            F.when(~F.col("page_kind").isin("number", "null", "absent"), F.struct(F.lit("page_type").alias("code"), F.concat(F.lit("page is "), F.col("page_kind")).alias("message"))),
        )
    )
    judged = known.withColumn("checks", checks)
    fields = judged.select(*by, "ord", F.explode("checks").alias("c")).select(*by, F.col("ord").cast("int").alias("ord"), "c.code", "c.message")
    step = W.partitionBy(*by).orderBy("ord")
    lists = (
        judged.withColumn("k", F.row_number().over(step) - 1)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.size("checks")).alias("bad"),
            F.count_distinct("item").alias("items"),
            F.array_sort(F.collect_set("place")).alias("places"),
            F.min(F.when(F.col("place") != F.col("k"), F.col("k"))).alias("misplaced"),
        )
        .where("bad = 0")
    )
    missing = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), "places")
    names = F.array(*[F.lit(r["item"]) for r in schema.select("ord", "item").orderBy("ord").collect()])  # a constant dimension
    code = F.when(F.col("rows") != n, "row_count").when(F.col("items") != F.col("rows"), "duplicates").when(F.size(missing) > 0, "missing").when(F.col("misplaced").isNotNull(), "order")
    message = (
        F.when(F.col("rows") != n, F.concat(F.lit(f"{n} rows expected, "), F.col("rows").cast("string"), F.lit(" found")))
        .when(F.col("items") != F.col("rows"), "an item occurs more than once")
        .when(F.size(missing) > 0, F.concat(F.size(missing).cast("string"), F.lit(" items missing: "), F.array_join(F.transform(F.slice(missing, 1, 5), lambda k: F.get(names, k)), ", "), F.when(F.size(missing) > 5, "…").otherwise("")))
        .when(F.col("misplaced").isNotNull(), F.concat(F.lit("row "), F.col("misplaced").cast("string"), F.lit(" is out of order")))
    )
    listed = lists.select(*by, F.lit(None).cast("int").alias("ord"), code.alias("code"), message.alias("message")).where("code IS NOT NULL")
    return fields.unionByName(listed)


def partition_check(keys: DataFrame, answers: DataFrame, unscorable: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """Whether answers and unscorable items of each key part the schema: disjoint and together whole."""
    tagged = answers.select(*by, "item", F.lit(1).alias("a"), F.lit(0).alias("u")).unionByName(unscorable.select(*by, "item", F.lit(0).alias("a"), F.lit(1).alias("u")))
    per = tagged.groupBy(*by, "item").agg(F.max("a").alias("a"), F.max("u").alias("u")).join(F.broadcast(schema.select("item", F.lit(1).alias("known"))), "item", "left")
    told = per.groupBy(*by).agg(F.count_if((F.col("a") == 1) & (F.col("u") == 1)).alias("overlap"), F.count("known").alias("covered"), F.count_if(F.col("known").isNull()).alias("foreign"))
    joined = keys.join(told, by, "left").na.fill(0, ["overlap", "covered", "foreign"])
    return joined.withColumn("valid", (F.col("overlap") == 0) & (F.col("covered") == schema.count()) & (F.col("foreign") == 0))


def verification_rows(documents: DataFrame, schema: DataFrame, candidates: list[tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """All schema rows of each document, from the first of the named answer sets
    (by…, item, ord, answer) that has any row for it; the last duplicate wins; "empty" without one."""
    tagged = None
    for k, (name, rows) in enumerate(candidates):
        part = rows.select(*by, "item", "ord", "answer").withColumn("k", F.lit(k)).withColumn("source", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(*by).agg(F.min(F.struct("k", "source")).alias("b")).select(*by, F.col("b.k").alias("k"), F.col("b.source").alias("source"))
    last = tagged.join(best.select(*by, "k"), [*by, "k"]).groupBy(*by, "item").agg(F.max_by("answer", "ord").alias("answer"))
    grid = documents.select(*by).crossJoin(F.broadcast(schema.select("ord", "item")))  # 27 rows on the right
    joined = grid.join(best.drop("k"), by, "left").join(last, [*by, "item"], "left")
    return joined.withColumn("source", F.coalesce("source", F.lit("empty")))
