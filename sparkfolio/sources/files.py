"""Readers and writers of run records, manifests, event logs, seeds, ledgers and pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.verification import deletions
from .snapshots import Folder

RUN_SCHEMA = (
    "run_id string, workspace_id string, strategy string, experiment string, company string, fiscal_year string, currency string, "
    "source_pdf_sha256 string, pdf_file string, value_quantum double, extract_seconds double, total_seconds double, "
    "rows array<struct<item:string,answer_m_usd:double,confidence:double,source_page:int,source_label:string,evidence:string>>, _corrupt_record string"
)
EVENT_SCHEMA = "event string, data variant, at timestamp, _corrupt_record string"
PDF_MAGIC, PDF_MAX_BYTES = b"%PDF-", 100 * 1024 * 1024


def _below(folder: str, names: str, depth: int = 8) -> str:
    """Files of these names in up to ``depth`` folders below one: a glob, as listing a
    folder would pass over names that start with "_", such as _pending."""
    return f"{folder}/{{{','.join('/'.join('*' * k) for k in range(1, depth + 1))}}}/{names}"


def read_runs(spark: SparkSession, folder: str, schema: str = RUN_SCHEMA) -> DataFrame:
    """Every readable run record below ``folder``, one a directory,
    prediction before request; malformed records are skipped, never fatal."""
    paths = _below(folder, "{prediction,request}.json")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    placed = raw.withColumn("path", F.col("_metadata.file_path")).withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    rank = F.row_number().over(W.partitionBy("directory").orderBy("path"))  # "prediction" sorts first
    return placed.where("_corrupt_record IS NULL").withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_corrupt_record")


def explode_runs(runs: DataFrame) -> DataFrame:
    """One row per answer: run_id, ord, item, answer, confidence, source_page."""
    return runs.select("run_id", F.posexplode("rows").alias("ord", "r")).select(
        "run_id", "ord", "r.item", F.col("r.answer_m_usd").alias("answer"), "r.confidence", "r.source_page"
    )


def _folder_name(name: Column) -> Column:
    """A name of letters, digits and marks of any script, without what stores or globs give a meaning."""
    return F.regexp_replace(F.regexp_replace(name, r"[\x00-\x20/\\:*?\"<>|{}\[\]=%#^,]+", "_"), "^[._]+", "")


def write_runs(runs: DataFrame, folder: str) -> int:
    """Files runs as ``company/FYyear/run_id/prediction.json`` and returns how many.

    Records are written beside and each is then moved over its run's own in one step: a
    reader sees the old or the new one. Of rows of one run the greatest record stands; a run
    without id gets one, and a folder, of its own. The driver makes one call of the store a run.
    """
    run = F.coalesce(F.nullif(F.trim("run_id"), F.lit("")), F.concat(F.lit("unnamed_"), F.replace(F.uuid(), F.lit("-"))))
    placed = runs.withColumn("run_id", run)
    return _filed(placed, F.lit("prediction"), F.to_json(F.struct(*runs.columns)), folder)


def write_attempts(attempts: DataFrame, folder: str) -> int:
    """Files requests and raw responses beside their run's record, as ``kind.json`` or ``kind_repair_n.json``.

    ``attempts``: run_id, company, fiscal_year, kind (request or raw_response), repair (0: the first try) and content,
    which is kept as it is, JSON or not. Of rows of one file the greatest content stands. Returns how many files were written.
    """
    known = F.when(F.col("kind").isin("request", "raw_response") & F.col("run_id").isNotNull(), F.col("kind")).otherwise(F.raise_error(F.lit("kind must be request or raw_response, of a run with an id")))
    name = F.when(F.coalesce("repair", F.lit(0)) > 0, F.concat(known, F.lit("_repair_"), F.col("repair").cast("string"))).otherwise(known)
    return _filed(attempts, name, F.coalesce("content", F.lit("")), folder)


def _filed(rows: DataFrame, name: Column, content: Column, folder: str) -> int:
    """Writes a file for each (company, year, run, name) of rows, beside, and moves each to its place in one step."""
    year = F.nullif(F.regexp_extract(F.coalesce(F.col("fiscal_year").cast("string"), F.lit("")), "((?:19|20)[0-9]{2})", 1), F.lit(""))
    company = F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("Unknown_Company"))
    parts = {"_c": _folder_name(company), "_y": F.concat(F.lit("FY"), F.coalesce(year, F.lit("-unknown"))), "_r": _folder_name(F.col("run_id")), "_n": name}
    records = rows.groupBy(*[v.alias(k) for k, v in parts.items()]).agg(F.max(content).alias("value"))
    store, staged = Folder(rows.sparkSession, folder), f"{folder}/_staged/{uuid.uuid4().hex}"
    records.write.partitionBy(*parts).text(staged)
    moved = 0
    for path in store.files(staged):
        *_, c, y, r, n, file = unquote(path).split("/")
        if file.startswith("part-"):
            c, y, r, n = (x.split("=", 1)[1] for x in (c, y, r, n))
            store.replace(path, f"{folder}/{c}/{y}/{r}/{n}.json")
            moved += 1
    store.delete(staged)
    return moved


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run filed under its id, else one whose record carries it."""
    here = F.endswith("directory", F.lit(f"/{run_id}"))
    return runs.where(here | (F.col("run_id") == run_id)).orderBy(F.desc(here), "path").limit(1)


def delete_runs(spark: SparkSession, folder: str, run_ids: list[str] | DataFrame, workspace: str, running: DataFrame | None = None, schema: str = RUN_SCHEMA) -> DataFrame:
    """Deletes the folders of runs that a workspace owns and that are not at work; returns (run_id, outcome) of each asked for.

    A line in ``_deleted`` below the folder, written before, tells of each deleted run: readers of a snapshot may drop what is named
    there (``deleted_runs``), and a deletion that was broken off can be done again. The driver makes one call of the store for a folder.
    """
    wanted = run_ids if isinstance(run_ids, DataFrame) else spark.createDataFrame([(r,) for r in run_ids], "run_id string")
    try:
        runs = read_runs(spark, folder, schema)
    except AnalysisException:  # no record is there
        runs = spark.createDataFrame([], f"{schema}, path string, directory string").drop("_corrupt_record")
    outcomes = deletions(wanted, runs, workspace, running)
    gone = outcomes.where("outcome = 'deleted'")
    told = outcomes.collect()  # a row for each run asked for
    paths = [r.directory for r in runs.join(gone, "run_id").select("directory").distinct().collect()]
    if paths:
        spark.createDataFrame([(r.run_id,) for r in told if r.outcome == "deleted"], "run_id string").withColumn("at", F.current_timestamp()).write.mode("append").json(f"{folder}/_deleted")
        store = Folder(spark, folder)
        for path in paths:
            store.delete(path)
    return spark.createDataFrame([tuple(r) for r in told], "run_id string, outcome string")


def deleted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, at) of deletions; a run deleted twice has two rows."""
    try:
        return spark.read.schema("run_id string, at timestamp").json(f"{folder}/_deleted")
    except AnalysisException:
        return spark.createDataFrame([], "run_id string, at timestamp")


def read_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(directory, kind, repair, content) of every request and raw response kept beside the runs; repairs count from 1."""
    raw = spark.read.text(_below(folder, "{request,raw_response}*.json"), wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, "([^/]*)[.]json$", 1)
    repair = F.coalesce(F.nullif(F.regexp_extract(name, "_repair_([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    return raw.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract(name, "^(request|raw_response)", 1).alias("kind"), repair.alias("repair"), F.col("value").alias("content"))


def write_job_states(states: DataFrame, folder: str) -> None:
    """Job states (job, status, …, updated_at), each replacing its job's; a job's id is hexadecimal."""
    checked = states.withColumn("job", F.when(F.lower("job").rlike("^[0-9a-f]+$"), F.col("job")).otherwise(F.raise_error(F.concat(F.lit("not a job id: "), F.coalesce("job", F.lit("null"))))))
    checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").json(folder)


def read_job_states(spark: SparkSession, folder: str, schema: str, newest: int = 20) -> DataFrame:
    """The states updated last (a report's limit)."""
    return spark.read.schema(schema).json(folder).orderBy(F.desc("updated_at"), "job").limit(newest)


def read_manifest(spark: SparkSession, path: str, document: T.StructType) -> DataFrame:
    """The documents of a manifest file; a missing or corrupt one has none."""
    schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("documents", T.ArrayType(document)), T.StructField("_corrupt_record", T.StringType())])
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], document)
    return raw.where("_corrupt_record IS NULL").select(F.explode("documents").alias("d")).select("d.*")


def write_manifest(documents: DataFrame, path: str, version: int = 1) -> None:
    """One file {version, documents}, ordered by company, moved over ``path`` in one step, so
    that readers see the old or the new one. The last of several writers wins; ``snapshots.commit`` loses no change.
    Documents stream through the one task that writes the file."""
    order = F.lower("company").alias("_o")
    rows = documents.select(order, F.to_json(F.struct(*documents.columns)).alias("value"))
    rows = rows.repartitionByRange("_o", "value").sortWithinPartitions("_o", "value").select("value")
    rows = rows.union(documents.sparkSession.createDataFrame([(None,)], "value string")).coalesce(1)  # so that there is a partition

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = f'{{"version": {version}, "documents": ['
        for batch in batches:
            for value in batch.column(0).drop_null().to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([head + value])], names=["value"])
                head = ","
        yield pa.RecordBatch.from_arrays([pa.array([(head if head != "," else "") + "]}"])], names=["value"])

    store, staged = Folder(documents.sparkSession, path.rsplit("/", 1)[0]), f"{path}.{uuid.uuid4().hex}"
    rows.mapInArrow(framed, "value string").write.text(staged)
    store.replace(next(n for n in store.files(staged) if n.rsplit("/", 1)[-1].startswith("part-")), path)
    store.delete(staged)


def _split() -> list[Column]:
    """Of a line: the last change and path of its file, and where its split begins."""
    return [F.col(f"_metadata.{v}").alias(k) for k, v in {"_t": "file_modification_time", "_f": "file_path", "_b": "file_block_start"}.items()]


def _number(first: dict[tuple[str, int], int]):
    """Numbers the lines of each split (_f, _b), which come in order, from its first number on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            at = []
            for key in zip(batch.column("_f").to_pylist(), batch.column("_b").to_pylist()):
                at.append(first[key] + seen.setdefault(key, 0))
                seen[key] += 1
            yield pa.RecordBatch.from_arrays([batch.column("_f"), pa.array(at, pa.int64()), batch.column("value")], names=["file", "offset", "value"])

    return run


def read_events(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """``events_from`` with the next offset beside each event."""
    events, n = events_from(spark, path, after)
    return events.select("offset", F.lit(n).cast("bigint").alias("next_offset"), "event", "data", "at")


def events_from(spark: SparkSession, path: str, after: int = 0) -> tuple[DataFrame, int]:
    """Events of a JSONL log from an offset clamped to [0, n], and n, the next offset.

    Malformed lines are skipped and hold no offset. Files count in the order of their last
    change, then path. Lines are numbered within their split of a file; the number of lines of each split is all that
    reaches the driver.
    """
    raw = spark.read.text(path).select("value", *_split())
    read = raw.where(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"))
    counts = sorted(tuple(r) for r in read.groupBy("_t", "_f", "_b").count().collect())  # a row a split
    n, first, total = sum(r[-1] for r in counts), {}, 0
    for _, f, b, k in counts:
        first[f, b] = total
        total += k
    placed = read.select("_f", "_b", "value").mapInArrow(_number(first), "file string, offset bigint, value string").withColumn("v", F.try_parse_json("value"))
    return placed.where(F.col("offset") >= max(0, min(after, n))).select(
        "offset", F.try_variant_get("v", "$.event", "string").alias("event"), F.try_variant_get("v", "$.data", "variant").alias("data"), F.try_variant_get("v", "$.at", "timestamp").alias("at")
    ), n


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_seeds(spark: SparkSession, path: str, cap: int = 200) -> DataFrame:
    """Companies of a CSV or JSON seed file: name, official_url, country; at most ``cap`` (the feature's limit)."""
    raw = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.option("multiLine", True).json(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    out = raw.select("_at", pick("name", "company_name").alias("name"), pick("official_url", "official_website").alias("official_url"), F.upper(F.coalesce(pick("country"), F.lit("JP"))).alias("country"))
    return out.where("name IS NOT NULL").orderBy("_at").limit(cap).drop("_at")


def read_gold(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(sha, company, fiscal_year, currency, quantum, item, gold) of listed gold files; a digest in two files is an error."""
    key = "struct<company:string,fiscal_year:string,currency:string,source_value_quantum:double,status:string,answers:map<string,double>>"
    raw = spark.read.schema(f"documents map<string,{key}>").option("multiLine", True).json(paths).withColumn("file", F.col("_metadata.file_path"))
    docs = raw.select("file", F.explode("documents").alias("sha", "d"))
    twice = F.count(F.lit(1)).over(W.partitionBy("sha"))
    checked = docs.withColumn("k", twice).withColumn("sha", F.when(F.col("k") > 1, F.raise_error(F.concat(F.lit("digest in two gold files: "), F.col("sha")))).otherwise(F.col("sha")))
    return checked.select("sha", "d.company", "d.fiscal_year", "d.currency", F.col("d.source_value_quantum").alias("quantum"), F.explode("d.answers").alias("item", "gold"))


def write_csv(rows: DataFrame, folder: str, quote_all: bool = False, blank_unless: dict[str, str] | None = None) -> None:
    """CSV with arrays as JSON cells and inner quotes doubled; ``blank_unless`` names, for
    columns, the flag without which their cells stay empty."""
    for name, flag in (blank_unless or {}).items():
        rows = rows.withColumn(name, F.when(F.col(flag), F.col(name)))
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(folder)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(line) of a Markdown table's body."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def write_ledger(rows: DataFrame, folder: str) -> None:
    """A ledger as CSV, JSON and Markdown, in three folders; the Markdown head stands in each part."""
    write_csv(rows, f"{folder}/csv")
    rows.write.mode("overwrite").json(f"{folder}/json")
    head = "\n".join(markdown_header(rows.columns))
    lines = markdown_rows(rows).coalesce(1)  # a report's table
    first = rows.sparkSession.createDataFrame([(head,)], "line string").coalesce(1)
    first.union(lines).coalesce(1).write.mode("overwrite").text(f"{folder}/md")


def admissible_pdfs(files: DataFrame) -> DataFrame:
    """Adds sha256 and admitted to binary files (path, length, content): size cap and magic bytes."""
    magic = F.substring("content", 1, 5) == F.lit(PDF_MAGIC)
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("admitted", (F.col("length") <= PDF_MAX_BYTES) & magic)


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) of text files whose pages end with, or are parted by, form feeds: the adapter between PDF tools and the engine.

    A page is a line of the text reader, so a long file is read in splits and never whole; pages are numbered from 1 in
    their file by the number of pages of each split, which is all that reaches the driver. A file without a character has no page.
    """
    raw = spark.read.text(path, lineSep="\f").select("value", *_split())
    first, at = {}, ("", 0)
    for f, b, k in sorted(tuple(r) for r in raw.groupBy("_f", "_b").count().collect()):  # a row a split
        at = at if at[0] == f else (f, 1)
        first[f, b] = at[1]
        at = (f, at[1] + k)
    told = raw.select("_f", "_b", "value").mapInArrow(_number(first), "file string, offset bigint, value string")
    return told.select(F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "([^/]*)$", 1).alias("doc"), F.col("offset").cast("int").alias("page"), F.col("value").alias("text"))
