"""Queries op1 to op13 over the synthetic tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, license_scan, prefix_trie, quality_rules, url_filters, warc
from .common import Shelf, dealt
from .decontamination import find_overlaps
from .packing import pack
from .simhash import near_duplicates
from .substring_rlz import dedup_substrings
from .suffix_doubling import dedup_bytes
from .token_counts import count_tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir, "doc_id", "text")).drop("clean_text")


def op3_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.responses(dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    out = warc.derive(records, carry=("page_id",))
    return out.select(
        "page_id", "record_id", "type", "target_uri", "date", "refers_to", "content_type", F.col("payload").cast("string").alias("block"), "payload_digest", "block_digest"
    )


def op5_suffix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_documents(spark, sf_dir, "doc_id", "text", "source"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_overlaps(_documents(spark, sf_dir, "doc_id", "text"), benchmark)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir, "doc_id", "text"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = Shelf(spark).keep(prefix_trie.sequences(turns))
    heads = own.select(F.col("conv_id").alias("_base"), F.slice("steps", 1, 8).alias("_head"))
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    head = F.slice(F.coalesce("_head", F.slice("steps", 1, 0)), F.lit(1), h.cast("int"))
    steps = F.concat(head, F.slice("steps", h.cast("int") + 1, F.size("steps")))
    regrown = own.join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_base"), "left").select("conv_id", steps.alias("steps"))
    return prefix_trie.prefix_trie(regrown)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(_documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir, "lang", "text"), top=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_substring_rlz,
        op4_warc_derivatives,
        op5_suffix_doubling,
        op6_packing,
        op7_spaced_seeds,
        op8_simhash,
        op9_license_scan,
        op10_url_filters,
        op11_prefix_trie,
        op12_byte_bpe,
        op13_collocations,
    )
}
#: The others are tested against brute force, as SQL has no tokenizer, XXH64 or
#: closure over fingerprints, or is too slow on whole tables.
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op4_warc_derivatives": warc.SQL,
    "op9_license_scan": license_scan.SQL,
    "op10_url_filters": url_filters.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_collocations": collocations.SQL,
}
