"""Sources verified again by markers, digests and page counts; deletion of what a workspace owns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of markers, about, that one automaton holds.
BLOCK = 1 << 24


def packed(text: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def markers_in(texts: DataFrame, markers: DataFrame, *, id_col: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, marker): which distinct markers stand in each text, white space aside.

    ``markers``: marker. All markers are found in one pass over a text by an automaton; many markers make
    several automata of about ``block`` characters, and the texts pass through each. A null text holds none, a
    marker without characters stands in every text. Rows of one id count together.
    """
    known = markers.select("marker", packed(F.col("marker")).alias("m")).where("marker IS NOT NULL").distinct()
    size = known.agg(F.sum(F.length("m") + 1)).first()[0] or 0
    blocks = -(-size // block) or 1
    out = None
    spark = texts.sparkSession
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("m"), F.lit(blocks)) == k)
        words = spark.sparkContext.broadcast([r.m for r in part.select("m").distinct().collect()])  # of a bounded size

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            tree = ahocorasick.Automaton()
            for w in words.value:
                if w:
                    tree.add_word(w, w)
            tree.make_automaton()
            always = [w for w in words.value if not w]
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column("t").to_pylist()):
                    found = {w for _, w in tree.iter(text)} if len(tree) else set()
                    at += [i] * (len(found) + len(always))
                    hits += [*found, *always]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], names=["id", "m"])

        given = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), packed(F.col(text_col)).alias("t"))
        found = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, m string").join(part, "m").select("id", "marker").distinct()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def verify_sources(sources: DataFrame, markers: DataFrame, *, id_col: str, block: int = BLOCK) -> DataFrame:
    """Whether each source is what it was registered as, and why not.

    ``sources``: id, sha256, pages, registered_sha256, registered_pages, and two texts by independent readers, text_a
    and text_b. ``markers``: id, marker, of which each must stand in both texts. Returns the id, digest_ok, pages_ok,
    markers, in_a, in_b, verified and reason, the first gate that failed. A source without markers is verified by the
    others. A null digest or page count, on either side, fails.
    """
    wanted = markers.select(id_col, "marker").where("marker IS NOT NULL").distinct()
    held = [markers_in(sources, wanted, id_col=id_col, text_col=f"text_{x}", block=block).withColumn(f"_{x}", F.lit(1)) for x in "ab"]
    told = wanted
    for frame in held:
        told = told.join(frame, [id_col, "marker"], "left")
    counts = told.groupBy(id_col).agg(F.count(F.lit(1)).alias("markers"), F.count("_a").alias("in_a"), F.count("_b").alias("in_b"))
    joined = sources.select(id_col, *[(F.coalesce(F.col(c) == F.col(f"registered_{c}"), F.lit(False))).alias(n) for c, n in (("sha256", "digest_ok"), ("pages", "pages_ok"))]).join(counts, id_col, "left")
    for c in ("markers", "in_a", "in_b"):
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)))
    reason = (
        F.when(~F.col("digest_ok"), "digest").when(~F.col("pages_ok"), "pages").when(F.col("in_a") < F.col("markers"), "first text").when(F.col("in_b") < F.col("markers"), "second text")
    )
    return joined.withColumn("verified", reason.isNull()).withColumn("reason", reason)


def deletions(wanted: DataFrame, runs: DataFrame, workspace: str, running: DataFrame | None = None) -> DataFrame:
    """(run_id, outcome) of each distinct run asked to be deleted: deleted, missing, foreign or running.

    ``wanted``: run_id. ``runs``: run_id, workspace_id, where a null or empty workspace is the public one. ``running``:
    run_id, of jobs at work. A run of several records is foreign if one of them is.
    """
    mine = F.coalesce(F.nullif(F.col("workspace_id"), F.lit("")), F.lit("legacy-public")) == workspace
    owners = runs.groupBy("run_id").agg(F.bool_and(mine).alias("_mine"))
    told = wanted.select("run_id").distinct().join(owners, "run_id", "left")
    busy = told.sparkSession.createDataFrame([], "run_id string") if running is None else running.select("run_id").distinct()
    told = told.join(busy.withColumn("_busy", F.lit(True)), "run_id", "left")
    return told.select("run_id", F.when(F.col("_mine").isNull(), "missing").when(~F.col("_mine"), "foreign").when(F.col("_busy"), "running").otherwise("deleted").alias("outcome"))


def without(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows whose run was not deleted."""
    return rows.join(outcomes.where("outcome = 'deleted'").select("run_id"), "run_id", "left_anti")
