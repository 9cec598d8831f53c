"""Plumbing that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words in all contracts of this subpackage: blank, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"


class Shelf:
    """Tables written to the cluster's shared checkpoint folder, to cut lineage.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset and the master is local (tests) a temporary folder serves. ``keep`` writes and rereads,
    ``drop`` deletes a table that no later plan reads. What is still there when
    the driver ends is deleted then.
    """

    _fallback: str | None = None

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            Shelf._fallback = Shelf._fallback or "file://" + tempfile.mkdtemp(prefix="shelf-")
            base = Shelf._fallback
        self.base = f"{base.rstrip('/')}/shelf-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._clear)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def _clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.base)
            except Exception:  # noqa: BLE001  the gateway may be gone at exit
                return


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers are kept and may idle through other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def dealt(table: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than the session has cores, dealt out to all of them; others as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``d``, ``v``: a join key of 128 bits that tells rows apart by id (of any type, null too) and text.

    Rows with both the same id and the same text share a key; operators treat
    them alike.
    """
    who, text = [F.col(id_col).isNull(), F.col(id_col)], F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.lit(1), *who, text).alias("d"), F.xxhash64(F.lit(2), text, *who).alias("v")]


def _struct(df_cols: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in df_cols])


def squeezed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with the text as zstd bytes, so that a shuffle by document moves less."""
    names = docs.columns
    at = names.index(text_col)
    schema = _struct((f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            out = [None if t is None else press(t.encode()) for t in (x.as_py() for x in b.column(at))]
            cols = [pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return docs.mapInArrow(run, schema)


def unsqueeze(blob: bytes | None) -> bytes:
    """The UTF-8 bytes of a squeezed text; a null text is empty."""
    return b"" if blob is None else zstandard.ZstdDecompressor().decompress(blob)
