"""Tables that several later plans read, written once."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame

from ..streaming.state import shared_folder
from .snapshots import Folder


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and reread, so that no later plan computes them again; deleted when the driver ends."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the gateway may be gone at exit
            if spark.sparkContext._jsc is not None:
                Folder(spark, path).delete(path)

    atexit.register(clear)
    return spark.read.schema(rows.schema).parquet(path)
