"""Tables kept as numbered snapshots: writers never block readers, and no change is lost.

A folder holds ``data/<id>`` (rows, written by the executors), ``versions/<number>.json``
(what a version holds) and ``latest`` (a hint). A version is published by creating its
file only if it is absent, with its content, so of two writers on one base one wins and
the other applies its change to the new base again. A reader pins a version; its
rows stay until ``vacuum``. Only names and counts pass through the driver.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Folder:
    """Small files of a folder in any store that Spark's Hadoop client reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.path = spark._jvm, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(folder).getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *names: str) -> str:
        return "/".join([self.path, *names])

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def files(self, name: str) -> list[str]:
        """Every file below a folder."""
        found, out = self.fs.listFiles(self._path(name), True), []
        while found.hasNext():
            out.append(found.next().getPath().toString())
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, content: str) -> None:
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()

    def replace(self, source: str, target: str) -> None:
        """Moves a file over another one, or to a new place, in one step."""
        self.fs.mkdirs(self._path(target).getParent())
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self._gateway_array(options.OVERWRITE)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(source), self._path(target), kinds)

    def _gateway_array(self, *values):
        from pyspark import SparkContext

        out = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    def create(self, name: str, content: str) -> bool:
        """Whether a file of this content was made; false if there is one already. A
        hard link decides on local disks; elsewhere a rename, which does not replace a file there."""
        mine = f"{name}.{uuid.uuid4().hex}"
        self.write(mine, content)
        try:
            if not self.local:
                return not self.exists(name) and self.fs.rename(self._path(mine), self._path(name))
            plain = [self.fs.makeQualified(self._path(n)).toUri().getPath() for n in (mine, name)]
            try:
                os.link(*plain)
            except FileExistsError:
                return False
            return True
        finally:
            self.delete(mine)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _version(number: int) -> str:
    return f"{number:020d}.json"


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the newest version, 0 where there is none."""
    f, number = Folder(spark, folder), 0
    with suppress(Py4JJavaError, ValueError):  # the hint may be missing or old
        number = int(f.read(f.at("latest")))
    if number and not f.exists(f.at("versions", _version(number))):
        number = 0
    if not number:
        number = max((int(n[:20]) for n in f.names(f.at("versions")) if len(n) == 25 and n[:20].isdigit()), default=0)
    while f.exists(f.at("versions", _version(number + 1))):
        number += 1
    return number


def read(spark: SparkSession, folder: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named; a folder without versions has no rows."""
    number = latest(spark, folder) if version is None else version
    if number == 0:
        return spark.createDataFrame([], schema)
    f = Folder(spark, folder)
    told = json.loads(f.read(f.at("versions", _version(number))))
    return spark.read.schema(schema).parquet(f.at("data", told["data"]))


def commit(spark: SparkSession, folder: str, schema: T.StructType, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> int:
    """Publishes ``change`` of the newest version's rows and returns the new version's number.

    ``change`` is called again if another writer was first, so it must depend on
    its argument alone. The rows it gives are cast to ``schema`` by name. A
    writer that dies leaves data that no version names.
    """
    f = Folder(spark, folder)
    for k in range(tries):
        base = latest(spark, folder)
        rows = change(read(spark, folder, schema, base))
        name = uuid.uuid4().hex
        rows.select(*[rows[x.name].cast(x.dataType).alias(x.name) for x in schema.fields]).write.parquet(f.at("data", name))
        told = {"version": base + 1, "base": base, "data": name, "at_ms": int(time.time() * 1000)}
        if f.create(f.at("versions", _version(base + 1)), json.dumps(told)):
            hint = f.at(f"latest.{name}")
            f.write(hint, str(base + 1))
            f.replace(hint, f.at("latest"))
            return base + 1
        f.delete(f.at("data", name))
        time.sleep(random.random() * min(2.0, 0.05 * 2**k))
    raise RuntimeError(f"{tries} other writers were first")


def vacuum(spark: SparkSession, folder: str, keep: int = 10, older_than: float = 86_400) -> list[int]:
    """Drops all but the newest ``keep`` versions, and data that no version names and
    that is older than ``older_than`` seconds (a writer may be at work on newer); returns the versions dropped."""
    f, newest = Folder(spark, folder), latest(spark, folder)
    every = {int(n[:20]): n for n in f.names(f.at("versions")) if len(n) == 25 and n[:20].isdigit()}
    dropped = sorted(n for n in every if n <= newest - keep)
    held = {json.loads(f.read(f.at("versions", name)))["data"] for n, name in every.items() if n not in dropped}
    for n in dropped:
        f.delete(f.at("versions", every[n]))
    before = (time.time() - older_than) * 1000
    for status in f.fs.listStatus(f._path(f.at("data"))) if f.exists(f.at("data")) else []:
        if status.getPath().getName() not in held and status.getModificationTime() < before:
            f.fs.delete(status.getPath(), True)
    return dropped
