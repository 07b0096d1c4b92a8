"""A folder of tables with versions: what a version consists of stands in one small file, and
whoever writes the next one first has it."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share. A folder of our own only where none is set and all
    runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what it took to make it is done once,
    however many results are drawn from it."""
    at = f"{scratch(df.sparkSession)}/quernstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Conflict(Exception):
    """Another writer has made this version already."""


class Snapshots:
    """Versions 1, 2, ... of a folder, each a JSON file of what it consists of. A version is
    there whole or not at all, is never changed, and has one writer: its file is written aside
    and gets its name by a step that fails if the name is taken. The folder is on a local or
    mounted disk, or in a store whose renames are atomic."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.at}/_versions/{version:012d}.json"

    def version(self) -> int:
        """The last version; 0 if there is none."""
        folder = self._path(f"{self.at}/_versions")
        if not self._files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def read(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._files.open(self._path(self._name(version)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        version = self.version()
        return version, self.read(version)

    def commit(self, version: int, content: dict) -> None:
        """Makes this version, or raises Conflict."""
        aside = f"{self.at}/_versions/.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(aside), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if self._files.getScheme() == "file":  # whose renames replace what is there
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(aside), local(self._name(version)))
            except FileExistsError:
                raise Conflict(f"version {version} of {self.at}") from None
            finally:
                self._files.delete(self._path(aside), False)
        elif not self._files.rename(self._path(aside), self._path(self._name(version))):
            self._files.delete(self._path(aside), False)
            raise Conflict(f"version {version} of {self.at}")

    def update(self, change: Callable[[dict], dict]) -> dict:
        """Makes a version by a change to the last one; to the one after, if another writer was
        first. change() says what the new version consists of and may be asked several times."""
        while True:
            version, content = self.current()
            new = change(content)
            try:
                self.commit(version + 1, new)
                return new
            except Conflict:
                continue
