"""Versions of a small table, one commit file each.

A version is a Parquet folder, written whole under a name of its own, and then
named by a commit file that must not exist yet.  A reader sees the highest
committed version or an older one, never half of one; a write that fails
leaves no commit; of two writers of one version only one gets the file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed what this one wanted to change."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, where = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _path(spark, path)
    got = fs.open(where)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not exist yet; False if it does."""
    fs, where = _path(spark, path)
    if fs.exists(where):
        return False
    # The content is there before the name is: a file of its own takes the name, and a second one cannot.
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(
            spark._jvm.org.apache.hadoop.fs.Path(fs.makeQualified(made).toString()), fs.makeQualified(where), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:  # noqa: BLE001  told apart below
        fs.delete(made, False)
        if "FileAlreadyExistsException" in str(e) or fs.exists(where):
            return False
        raise


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    info: dict


class Snapshots:
    """The versions under ``path``: ``commits/<number>`` names a folder of ``versions`` and holds small facts beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> Version | None:
        numbers = [int(n) for n in names_in(self.spark, f"{self.path}/commits") if n.isdigit()]
        return self.version(max(numbers)) if numbers else None

    def version(self, number: int) -> Version:
        info = json.loads(read_text(self.spark, f"{self.path}/commits/{number:010d}"))
        return Version(number, f"{self.path}/versions/{info['folder']}", info)

    def read(self, version: Version, name: str = "rows") -> DataFrame | None:
        """A table of the version; None if the version has none of that name."""
        try:
            return self.spark.read.parquet(f"{version.folder}/{name}")
        except AnalysisException:
            return None

    def commit(self, after: Version | None, tables: dict[str, DataFrame], info: dict) -> Version:
        """The version that follows ``after``; ``Conflict`` if there is one already."""
        number = after.number + 1 if after else 1
        folder = f"{number:010d}-{uuid.uuid4().hex[:12]}"
        for name, rows in tables.items():
            rows.write.parquet(f"{self.path}/versions/{folder}/{name}")
        if not create_text(self.spark, f"{self.path}/commits/{number:010d}", json.dumps(info | {"folder": folder})):
            remove(self.spark, f"{self.path}/versions/{folder}")
            raise Conflict(f"version {number} of {self.path} is there already")
        return Version(number, f"{self.path}/versions/{folder}", info | {"folder": folder})

    def forget(self, keep: int) -> None:
        """Remove all but the last ``keep`` versions."""
        numbers = sorted(int(n) for n in names_in(self.spark, f"{self.path}/commits") if n.isdigit())
        for number in numbers[:-keep]:
            old = self.version(number)
            remove(self.spark, f"{self.path}/commits/{number:010d}")
            remove(self.spark, old.folder)
