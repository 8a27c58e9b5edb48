"""Tables that are replaced as a whole, version by version, so that readers always see exactly one of them.

A version is a folder of Parquet files that is written once and never changed, and a manifest, a small file that names it. Versions
are numbered; a manifest is moved into its place only if there is none yet, which the file system decides. So of two writers of one
version one wins, and the other is told. A reader takes the manifest with the highest number; folders without a manifest, left by
jobs that died, are never read.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer published since the version this one was made from."""


class Version(NamedTuple):
    number: int
    batch: str
    folder: str


class _Files:
    """The few calls of the cluster's file system that are needed, on whatever store ``root`` names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [status.getPath().getName() for status in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_if_absent(self, file: str, text: str) -> bool:
        """Writes the whole file beside its place and moves it there; False if the place is taken."""
        made = self.path(f"{file}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(made, False)
        stream.write(text.encode())
        stream.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self.context.rename(made, self.path(file), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self.fs.delete(made, False)
            return False
        return True


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All published versions, the latest last."""
    files = _Files(spark, root)
    numbers = sorted(int(name[:-5]) for name in files.names(f"{root}/manifests") if name.endswith(".json"))
    found = [json.loads(files.read(f"{root}/manifests/{number:012d}.json")) for number in numbers]
    return [Version(number, entry["batch"], entry["folder"]) for number, entry in zip(numbers, found, strict=True)]


def publish(df: DataFrame, root: str, batch: str, made_from: int | None = None) -> int:
    """Publishes the rows of ``df`` as the next version of the table and returns its number.

    A ``batch`` that was published before is not published again: its number comes back and nothing is written. ``made_from`` is the
    version the rows were worked out from (0: none); if another one has come since, :class:`Conflict` is raised and readers see nothing.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    for version in known:
        if version.batch == batch:
            return version.number
    latest = known[-1].number if known else 0
    if made_from is not None and made_from != latest:
        raise Conflict(f"made from version {made_from}, but {latest} is the latest of {root}")
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    files, number = _Files(spark, root), latest + 1
    files.fs.mkdirs(files.path(f"{root}/manifests"))
    while not files.put_if_absent(f"{root}/manifests/{number:012d}.json", json.dumps({"batch": batch, "folder": folder})):
        taken = versions(spark, root)
        again = [v.number for v in taken if v.batch == batch]
        if again:
            return again[0]
        if made_from is not None:
            raise Conflict(f"version {number} of {root} was published meanwhile")
        number = taken[-1].number + 1
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the latest unless a number is given. The frame keeps reading that version, whatever is published later."""
    known = {v.number: v for v in versions(spark, root)}
    if not known:
        raise FileNotFoundError(f"{root} has no version")
    return spark.read.parquet(f"{root}/{known[max(known) if number is None else number].folder}")
