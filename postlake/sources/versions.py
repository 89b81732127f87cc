"""Versions of a stored table: data folders that never change, and a small list of those that count.

A writer puts its rows into a fresh folder and then adds the next list. A list is moved into place in one step and never
over another one, so a reader sees the old version or the new one, a writer that dies leaves the old one, and of two
writers at once the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Lists beside the newest one that are kept, with their data, for readers that have begun.
KEEP = 3
#: Name of the folders of rows; a reader of several sees it as a column.
PART = "postlake_part"


class VersionExists(RuntimeError):
    """Another writer has added this version."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)


def _read(spark: SparkSession, path: str, number: int) -> dict:
    fs, name = _fs(spark, f"{path}/_versions/{number:010d}.json")
    stream = fs.open(name)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, path: str, fits: Callable[[dict], bool] = lambda _: True) -> dict | None:
    """The newest list that fits, or None."""
    for number in _numbers(spark, path):
        found = _read(spark, path, number)
        if fits(found):
            return found
    return None


def data_folder() -> str:
    """A fresh name for the rows of a version; relative, so that a table may be moved."""
    return f"data/{PART}={uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, listed: dict) -> None:
    """Make ``listed`` the newest version; its ``version`` has to be the next number and ``folders`` what it needs."""
    made = f"{path}/_versions/.{uuid.uuid4().hex}.tmp"
    fs, temporary = _fs(spark, made)
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{listed['version']:010d}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    _move(spark, fs, temporary, final, listed["version"])
    _clean(spark, path, listed["version"])


def _move(spark: SparkSession, fs, source, target, number: int) -> None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    exists = fs.exists(target)
    if not exists:
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(source, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return
        except Py4JJavaError as error:
            kind = error.java_exception.getClass().getSimpleName()
            if kind == "UnsupportedFileSystemException" and fs.rename(source, target):
                return
            if kind not in ("FileAlreadyExistsException", "UnsupportedFileSystemException"):
                raise
    fs.delete(source, False)
    raise VersionExists(f"version {number} is there already")


def _clean(spark: SparkSession, path: str, newest: int) -> None:
    """Drop lists behind the kept ones and folders that only they name."""
    fs, _ = _fs(spark, path)
    numbers = _numbers(spark, path)
    old = [n for n in numbers if n < newest - KEEP]
    if not old:
        return
    needed = {f for n in numbers if n >= newest - KEEP for f in _read(spark, path, n)["folders"]}
    gone = {f for n in old for f in _read(spark, path, n)["folders"]} - needed
    for folder in gone:
        fs.delete(_fs(spark, f"{path}/{folder}")[1], True)
    for n in old:
        fs.delete(_fs(spark, f"{path}/_versions/{n:010d}.json")[1], False)
