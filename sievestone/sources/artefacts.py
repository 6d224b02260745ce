"""What a run leaves behind: versioned folders of a JSON description, tables and reports, on any file system that Spark knows.

A version is written once.  Its number is claimed by creating a file that isn't there yet, which only one of several savers can
do; its description comes last and by a rename, so a folder without one isn't a version.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

META, CLAIM = "meta.json", "_claim"


class ArtefactError(RuntimeError):
    """A version that isn't there, is there already, or doesn't fit; `code` tells which."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place, then renamed."""
    at, fs = _fs(spark, path)
    beside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")[0]
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} can't be put in place")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, null where there is none."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; nothing where there is none."""
    at, fs = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; whether it is this call that did, which is so for exactly one of several at once."""
    at, fs = _fs(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":  # there the file system looks first and creates then, but the machine's own call is one step
        return spark.sparkContext._jvm.java.io.File(at.toUri().getPath()).createNewFile()
    try:
        fs.create(at, False).close()
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    return True


class Shelf:
    """Small named texts in a folder of any file system that Spark knows, for records that several drivers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def names(self) -> list[str]:
        return names(self.spark, self.folder)

    def read(self, name: str) -> str:
        text = read_text(self.spark, f"{self.folder}/{name}")
        if text is None:
            raise OSError(f"no {name}")
        return text

    def write(self, name: str, text: str) -> None:
        write_text(self.spark, f"{self.folder}/{name}", text)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True))


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def save(spark: SparkSession, folder: str, kind: str, version: str | None, meta: dict, tables: dict[str, DataFrame] | None = None, reports: dict | None = None) -> str:
    """The folder of a new version, by default of the next number: tables as Parquet, reports as text, then the description.

    A report may be a function of the version.  Savers that come at once get a version each; a version that is taken is refused.
    """
    while True:
        name = version or next_version(names(spark, f"{folder}/{kind}"))
        path = f"{folder}/{kind}/{name}"
        if claim(spark, f"{path}/{CLAIM}"):
            break
        if version:
            raise ArtefactError("INVALID_REQUEST", f"{kind} has a version {version} already")
    for t, table in (tables or {}).items():
        table.write.mode("overwrite").parquet(f"{path}/{t}")
    for r, text in (reports or {}).items():
        write_text(spark, f"{path}/{r}", text(name) if callable(text) else text)
    write_json(spark, f"{path}/{META}", {**meta, "kind": kind, "version": name})
    return path


def versions(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """The whole versions of a kind in the order in which they were saved."""
    found = []
    for v in names(spark, f"{folder}/{kind}"):
        at, fs = _fs(spark, f"{folder}/{kind}/{v}/{META}")
        if fs.exists(at):
            found.append((fs.getFileStatus(at).getModificationTime(), [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", v)], v))
    return [v for *_, v in sorted(found)]


def load(spark: SparkSession, folder: str, kind: str, version: str | None = None, **needs) -> tuple[dict, str]:
    """(description, folder) of a version, or of the one saved last; what `needs` names must be as it says."""
    known = versions(spark, folder, kind)
    if not known or (version or known[-1]) not in known:
        raise ArtefactError("MODEL_NOT_FOUND", f"{kind} has no version {version}" if version else f"{kind} has no version")
    path = f"{folder}/{kind}/{version or known[-1]}"
    meta = read_json(spark, f"{path}/{META}")
    if meta is None:
        raise ArtefactError("MODEL_NOT_FOUND", f"{path} isn't whole")
    for name, value in needs.items():
        if meta.get(name) != value:
            raise ArtefactError("VERSION_MISMATCH", f"{name} is {meta.get(name)}, not {value}")
    return meta, path


def tables_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def digest(spark: SparkSession, path: str, kind: str = "SHA-256") -> str:
    """The hex digest of a file's bytes, read as a stream in constant memory, whatever the file's size."""
    jvm = spark.sparkContext._jvm
    at, fs = _fs(spark, path)
    told = jvm.java.security.MessageDigest.getInstance(kind)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(at), jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), told), 1 << 16, True)
    return bytes(told.digest()).hex()


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that end in a line feed, and what follows the last one if it isn't empty; counted by splits of the file."""
    return spark.read.option("lineSep", "\n").text(path).count()


def file_facts(spark: SparkSession, path: str) -> tuple[int, str]:
    """(lines, SHA-256) of a file of any size."""
    return line_count(spark, path), digest(spark, path)


def next_version(known: list[str], prefix: str = "v") -> str:
    """One more than the highest version of the form prefix and a number."""
    numbers = [int(m[1]) for v in known if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", v))]
    return f"{prefix}{max(numbers, default=0) + 1}"
