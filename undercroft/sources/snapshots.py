"""Versions of a table that is replaced as a whole, and small files beside it.

  <table>/_versions/v000000007   one complete version, never changed once it has this name
The highest version is the table. A new one is written under a name that readers do not see and gets its own by one
rename, which fails if another writer was first. Readers choose a version once and go on reading it: the versions
before the newest stay for a while. A table without versions is its folder, as written by a plain load.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

VERSIONS = "_versions"
#: Versions kept behind the newest, for readers that started with them.
KEEP = 2


class ReplacedByAnother(RuntimeError):
    """Another writer has replaced the table since this one looked at it."""


def folder(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a folder, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, target = folder(spark, path)
    fs.delete(target, True)


def rename_once(spark: SparkSession, source: str, target: str) -> None:
    """Gives a finished file or folder its name; fails if the name is taken, also by a writer at the same time."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, old = folder(spark, source)
    _, new = folder(spark, target)
    kind = getattr(hadoop, "Options$Rename")
    never = spark._sc._gateway.new_array(kind, 1)
    never[0] = kind.NONE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(old), fs.makeQualified(new), never)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            raise ReplacedByAnother(target) from error
        if "UnsupportedFileSystem" not in str(error.java_exception):
            raise
        # File systems that know only the older interface.
        if fs.exists(new):
            raise ReplacedByAnother(target) from error
        if not fs.rename(old, new):
            raise RuntimeError(f"{source} could not be renamed to {target}") from error


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; fails if it is there already."""
    draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
    fs, target = folder(spark, draft)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename_once(spark, draft, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = folder(spark, path)
    source = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _name(version: int) -> str:
    return f"v{version:09d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    names = child_names(spark, f"{path}/{VERSIONS}")
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current_root(spark: SparkSession, path: str) -> str:
    """The folder that holds the table now."""
    known = versions(spark, path)
    return f"{path}/{VERSIONS}/{_name(known[-1])}" if known else path


def publish(spark: SparkSession, path: str, write, base: int | None = None) -> int:
    """Makes what `write(folder)` writes the next version after `base` (the newest by default); returns its number."""
    if base is None:
        base = max(versions(spark, path), default=0)
    draft = f"{path}/{VERSIONS}/.draft-{uuid.uuid4().hex}"
    write(draft)
    try:
        rename_once(spark, draft, f"{path}/{VERSIONS}/{_name(base + 1)}")
    except ReplacedByAnother:
        delete(spark, draft)
        raise
    for old in versions(spark, path):
        if old < base + 1 - KEEP:
            delete(spark, f"{path}/{VERSIONS}/{_name(old)}")
    if base + 1 > KEEP:
        # What a plain load left is version 0.
        for name in child_names(spark, path):
            if name != VERSIONS:
                delete(spark, f"{path}/{name}")
    return base + 1
