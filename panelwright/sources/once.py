"""Things that happen once, whoever tries: small files that are put only where none is.

Whole content appears at one moment: it is written under a hidden name and then published under its own, by a hard link on a local file
system and by a rename elsewhere. The file system must not rename over an existing file (HDFS does not).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a file with this text, or leave the one that is there; True for the one caller who published it."""
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        return False
    _, hidden = _file_system(spark, f"{path.rpartition('/')[0]}/_new-{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(hidden, target)
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        spark._jvm.java.nio.file.Files.createLink(local(target), local(hidden))
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(hidden):
            fs.delete(hidden, False)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the published files of a folder, in order; none if there is no such folder."""
    fs, top = _file_system(spark, folder)
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    file = fs.open(target)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def reserve_ids(spark: SparkSession, folder: str, n: int, behind: int = 0) -> int:
    """The first of n numbers that no other caller gets: one block, behind all blocks reserved so far and behind the number stated."""
    while True:
        taken = names_in(spark, folder)
        first = behind + 1
        if taken:
            first = max(first, int(taken[-1]) + int(read_text(spark, f"{folder}/{taken[-1]}")))
        if put_if_absent(spark, f"{folder}/{first:020d}", str(n)):
            return first
