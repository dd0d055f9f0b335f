"""Files of a store through the file system that Spark sees: existence, atomic renames, small texts, states."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = _at(spark, where)
    return fs.exists(path)


def remove(spark: SparkSession, where: str) -> None:
    fs, path = _at(spark, where)
    fs.delete(path, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a place that must be free; all or nothing where the file system's renames are."""
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    if fs.exists(b):
        raise FileExistsError(f"{target} exists")
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def folders(spark: SparkSession, where: str) -> list[str]:
    """Names of what stands in a folder; none if it is missing."""
    fs, path = _at(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def write_text(spark: SparkSession, where: str, text: str) -> None:
    """A new small file that appears whole: written beside its place and moved there."""
    fs, path = _at(spark, where)
    aside = f"{where}.tmp"
    out = fs.create(_at(spark, aside)[1], True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(_at(spark, aside)[1], path):
        raise FileExistsError(f"{where} exists")


def read_text(spark: SparkSession, where: str) -> str | None:
    fs, path = _at(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def state(df: DataFrame) -> str:
    """A digest of the names, lengths and times of the files that df is read from; anything written anew changes it."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, path = _at(spark, name)
        s = fs.getFileStatus(path)
        parts.append(f"{name}\t{s.getLen()}\t{s.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only for a session in one process."""
    context = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallygrid-"))
        own = context.getCheckpointDir()
    return own.rstrip("/")
