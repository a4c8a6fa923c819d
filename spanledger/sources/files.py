"""Small file work through the file system that holds a path, wherever that is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file; nothing happens where there is none."""
    files, target = _at(spark, path)
    files.delete(target, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder within one file system; its new parent is made where needed."""
    files, source = _at(spark, old)
    _, target = _at(spark, new)
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"cannot move {old} to {new}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, target = _at(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a file, None where there is none."""
    files, target = _at(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
