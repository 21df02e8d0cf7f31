"""Small files and folders in whatever store the cluster's paths name, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """(file system, path)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what lies in ``path``; nothing if it does not exist."""
    fs, p = at(spark, path)
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Rename, where nothing has the new name yet; whether it was done."""
    fs, p = at(spark, path)
    return fs.rename(p, at(spark, to)[1])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = at(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
        return "\n".join(lines)
    finally:
        reader.close()
