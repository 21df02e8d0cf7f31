"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets one of its own;
    on a cluster that is an error, as a local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def run_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import the package from here, as the driver does.

    A cluster has it installed or listed in ``spark.submit.pyFiles`` instead; there the path is without effect.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def wrapped(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unwrapped(columns: list[str], name: str = "row") -> list[Column]:
    """The columns of such a struct."""
    return [F.col(name)[c].alias(c) for c in columns]


class Rounds:
    """Tables that a loop makes from each other: Parquet files in the shared folder, deleted at the end of the ``with`` block.

    A checkpoint keeps what the optimiser knows of its columns, which multiplies from
    round to round; a table that is written and read again starts afresh.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, run_path(spark, "rounds"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
