"""Cutting lineage: relations that many rules share are written once, as Parquet, to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A temporary one only for a local master, where all tasks see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tickloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("paths of cut tables", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are cut inside; all are deleted if something fails there."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        yield paths
    except BaseException:
        if (spark := SparkSession.getActiveSession()) is not None:
            delete(spark, paths)
        raise
    finally:
        _made.reset(token)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, of which readers take only the columns and row groups they need. A lost executor costs
    a re-read."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/cut-{uuid.uuid4().hex}"
    if (paths := _made.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
