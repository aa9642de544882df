"""Shared scratch space: lineage cuts and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may fall back to a folder of its own;
    on a cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="paperloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared scratch root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` as a table under the scratch root and read it back.

    Later plans start from files that survive a lost executor.  Unlike the
    rows of ``checkpoint()`` a table is columnar: a branch that needs two
    columns reads two, and its size is known when joins are planned.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_shuffle_kept(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files; otherwise these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean_cut(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for texts: smaller files, no shuffle files are kept."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with no_shuffle_kept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Remove the table that ``cut`` made; nothing that reads it may run any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
