"""Writing intermediate tables that several later steps read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    A session that names none, as in tests, gets a folder in its warehouse: like the tables there,
    it has to be shared wherever executors run on other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shelfmark-steps"


def materialize(df: DataFrame, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Later steps read only the columns they need, know the size of what they read, and start from
    the files when an executor is lost, not from the beginning of the job. `keep`: the table stays
    where `tables_removed` removes others.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/shelfmark-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for paths in [] if keep else _open:
        paths.append(path)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that `materialize` writes inside, at the end of the block.

    A frame made inside reads them when it is used, so write its result before the block ends. Gives
    the list of the tables' paths. Blocks may stand inside each other.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open[:] = [p for p in _open if p is not paths]
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a finished write are not kept: the table it wrote takes their place."""
    # Asked for without a default of its own, a setting that nobody set would come back as none.
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)
