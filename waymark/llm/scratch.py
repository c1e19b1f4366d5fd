"""Shared storage for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder
    is made and set; a cluster must name a folder that all its machines share.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    path = "file://" + tempfile.mkdtemp(prefix="waymark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query that ends in a written table needs its shuffle files no more: they go with the query, not when the driver's heap is next swept."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    The written table survives lost executors and stops recomputation. It stays
    until the owner of the shared folder removes it, as with reliable checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark/{uuid.uuid4().hex}/{name}"
    with _dropping_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
