"""Cutting lineage in the folder that all nodes share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset one of our own,
    in local mode only: the nodes of a cluster share no local folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
    return tempfile.mkdtemp(prefix="sightline-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
