"""Session settings the package relies on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the plans count on; safe on any session.

    Wide rows stay outside whole-stage code (default limit of 100 fields): measured on the feature table,
    raising that limit doubles the run time, because the generated methods grow too long to be compiled.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Tables stored by region join on region and day, and are windowed, where they lie.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else a folder in the session's warehouse.

    One rule for every master. The default is deleted by Hadoop's file system when the application ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not current:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints/{context.applicationId}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        current = path.toString()
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), "isohyet", spark.sparkContext.applicationId, uuid.uuid4().hex, name])


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Used where several branches read the same intermediate result: the scan is columnar, the lineage
    is cut, and the files outlive executors. `options` are those of the parquet writer.
    """
    return written(df, name, **options)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same for a step inside an operator, whose result is stored once more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def materialize_by(df: DataFrame, name: str, key: str, order: Sequence[str], parts: int) -> DataFrame:
    """Write a table in `parts` buckets of `key`, each sorted by `order`, and read it back.

    `df` comes in so many partitions of that key, so a task writes one bucket. The files lie in the shared folder; the
    session's catalog holds their name, which readers need to know the buckets.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"isohyet_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).sortBy(*order).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)
