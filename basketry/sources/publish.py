"""Result tables and metrics as files, and reading them back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def publish_tables(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", partition_by: Mapping[str, str] | None = None
) -> list[str]:
    """Write every table to its own folder under ``root``; returns the folders."""
    folders = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        if fmt == "csv":
            writer = writer.option("header", True)
        folder = f"{root.rstrip('/')}/{name}"
        writer.format(fmt).save(folder)
        folders.append(folder)
    return folders


def publish_metrics(metrics: DataFrame, root: str, name: str = "metrics") -> str:
    """Write a one-row metrics frame as JSON."""
    folder = f"{root.rstrip('/')}/{name}"
    metrics.write.mode("overwrite").json(folder)
    return folder


def read_published(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A published table as input of a later job."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(f"{root.rstrip('/')}/{name}")
