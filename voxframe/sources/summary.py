"""A summary table that is replaced as a whole: staged versions and a log of commits.

A version is written to a folder of its own; it counts from the moment its row is in the commit log, a one-row append that
Spark's committer makes visible as one file. Whatever fails before that leaves the last version in place. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.registration import upsert_summary

COMMITS = "version long, folder string"


def _committed(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        last = spark.read.schema(COMMITS).parquet(f"{root}/commits").orderBy("version", ascending=False).limit(1).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return (last["version"], last["folder"]) if last else None


def stage(df: DataFrame, root: str) -> str:
    """Write a version that nobody sees yet; returns its folder below ``root``."""
    folder = f"versions/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def commit(spark: SparkSession, root: str, folder: str) -> None:
    last = _committed(spark, root)
    spark.createDataFrame([((last[0] if last else -1) + 1, folder)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def read_summary(spark: SparkSession, root: str) -> DataFrame | None:
    """The committed version, None before the first."""
    last = _committed(spark, root)
    return spark.read.parquet(f"{root}/{last[1]}") if last else None


def upsert_stored(spark: SparkSession, root: str, new: DataFrame, keys: Sequence[str], order: str = "row_order") -> DataFrame:
    """Replace the rows of the same keys in place, append the others behind the last row, and return the new version."""
    existing = read_summary(spark, root)
    commit(spark, root, stage(new if existing is None else upsert_summary(existing, new, keys, order), root))
    return read_summary(spark, root)
