"""Registration of the catalog queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; doubles of the result are rounded by the query itself."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (and turn -0.0 into 0.0) for comparison."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType):
            columns.append((F.round(F.col(field.name), digits) + F.lit(0.0)).alias(field.name))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            columns.append(F.col(field.name).cast("long").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)
