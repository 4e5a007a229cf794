"""Patch label files that arrive over time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import PATCH_LABELS

KEYS = ["volume_id", "patch_index"]
STORED = T.StructType([*PATCH_LABELS.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


VOXEL = [*KEYS, "i", "j", "k"]


BUCKETS = 256


def bucket_of(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def stream_patch_results(spark: SparkSession, incoming: str, store: str, checkpoint: str):
    """Keep every label voxel of every patch once, however often and in however many parts it is delivered.

    The store is partitioned by bucket of (volume, patch) and batch. A micro-batch reads back only the buckets that its
    patches fall into, at most BUCKETS numbers, and writes the voxels that no earlier batch holds; when it is retried
    after a failure its own partitions are replaced. The first delivery of a voxel counts; ``stored_counts`` reads the store.
    """
    arrivals = spark.readStream.schema(PATCH_LABELS).parquet(incoming)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy(*VOXEL).agg(F.min("local_label").alias("local_label")).withColumn("bucket", bucket_of(*KEYS))
        touched = [r["bucket"] for r in batch.select(bucket_of(*KEYS).alias("bucket")).distinct().collect()]
        known = _stored(batch.sparkSession, store)
        if known is not None:
            earlier = known.where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id))
            fresh = fresh.join(earlier.select(*VOXEL), VOXEL, "left_anti")
        (fresh.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch").parquet(store))

    return (arrivals.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """(volume, patch, label, voxels) of all that has arrived."""
    return label_counts(spark.read.schema(STORED).parquet(store))


def label_counts(patch_labels: DataFrame) -> DataFrame:
    """The batch equivalent."""
    return patch_labels.groupBy(*KEYS, "local_label").agg(F.count("*").alias("voxels"))
