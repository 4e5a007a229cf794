"""Reading the corpus tables and keeping intermediate tables, through Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES``, not by their number alone.

    A batch of texts is held several times over, in the executor's buffers and in the worker; at 10,000 rows that was tens of
    megabytes each. The setting stays, since it counts when the stage's result is written.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so it survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(stored: DataFrame) -> None:
    """Delete what ``store`` wrote and nothing reads any more."""
    hadoop = stored.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in {f.rpartition("/")[0] for f in stored.inputFiles()}:
        folder = hadoop(path)
        folder.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
