"""Files of many runs: patch names, transform parameters, manifests and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..operators.filters import require_nonempty

# Grammar of patch file names, and of parameter lines.
PATCH_NAME = r"(?i)(?:^|/)patch_(\d+)_z(\d+)-(\d+)_y(\d+)-(\d+)_x(\d+)-(\d+)\.nii(?:\.gz)?$"
PARAMETER_LINE = r"^\s*\(\s*(\S+)\s+(.*?)\s*\)\s*$"
BOX = ("patch_index", "z0", "z1", "y0", "y1", "x0", "x1")


def list_patches(names: DataFrame, column: str = "name") -> DataFrame:
    """Patch boxes from file names; names that do not follow the grammar are skipped, and it is an error if all are."""
    parsed = require_nonempty(names.where(F.col(column).rlike(PATCH_NAME)), "the list of patch files")
    return parsed.select(*[c for c in names.columns], *[
        F.regexp_extract(column, PATCH_NAME, n + 1).cast("long").alias(c) for n, c in enumerate(BOX)])


def patch_file_name(df: DataFrame, into: str = "name") -> DataFrame:
    return df.withColumn(into, F.format_string("patch_%06d_z%d-%d_y%d-%d_x%d-%d.nii.gz", *BOX))


def patch_shape_mismatches(patches: DataFrame, shapes: DataFrame) -> DataFrame:
    """Patches whose stored shape (``nx, ny, nz``) differs from their name."""
    joined = patches.join(shapes, ["volume_id", "patch_index"])
    return joined.where("nx <> x1 - x0 or ny <> y1 - y0 or nz <> z1 - z0").select("volume_id", "patch_index")


def parse_parameters(lines: DataFrame) -> DataFrame:
    """``file, line_no, text`` to one map per file; malformed lines are skipped and later keys win."""
    pairs = lines.where(F.col("text").rlike(PARAMETER_LINE)).select(
        "file", "line_no", F.regexp_extract("text", PARAMETER_LINE, 1).alias("key"),
        F.regexp_extract("text", PARAMETER_LINE, 2).alias("value"))
    last = pairs.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))
    # a parameter file has some dozens of keys
    return last.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("params"))


def read_transform_params(spark: SparkSession, pattern: str) -> DataFrame:
    """Parameter maps of many small files, with the chain step taken from the number in the file name."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
    return parse_parameters(lines).withColumn("step", F.regexp_extract("file", r"\.(\d+)\.txt$", 1).try_cast("long"))


def read_manifests(spark: SparkSession, pattern: str, required: str, schema: str) -> DataFrame:
    """Run manifests; a file without the required path is an error, relative paths are resolved against its folder."""
    raw = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("manifest", F.col("_metadata.file_path"))
    folder = F.regexp_replace("manifest", r"/[^/]*$", "")
    value = F.when(F.col(required).isNull(), F.raise_error(F.concat(F.lit(f"no {required} in "), F.col("manifest"))).cast("string")).otherwise(F.col(required))
    resolved = F.when(value.rlike("^(/|[a-z0-9]+:/)"), value).otherwise(F.concat(folder, F.lit("/"), value))
    return raw.withColumn(f"{required}_resolved", resolved)


def scan_run_metrics(spark: SparkSession, root: str, csv_name: str, schema: str) -> DataFrame:
    """All ``<root>/<run>/QC/<csv_name>`` tables with the run as ``experiment``; runs without it are skipped."""
    try:
        rows = spark.read.schema(schema).option("header", True).csv(f"{root}/*/QC/{csv_name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
        return rows.withColumn("experiment", F.lit("")).drop("_file")
    return rows.withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/QC/", 1))
