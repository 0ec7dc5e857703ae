"""Raw acquisition files: inventory, path keys, two-channel CSV scan and per-file inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.sources.listing import listed

#: Channel names, the size beyond which inspection reports a file unread, and the condition folder pattern of the raw dataset.
CHANNELS = ("Horizontal_vibration_signals", "Vertical_vibration_signals")
MAX_FILE_BYTES = 16 * 1024 * 1024
CONDITION_PATTERN = r"([0-9.]+)Hz([0-9.]+)kN"


def inventory(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Every file with its size and modification time, empty ones included; contents are never read."""
    return listed(spark, root, pattern)


def file_number(stem: Column) -> Column:
    """Numeric file index, NULL for non-digits, zero, leading zeros or values beyond BIGINT."""
    return F.when(stem.rlike(r"^[1-9][0-9]{0,18}$"), stem.try_cast("bigint"))


def path_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Add condition folder, unit folder and acquisition number taken from `<condition>/<unit>/<n>.csv`."""
    parts = F.split(F.col(path), "/")
    stem = F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]+$", 1)
    return df.withColumns(
        {
            "condition": F.element_at(parts, -3),
            "unit": F.element_at(parts, -2),
            "acquisition_number": file_number(stem),
        }
    )


def sample_schema(channels: Sequence[str] = CHANNELS) -> T.StructType:
    fields = [T.StructField(c, T.FloatType()) for c in channels]
    return T.StructType([*fields, T.StructField("_corrupt", T.StringType())])


def samples(spark: SparkSession, root: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One row per sample with its file path; a malformed line keeps its text in `_corrupt`."""
    return (
        spark.read.schema(sample_schema(channels)).option("header", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
        .option("columnNameOfCorruptRecord", "_corrupt").option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf")
        .csv(root)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def _lines(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Whole files as lines, split inside the task that reads them; `most` leaves out files with more bytes."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    if most is not None:
        small = small.where(F.col("length") <= most)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return small.select("path", "length", F.split(F.regexp_replace(text, "\n$", ""), "\n").alias("lines"))


def signals_from_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per acquisition of any size with both channels as FLOAT arrays; the header line is skipped."""
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    pairs = F.transform(body, lambda line: F.split(line, ","))
    return path_keys(_lines(spark, root)).select(
        "path", "condition", "unit", "acquisition_number", "length",
        F.transform(pairs, lambda p: p[0].cast("float")).alias("horizontal"),
        F.transform(pairs, lambda p: p[1].cast("float")).alias("vertical"),
    )


def inspect_files(spark: SparkSession, root: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Header, channel count, sample count, NaN and Inf counts or the parse error of every file.

    Oversized files are reported from the inventory alone. One bad file only marks its own row.
    """
    files = inventory(spark, root)
    width = len(channels)
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    cells = F.flatten(F.transform(body, lambda line: F.split(line, ",")))
    read = _lines(spark, root, MAX_FILE_BYTES).select(
        "path",
        F.transform(F.split(F.element_at("lines", 1), ","), lambda h: F.trim(h)).alias("header"),
        F.size(body).alias("_rows"),
        F.exists(body, lambda line: F.trim(line) == "").alias("_blank"),
        F.exists(body, lambda line: F.size(F.split(line, ",")) != width).alias("_ragged"),
        F.transform(cells, lambda c: F.trim(c).try_cast("float")).alias("_cells"),
    )
    bad_value = F.exists("_cells", lambda v: v.isNull())
    error = (
        F.when(F.col("length") > MAX_FILE_BYTES, "file_too_large")
        .when((F.col("length") == 0) | F.col("_rows").isNull(), "empty_file")
        .when(F.col("_rows") == 0, "no_samples")
        .when(F.col("_blank"), "blank_line")
        .when(F.col("_ragged"), "ragged_row")
        .when(bad_value, "non_numeric_value")
    )
    clean = F.col("parse_error").isNull()
    return (
        files.join(read, "path", "left")
        .withColumn("parse_error", error)
        .select(
            "path",
            F.col("length").alias("file_size_bytes"),
            "header",
            F.size("header").alias("channel_count"),
            F.when(clean, F.col("_rows").cast("bigint")).otherwise(F.lit(0)).alias("sample_count"),
            F.when(clean, F.size(F.filter("_cells", lambda v: F.isnan(v)))).otherwise(0).alias("nan_count"),
            F.when(clean, F.size(F.filter("_cells", lambda v: F.abs(v) == float("inf")))).otherwise(0).alias("infinite_count"),
            "parse_error",
        )
    )


def json_manifest(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """Rows of a nested JSON manifest: the array of structs under `rows`, exploded."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(rows))


def folds_from_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Fold plan stored as `{"folds": [{"fold": n, "train": [...], "validation": [...], "test": [...]}]}`."""
    schema = "folds array<struct<fold:int,train:array<string>,validation:array<string>,test:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path).select(F.inline("folds"))
    return raw.unpivot(["fold"], ["train", "validation", "test"], "subset", "units").select("fold", "subset", F.explode("units").alias("unit_id"))
