"""Readers of feature tables, labels, configuration and requests, all through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.shared import exists

FEATURES = 52


def numbers(line: Column) -> Column:
    """The comma-separated tokens as doubles, null where one doesn't parse."""
    return F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("double"))


def feature_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """A headerless numeric CSV: row_id, x. A row of another width, or with a bad value, is an error."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = lines.select("row_id", numbers(F.col("value")).alias("x"))
    width = width or rows.select(F.size("x").alias("n")).first()["n"]
    bad = F.raise_error(F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(f" hasn't {width} numbers")))
    return rows.select("row_id", F.when((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull()), F.col("x")).otherwise(bad).alias("x"))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).where(F.trim("value") != "").select("row_id", F.trim("value").cast("int").alias("label"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id (from 0), value: the lines of a text file or folder in file order.

    One pass counts the lines of each split; row_id is the split's offset plus the place in it.
    """
    from pyspark.sql import Window as W

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    sizes = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    offsets = sizes.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row for each split
    return lines.join(F.broadcast(offsets), ["_f", "_b"]).select((F.col("_o") + F.col("_m") - F.col("_first")).alias("row_id"), "value")


def zip_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins by position; different numbers of rows are an error."""
    a, b = features.count(), labels.count()
    if a != b:
        raise ValueError(f"{a} rows of features and {b} labels")
    return features.join(labels, "row_id")


# Defaults of the run configuration.
CONFIG_DEFAULTS = {"holdout_class_ids": [0, 1, 6], "svm_class_ids": [2, 3, 4, 5]}


def run_config(lines: DataFrame) -> DataFrame:
    """value: lines key=value -> key, value, ids. Comments and blank lines go; lists of ints are parsed."""
    kept = lines.select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#') AND contains(line, '=')")
    parts = F.split("line", "=", 2)
    rows = kept.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    ids = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("int"))
    return rows.select("key", "value", F.when(F.endswith("key", F.lit("_ids")), F.filter(ids, lambda x: x.isNotNull())).alias("ids"))


def config_ids(lines: DataFrame, key: str, legacy: str | None = None) -> list[int]:
    """A list of ids by its key, else by its legacy key, else its default."""
    found = {r["key"]: r["ids"] for r in run_config(lines).where(F.col("key").isin(key, legacy or key)).collect()}
    return found.get(key) or found.get(legacy) or CONFIG_DEFAULTS.get(key, [])


def label_map(lines: DataFrame) -> DataFrame:
    """value: lines id:name -> class_id, name, holdout; the mark " [HOLDOUT]" is taken off the name."""
    parts = F.split(F.trim("value"), ":", 2)
    rows = lines.where(F.contains("value", F.lit(":"))).select(F.trim(parts[0]).try_cast("int").alias("class_id"), F.trim(parts[1]).alias("name"))
    return rows.where("class_id IS NOT NULL").select("class_id", F.trim(F.regexp_replace("name", r"\s*\[HOLDOUT\]", "")).alias("name"), F.contains("name", F.lit("[HOLDOUT]")).alias("holdout"))


def upload(lines: DataFrame, width: int = FEATURES) -> DataFrame:
    """An uploaded CSV, line_no and value: blank lines and a header go, rows are cut to width.

    The first line that isn't blank is a header unless its first five tokens (or fewer) all parse.
    Rows that are shorter, or hold a token that doesn't parse, go.
    """
    kept = lines.select("line_no", F.trim("value").alias("value")).where("value <> ''")
    first = kept.agg(F.min("line_no").alias("first"))
    rows = kept.crossJoin(F.broadcast(first)).select("line_no", "first", numbers(F.col("value")).alias("x"))  # one row
    header = (F.col("line_no") == F.col("first")) & F.exists(F.slice("x", 1, 5), lambda v: v.isNull())
    return rows.where(~header).select("line_no", F.slice("x", 1, width).alias("x")).where((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull()))


def json_features(requests: DataFrame) -> DataFrame:
    """body: JSON with features, one vector or several -> row_id (place in the request), x."""
    many = F.from_json(F.get_json_object("body", "$.features"), "array<array<double>>")
    one = F.from_json(F.get_json_object("body", "$.features"), "array<double>")
    flat = F.forall(one, lambda v: v.isNotNull())
    rows = F.when(F.coalesce(flat, F.lit(False)) & (F.size(one) > 0), F.array(one)).otherwise(many)
    return requests.select(F.posexplode(rows).alias("row_id", "x"))


def pasted(lines: DataFrame, width: int = FEATURES) -> DataFrame:
    """Pasted text: blank and # lines go, tokens that don't parse go, width numbers at least, the first width stay."""
    kept = lines.select("line_no", F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    rows = kept.select("line_no", F.filter(numbers(F.col("value")), lambda v: v.isNotNull()).alias("x"))
    return rows.where(F.size("x") >= width).select("line_no", F.slice("x", 1, width).alias("x"))


def label_map_file(spark: SparkSession, path: str) -> DataFrame:
    """The label map in a file; empty where there is none."""
    return label_map(spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string"))


def first_path(spark: SparkSession, name: str, roots: list[str]) -> str:
    """The first of root/name that exists in any file system that Spark reads; the name itself where none does."""
    paths = [f"{root.rstrip('/')}/{name}" for root in roots]
    return next((p for p in paths if exists(spark, p)), name)


def section(lines: DataFrame, marker: str) -> DataFrame:
    """The lines from the first that contains the marker on; all of them if none does."""
    start = lines.agg(F.coalesce(F.min(F.when(F.contains("value", F.lit(marker)), F.col("line_no"))), F.min("line_no")).alias("start"))
    return lines.crossJoin(F.broadcast(start)).where("line_no >= start").drop("start")  # one row
