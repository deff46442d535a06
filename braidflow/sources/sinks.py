"""Writers: splits, predictions, metrics and models, as Parquet, with CSV exports in the known formats."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(col: Column, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits}f", col)


def feature_lines(rows: DataFrame) -> DataFrame:
    """row_id, x -> row_id, value: comma-separated with eight decimals."""
    return rows.select("row_id", F.array_join(F.transform("x", lambda x: fixed(x)), ",").alias("value"))


def write_features(rows: DataFrame, path: str) -> None:
    feature_lines(rows).orderBy("row_id").select("value").write.mode("overwrite").text(path)


def write_labels(rows: DataFrame, path: str) -> None:
    rows.orderBy("row_id").select(F.col("label").cast("int").cast("string")).write.mode("overwrite").text(path)


def write_predictions(rows: DataFrame, path: str, columns: tuple[str, ...] = ("final",), header: bool = False) -> None:
    """One column or (label, final), in the order of row ids, with a header or without."""
    names = {"label": "original", "final": "predicted"} if len(columns) > 1 else {"final": "pred"}
    rows.orderBy("row_id").select(*(F.col(c).cast("int").alias(names.get(c, c)) for c in columns)).write.mode("overwrite").option("header", header).csv(path)


def metric_rows(wide: DataFrame) -> DataFrame:
    """One wide row of numbers -> metric, value."""
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns))).alias("x")).select("x.*")


def wide_row(metrics: DataFrame) -> DataFrame:
    """metric, value -> one wide row."""
    return metrics.groupBy().pivot("metric").agg(F.first("value"))


def config_lines(holdout: list[int], trained: list[int], names: dict[int, str], **numbers: int) -> list[str]:
    join = lambda x: ",".join(map(str, x))
    lines = [f"holdout_class_ids={join(holdout)}", f"holdout_class_names={join(names[c] for c in holdout)}", f"svm_class_ids={join(trained)}", f"svm_class_names={join(names[c] for c in trained)}"]
    return lines + [f"{k}={v}" for k, v in numbers.items()]


def name_lines(spark: SparkSession, names: list[str]) -> DataFrame:
    """Feature names, one a line, in order."""
    return spark.createDataFrame([(k, n) for k, n in enumerate(names)], "line_no int, value string")


def scaler_rows(spark: SparkSession, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """A scaler's state: position, feature, mean, scale."""
    return spark.createDataFrame([(k, c, float(m), float(d)) for k, (c, (m, d)) in enumerate(fitted.items())], "position int, feature string, mean double, scale double")


def read_scaler(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """The state back, a row for each feature."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in rows.orderBy("position").collect()}


def epoch_log_lines(spark: SparkSession, log: list[tuple], columns: list[str], **trailer: float) -> DataFrame:
    """An epoch log as lines: a header, a line for each validation, then key,value lines."""
    lines = [",".join(columns), *(",".join(map(str, r)) for r in log), *(f"{k},{v}" for k, v in trailer.items())]
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")


def logger(path: str, name: str = "braidflow") -> logging.Logger:
    """A logger of the driver that writes every line to the console and to a file."""
    out = logging.getLogger(f"{name}:{path}")
    if not out.handlers:
        for handler in (logging.StreamHandler(), logging.FileHandler(path)):
            handler.setFormatter(logging.Formatter("[%(asctime)s] %(message)s"))
            out.addHandler(handler)
        out.setLevel(logging.INFO)
        out.propagate = False
    return out


def weight_lines(weights: DataFrame) -> DataFrame:
    """label, weight -> value: class_<id>_weight=<number>."""
    return weights.select(F.concat(F.lit("class_"), F.col("label").cast("string"), F.lit("_weight="), fixed(F.col("weight"), 6)).alias("value"))


def response(verdicts: DataFrame) -> DataFrame:
    """One JSON document for each row."""
    return verdicts.select("row_id", F.to_json(F.struct(*verdicts.columns)).alias("body"))
