"""What the dashboard and the scoring service ask for, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.operators import registry, serving
from braidflow.operators.models import KernelPairs, LinearPairs
from braidflow.operators.taxonomy import NAMES, TRAINED, name_of
from braidflow.shared import exists
from braidflow.sources import logs

# What the registry says of each engine.
KINDS = {"cuda": "RFF-SVM", "mpi": "Linear SVM", "openmp": "Linear SVM", "thread": "Kernel SVM", "pyspark": "Kernel SVM"}


def load_model(spark: SparkSession, path: str) -> LinearPairs | KernelPairs | None:
    """The pair model stored at path, of either form; None if there is none."""
    if not exists(spark, path):
        return None
    table = spark.read.parquet(path)
    return KernelPairs.of(table) if "sv" in table.columns else LinearPairs.of(table)


def save_clusters(centroids: DataFrame, path: str, **parameters: float) -> None:
    """cluster_id, centroid, cluster_label, with the parameters of the run in every row."""
    centroids.withColumns({k: F.lit(float(v)) for k, v in parameters.items()}).coalesce(1).write.mode("overwrite").parquet(path)


def load_clusters(spark: SparkSession, path: str, dims: int) -> list[tuple[int, list[float]]] | None:
    """The stored centroids, a row for each cluster; None if there are none, or of another width."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path).select("cluster_id", "centroid").orderBy("cluster_id").collect()
    return [(r["cluster_id"], r["centroid"]) for r in rows] if rows and all(len(r["centroid"]) == dims for r in rows) else None


def loadable(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """model, kind, threshold, loadable: whether each engine's stored model can be read."""
    rows = [(m, KINDS[m], serving.THRESHOLDS[m], m in paths and load_model(spark, paths[m]) is not None) for m in registry.ORDER]
    return spark.createDataFrame(rows, "model string, kind string, threshold double, loadable boolean")


def model_info(spark: SparkSession, model: str, stored: LinearPairs | KernelPairs) -> DataFrame:
    serving.check_request(model, "none", serving.FEATURES, unknown=404)
    width = len(stored.w[0]) if isinstance(stored, LinearPairs) else len(stored.vectors[0][0])
    row = (model, KINDS[model], width, len(TRAINED), len(stored.pairs), [NAMES[c] for c in TRAINED], serving.THRESHOLDS[model])
    return spark.createDataFrame([row], "model string, kind string, n_features int, n_classes int, n_pairs int, classes array<string>, threshold double")


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    """predicted -> class_id, name, n, pct."""
    from braidflow.operators.prep import distribution

    out = distribution(predictions.select(F.col("predicted").alias("class_id")), "class_id")
    return out.select("class_id", name_of(F.col("class_id")).alias("name"), "n", "pct")


def epoch_errors(lines: DataFrame) -> DataFrame:
    """Error rates of each pair's epochs."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return logs.pair_epochs(lines).withColumn("train_error", rate("train_errors", "n_train")).withColumn("val_error", rate("val_errors", "n_val"))


def accuracy_csv(lines: DataFrame) -> DataFrame:
    """The first line with two numbers: train_accuracy, test_accuracy."""
    parts = F.split("value", ",")
    rows = lines.where(F.size(parts) == 2).select("line_no", F.trim(parts[0]).try_cast("double").alias("train_accuracy"), F.trim(parts[1]).try_cast("double").alias("test_accuracy")).na.drop()
    return rows.agg(F.min_by(F.struct("train_accuracy", "test_accuracy"), "line_no").alias("x")).select("x.*")
