"""The registry of engines' results: overview, comparisons, speedups, cost formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display order, and the pairs that are compared.
ORDER = ("cuda", "mpi", "openmp", "thread", "pyspark")
COMPARED = (("cuda", "openmp"), ("cuda", "mpi"), ("mpi", "openmp"), ("thread", "pyspark"))
METRICS = ("accuracy", "total_ms", "train_ms", "predict_ms", "gflops")


def overview(models: DataFrame) -> DataFrame:
    """models: model, accuracy, total_ms, gflops -> one row; the fastest is the least total_ms above zero, or N/A."""
    return models.agg(
        F.count("*").alias("n_models"),
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("avg_accuracy"),
        F.max_by("model", F.struct("accuracy", "model")).alias("best_accuracy_model"),
        F.coalesce(F.expr("min_by(model, struct(total_ms, model)) FILTER (WHERE total_ms > 0)"), F.lit("N/A")).alias("fastest_model"),
        F.max_by("model", F.struct("gflops", "model")).alias("best_gflops_model"),
    )


def comparison(models: DataFrame) -> DataFrame:
    """The compared metrics of each engine in display order, times in seconds."""
    position = F.array_position(F.array(*map(F.lit, ORDER)), F.col("model"))
    rows = models.where(F.col("model").isin(*ORDER)).withColumn("position", position)
    seconds = lambda c: F.round(F.col(c) / 1000, 6).alias(c.replace("_ms", "_s"))
    return rows.select("position", "model", "accuracy", seconds("train_ms"), seconds("predict_ms"), seconds("total_ms"), "gflops")


def speedups(models: DataFrame) -> DataFrame:
    """For each compared pair: both values, max / min, and the winner, for total time and GFLOPS."""
    spark = models.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, b in COMPARED], "left_model string, right_model string")
    left = models.select(F.col("model").alias("left_model"), F.col("total_ms").alias("lt"), F.col("gflops").alias("lg"))
    right = models.select(F.col("model").alias("right_model"), F.col("total_ms").alias("rt"), F.col("gflops").alias("rg"))
    both = F.broadcast(pairs).join(left, "left_model").join(right, "right_model")

    def rows(metric: str, a: str, b: str, less_wins: bool) -> Column:
        better = F.col(a) <= F.col(b) if less_wins else F.col(a) >= F.col(b)
        return F.struct(F.lit(metric).alias("metric"), F.col(a).alias("left_value"), F.col(b).alias("right_value"), F.try_divide(F.greatest(a, b), F.least(a, b)).alias("ratio"), F.when(better, F.col("left_model")).otherwise(F.col("right_model")).alias("winner"))

    return both.select("left_model", "right_model", F.explode(F.array(rows("total_ms", "lt", "rt", True), rows("gflops", "lg", "rg", False))).alias("x")).select("left_model", "right_model", "x.*")


def cosine_rate(epoch: Column, epochs: int = 200, peak: float = 0.05, least: float = 0.001) -> Column:
    return F.lit(least) + 0.5 * (peak - least) * (1 + F.cos(F.lit(3.141592653589793) * epoch / epochs))


def linear_flops(rows: Column, pairs: int = 6, width: int = 52) -> Column:
    return rows * (2 * pairs * width)


def kernel_flops(rows: Column, vectors: Column, width: int = 52) -> Column:
    return rows * vectors * (3 * width + 2)


def pairwise_flops(points: Column, dims: int) -> Column:
    return points * points * (3 * dims)


def gflops(flops: Column, ms: Column) -> Column:
    return F.coalesce(F.try_divide(flops, ms * 1e6), F.lit(0.0))


def throughput(rows: Column, ms: Column) -> Column:
    return F.coalesce(F.try_divide(rows * 1000.0, ms), F.lit(0.0))


def shown_duration(ms: Column) -> Column:
    """A dash for nothing; whole milliseconds under a second, else seconds under a minute, else minutes, with one decimal."""
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(ms.isNull() | (ms == 0), "\u2014").when(ms < 1000, F.concat(F.format_string("%.0f", ms), F.lit(" ms"))).when(ms < 60_000, one(ms / 1000, " s")).otherwise(one(ms / 60_000, " min"))


def shown_number(n: Column) -> Column:
    """With separators of thousands, and three decimals at most; a dash for null."""
    text = F.regexp_replace(F.regexp_replace(F.format_number(n.cast("double"), 3), "0+$", ""), "\\.$", "")
    return F.when(n.isNull(), "\u2014").otherwise(text)
