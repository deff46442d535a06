"""Cleaning, scaling, encoding, weighting and sampling of labelled feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Names under which a label column may come.
LABEL_NAMES = ("label", "attack type", "attack_type", "class")
MIN_CLASS_ROWS = 100
MIN_VARIANCE = 1e-10
# How many rows of a class are kept when undersampling.
UNDERSAMPLE = {2: 100_000, 3: 150_000, 4: 300_000}


def label_column(df: DataFrame) -> str:
    """The first column whose trimmed lower-case name is one of LABEL_NAMES."""
    for name in df.columns:
        if name.strip().lower() in LABEL_NAMES:
            return name
    raise ValueError(f"no label column among {df.columns}")


def numeric_columns(df: DataFrame, label: str) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != label]


def finite(col: Column) -> Column:
    """The value as a double, null where it is infinite or not a number."""
    col = col.cast("double")
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def clean(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Drops rows in which any of the columns isn't finite; trims the label."""
    for c in columns:
        df = df.withColumn(c, finite(F.col(c)))
    if label:
        df = df.withColumn(label, F.trim(label))
    return df.na.drop(subset=columns)


def ingest(df: DataFrame) -> DataFrame:
    """A raw catalogue table to label, and its finite numeric columns."""
    label = label_column(df)
    columns = numeric_columns(df, label)
    return clean(df.select(*columns, F.col(label).cast("string").alias("label")), columns, "label")


def frequent_classes(df: DataFrame, label: str, least: int = MIN_CLASS_ROWS) -> DataFrame:
    frequent = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(frequent, label, "left_semi")


def encode(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Labels to 0..n-1 in binary order. Only the distinct labels are ordered."""
    codes = df.select(label).where(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(W.orderBy(label)) - 1).alias(out))
    return df.join(codes, label, "left")


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per feature: its population variance and whether it stays."""
    stats = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns))).alias("x")).select("x.*")
    return long.withColumn("kept", F.col("variance") > MIN_VARIANCE)


def scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of zero scales by one."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = W.partitionBy()  # a row for each class
    return counts.select(label, "n", (F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))).alias("weight"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, "n", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2).alias("pct"))


HASH_RANGE = 1 << 32
RANGES = 4096


def shuffled_key(key: str, seed: int = 42) -> Column:
    """A multiplicative hash of the row id, below HASH_RANGE: with the id, a reproducible order that any engine can follow."""
    return (F.col(key) * 2654435761 + seed) % HASH_RANGE


def _first(df: DataFrame, label: str | None, hashed: Column, width: float, key: str, limit: Column) -> DataFrame:
    """Adds _in: whether a row is among the first limit of its label (of all rows without one) by hashed, then key.

    Rows are counted by ranges of width. Ranges below the one that holds the limit are in whole and those above it
    out; only the rows of that range are ranked, so no task ranks a class. limit may use _n, the label's rows.
    """
    by = [label] if label else []
    rows = df.withColumn("_range", F.floor(hashed / width).cast("long"))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    own = W.partitionBy(*by)  # RANGES + 1 rows at most for each class
    placed = counts.select(*by, "_range", "_c", F.sum("_c").over(own.orderBy("_range")).alias("_upto"), F.sum("_c").over(own).alias("_n"))
    placed = placed.withColumn("_left", limit - (F.col("_upto") - F.col("_c")))
    placed = placed.withColumn("_state", F.when(F.col("_left") >= F.col("_c"), 1).when(F.col("_left") <= 0, 0))
    placed = placed.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_range").alias("_of_range"), "_left", "_state")
    match = F.col("_range") == F.col("_of_range")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = rows.join(placed, match)
    edge = W.partitionBy(*by).orderBy(hashed, key)
    whole = joined.where("_state IS NOT NULL").withColumn("_in", F.col("_state") == 1)
    ranked = joined.where("_state IS NULL").withColumn("_in", F.row_number().over(edge) <= F.col("_left"))
    return whole.unionByName(ranked).select(*df.columns, "_in")


def _first_shuffled(df: DataFrame, label: str | None, key: str, limit: Column) -> DataFrame:
    return _first(df, label, shuffled_key(key), HASH_RANGE / RANGES, key, limit)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.3) -> DataFrame:
    """Adds split: of each class the first round(share * n) rows in shuffled order are test, the rest train."""
    chosen = _first_shuffled(df, label, key, F.round(F.col("_n") * share))
    return chosen.withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def undersample(df: DataFrame, label: str, key: str, targets: dict[int, int] | None = None) -> DataFrame:
    """At most its target of each class, without replacement; classes without a target stay whole."""
    limit = F.coalesce(*(F.when(F.col(label) == c, n) for c, n in (targets or UNDERSAMPLE).items()), F.col("_n"))
    return _first_shuffled(df, label, key, limit).where("_in").drop("_in")


def balanced_pair(df: DataFrame, label: str, key: str, a: int, b: int, most: int = 2500) -> DataFrame:
    """As many rows of class a as of class b: the least of both counts and most. y is 1 for a, -1 for b."""
    both = df.where(F.col(label).isin(a, b))
    n = both.agg(F.least(F.lit(most), F.count_if(F.col(label) == a), F.count_if(F.col(label) == b)).alias("n")).first()["n"]
    return _first_shuffled(both, label, key, F.lit(n)).where("_in").drop("_in").withColumn("y", F.when(F.col(label) == a, 1).otherwise(-1))


def per_class(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    return _first_shuffled(df, label, key, F.lit(most)).where("_in").drop("_in")


def first_rows(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows by a whole-numbered column, found by counts of its ranges."""
    span = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    if span["low"] is None:
        return df
    low, width = span["low"], (span["high"] - span["low"]) / RANGES + 1
    return _first(df, None, F.col(order) - F.lit(low), width, order, F.lit(most)).where("_in").drop("_in")


def random_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    return _first_shuffled(df, None, key, F.lit(most)).where("_in").drop("_in")


def drop_holdout(train: DataFrame, label: str, holdout: tuple[int, ...]) -> DataFrame:
    return train.where(~F.col(label).isin(*holdout))


def spill_holdout(train: DataFrame, test: DataFrame, label: str, holdout: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Holdout rows that fell into train join test."""
    held = F.col(label).isin(*holdout)
    return train.where(~held), test.unionByName(train.where(held))
