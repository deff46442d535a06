"""The class dimension: original ids, names and roles, and the pair order of one-vs-one models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class ids, names and roles.
NAMES = {0: "Bots", 1: "BruteForce", 2: "DDoS", 3: "DoS", 4: "NormalTraffic", 5: "PortScan", 6: "WebAttacks"}
HOLDOUT = (0, 1, 6)
TRAINED = (2, 3, 4, 5)
NORMAL = 4
# What a prediction can be besides a class.
NOVEL, UNKNOWN, UNCLASSIFIED = -1, -2, -3

#: Pairs in the order of their scores: (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3) of internal ids.
PAIRS = tuple(combinations(TRAINED, 2))


def class_dim(spark: SparkSession) -> DataFrame:
    rows = [(c, n, "holdout" if c in HOLDOUT else "trained", TRAINED.index(c) if c in TRAINED else None, c == NORMAL) for c, n in NAMES.items()]
    return spark.createDataFrame(rows, "class_id int, name string, role string, internal_id int, is_normal boolean")


def name_of(col: Column) -> Column:
    """A class's name, or "Class <id>" where the dimension has none."""
    known = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, col.cast("int")), F.concat(F.lit("Class "), col.cast("string")))


def remap(rows: DataFrame) -> DataFrame:
    """Rows of trained classes with their internal id; others go."""
    dim = class_dim(rows.sparkSession).where("internal_id IS NOT NULL").select(F.col("class_id").alias("label"), "internal_id")
    return rows.join(F.broadcast(dim), "label")  # a row for each class
