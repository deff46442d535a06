"""Confusion, precision and recall, accuracy, detection and false-alarm rates, in each of their definitions.

Rows have label (the truth) and final (the verdict). All are one pass of counts; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidflow.operators.taxonomy import HOLDOUT, NORMAL, NOVEL, TRAINED, UNKNOWN


def _in(c: Column, ids: tuple[int, ...]) -> Column:
    return c.isin(*ids)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, label: str = "label", final: str = "final") -> DataFrame:
    return rows.groupBy(label, final).agg(F.count("*").alias("n"))


def _admitted(rows: DataFrame, variant: str) -> DataFrame:
    """all: every row. trained: the truth is a trained class. restricted: truth and verdict are."""
    if variant == "all":
        return rows
    kept = rows.where(_in(F.col("label"), TRAINED))
    return kept.where(_in(F.col("final"), TRAINED)) if variant == "restricted" else kept


def per_class(rows: DataFrame, variant: str = "all") -> DataFrame:
    """One row per trained class: tp, fp, fn, precision, recall, f1."""
    rows = _admitted(rows, variant)
    label, final = F.col("label"), F.col("final")
    counts = rows.agg(*(x for c in TRAINED for x in (F.count_if((label == c) & (final == c)).alias(f"tp{c}"), F.count_if((label != c) & (final == c)).alias(f"fp{c}"), F.count_if((label == c) & (final != c)).alias(f"fn{c}"))))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("class_id"), F.col(f"tp{c}").alias("tp"), F.col(f"fp{c}").alias("fp"), F.col(f"fn{c}").alias("fn")) for c in TRAINED))).alias("x")).select("x.*")
    long = long.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return long.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(rows: DataFrame, variant: str = "all") -> DataFrame:
    return per_class(rows, variant).agg(F.avg("f1").alias("macro_f1"))


def rates(rows: DataFrame, far_counts_unknown: bool = False) -> DataFrame:
    """One row: both accuracies, both detection rates and the false-alarm rate.

    accuracy_strict counts every verdict on a trained truth, accuracy_restricted only verdicts that are
    trained classes. detection_novelty is the share of holdout rows said to be novel, and
    detection_identification of those given their own class. false_alarm is the share of normal rows said
    to be novel (or unknown, where far_counts_unknown).
    """
    label, final = F.col("label"), F.col("final")
    trained, held, right = _in(label, TRAINED), _in(label, HOLDOUT), label == final
    alarm = final.isin(NOVEL, UNKNOWN) if far_counts_unknown else final == NOVEL
    return rows.agg(
        ratio(F.count_if(trained & right), F.count_if(trained)).alias("accuracy_strict"),
        ratio(F.count_if(trained & right), F.count_if(trained & _in(final, TRAINED))).alias("accuracy_restricted"),
        ratio(F.count_if(held & (final == NOVEL)), F.count_if(held)).alias("detection_novelty"),
        ratio(F.count_if(held & right), F.count_if(held)).alias("detection_identification"),
        ratio(F.count_if((label == NORMAL) & alarm), F.count_if(label == NORMAL)).alias("false_alarm"),
    )


def detection_by_class(rows: DataFrame) -> DataFrame:
    """For each holdout class, and for all of them (class_id null): rows, found as such, said to be novel."""
    held = rows.where(_in(F.col("label"), HOLDOUT)).withColumn("own", F.col("label") == F.col("final"))
    return held.rollup("label").agg(F.count("*").alias("n"), F.count_if("own").alias("identified"), F.count_if(F.col("final") == NOVEL).alias("novel"))


def breakdown(rows: DataFrame) -> DataFrame:
    """What became of the rows that were uncertain: right, wrong, normal, novel, unknown."""
    label, final = F.col("label"), F.col("final")
    pool = rows.where("route = 'uncertain'")
    return pool.agg(F.count("*").alias("n"), F.count_if(label == final).alias("n_right"), F.count_if(_in(final, TRAINED) & (label != final)).alias("n_wrong"), F.count_if(final == NORMAL).alias("n_normal"), F.count_if(final == NOVEL).alias("n_novel"), F.count_if(final == UNKNOWN).alias("n_unknown"))
