"""Run logs and result files of engines, parsed by Spark expressions into rows.

A log's text is cut once into fields: a name, a number, and the number's unit. What each result column means is a
table of names; a column takes the first field that is stated under one of its names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names under which engines print their results, with units.
RUN_FIELDS = {
    "accuracy": ("accuracy", "%"),
    "train_accuracy": ("train accuracy", "%"),
    "n_train": ("train", ""),
    "n_test": ("test", ""),
    "n_features": ("features", ""),
    "n_classes": ("classes", ""),
    "gflops": ("gflops", ""),
    "flops": ("flop count", ""),
    "confident": ("confident", ""),
    "uncertain": ("uncertain", ""),
    "clusters": ("clusters", ""),
    "noise": ("noise", ""),
}
SHORT_TIMES = {"train_ms": "train", "predict_ms": "predict", "dbscan_ms": "dbscan", "total_ms": "total"}
LONG_TIMES = {"train_ms": "svm training", "predict_ms": "svm prediction", "dbscan_ms": "dbscan", "total_ms": "time"}
LATEST_FIELDS = {"total_ms": ("total train time", "ms"), "gflops": ("effective gflops", "")}
WHOLE = ("n_train", "n_test", "n_features", "n_classes", "flops", "confident", "uncertain", "clusters", "noise")
# The names of results in metric logs.
ACCURACIES = ("accuracy_hybrid", "accuracy")
STAND_INS = ("macro_f1_hybrid", "macro_f1", "svm_confident_acc")
RATES = ("gflops", "svm_gflops", "predict_gflops", "dbscan_gflops")
METRICS = {"macro_f1": ("macro_f1_hybrid", "macro_f1"), "n_test": ("n_test",), "n_clusters": ("n_clusters",), "train_ms": ("train_ms",), "predict_ms": ("predict_ms",), "dbscan_ms": ("dbscan_ms",), "total_ms": ("total_ms", "total_time_ms")}

_FIELD = r"([A-Za-z][A-Za-z \-]*)(?:\([^()]*\))?\s*[:=]\s*([0-9][0-9,]*\.?[0-9]*)\s*(%|ms\b)?"


def fields(text: Column) -> Column:
    """An array of (name, number, unit): "Train: 1,200 | Time: 3.5 ms" has (train, 1200, "") and (time, 3.5, ms)."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_FIELD), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("name"), part(2).alias("number"), part(3).alias("unit"))
    clean = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(zipped, lambda x: F.struct(clean(x["name"]).alias("name"), F.replace(x["number"], F.lit(","), F.lit("")).alias("number"), x["unit"].alias("unit")))


def stated(found: Column, name: str, unit: str, last_word: bool = False) -> Column:
    """The first number under the name (or, with last_word, under one that ends in it) with the unit; null if there is none."""
    under = lambda x: (x["name"] == name) | F.endswith(x["name"], F.lit(" " + name)) if last_word else x["name"] == name
    return F.get(F.filter(found, lambda x: under(x) & (x["unit"] == unit)), 0)["number"]


def run_log(logs: DataFrame) -> DataFrame:
    """text: a whole log -> accuracy, sizes, times, GFLOPS, FLOPs, routing and clusters; null where it has none.

    Any accuracy counts as the accuracy where no earlier one is stated. Times under their short names are taken if all
    four are there, else those under their long names.
    """
    rows = logs.withColumn("_f", fields(F.col("text")))
    f = F.col("_f")
    cast = lambda c, name: c.try_cast("bigint" if name in WHOLE else "double").alias(name)
    short = {c: stated(f, n, "ms") for c, n in SHORT_TIMES.items()}
    whole = F.array_size(F.filter(F.array(*short.values()), lambda x: x.isNotNull())) == len(short)
    times = [F.when(whole, short[c]).otherwise(stated(f, n, "ms")).try_cast("double").alias(c) for c, n in LONG_TIMES.items()]
    named = {c: cast(stated(f, n, u, c == "accuracy"), c) for c, (n, u) in RUN_FIELDS.items()}
    technique = F.get(F.filter(F.split("text", "\n"), lambda x: F.startswith(F.trim(x), F.lit("Technique:"))), 0)
    own = [named[c] for c in ("accuracy", "train_accuracy")] + [F.trim(F.split(technique, ":", 2)[1]).alias("technique")]
    rest = [named[c] for c in named if c not in ("accuracy", "train_accuracy")]
    return rows.select(*[c for c in logs.columns if c != "text"], *own, *rest[:4], *times, *rest[4:])


def latest_values(logs: DataFrame) -> DataFrame:
    """path, text -> the two values of the log whose path sorts last: total_ms and gflops, 0 where it states none."""
    last = latest(logs).withColumn("_f", fields(F.col("text")))
    return last.select("path", *(F.coalesce(stated(F.col("_f"), n, u).try_cast("double"), F.lit(0.0)).alias(c) for c, (n, u) in LATEST_FIELDS.items()))


def metric_log(rows: DataFrame) -> DataFrame:
    """model, line_no, metric, value (text) -> one row per model.

    Accuracy is the last that a log states; where it states none, or zero, the first stand-in that isn't zero takes its
    place. Rates of GFLOPS add up. Values that don't parse are passed over.
    """
    known = rows.withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL")

    def pick(names: tuple[str, ...], of: str, also: Column | None = None) -> Column:
        it = F.col("metric").isin(*names) if also is None else F.col("metric").isin(*names) & also
        at = F.when(it, F.col("line_no"))
        return (F.max_by if of == "last" else F.min_by)("value", at)

    columns = {c: F.coalesce(pick(names, "last"), F.lit(0.0)) for c, names in METRICS.items()}
    accuracy = F.coalesce(F.nullif(pick(ACCURACIES, "last"), F.lit(0.0)), pick(STAND_INS, "first", F.col("value") != 0), F.lit(0.0))
    gflops = F.coalesce(F.sum(F.when(F.col("metric").isin(*RATES), F.col("value"))), F.lit(0.0))
    detection = pick(("holdout_detection_rate",), "last")
    whole = {c: columns[c].cast("bigint") for c in ("n_test", "n_clusters")}
    wanted = {"accuracy": 100 * accuracy, "macro_f1": columns["macro_f1"], **whole, "detection_rate": 100 * detection, **{c: columns[c] for c in columns if c.endswith("_ms")}, "gflops": gflops}
    return known.groupBy("model").agg(*(x.alias(c) for c, x in wanted.items()))


def epoch_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """line_no, value: the rows of an epoch log as doubles; the header and short trailing rows go."""
    parts = F.split("value", ",")
    rows = lines.where(F.size(parts) == len(columns)).select("line_no", *(F.trim(parts[k]).try_cast("double").alias(c) for k, c in enumerate(columns)))
    return rows.where(F.col(columns[0]).isNotNull())


def trailer(lines: DataFrame) -> DataFrame:
    """The two-field rows after an epoch log: key, value."""
    parts = F.split("value", ",")
    return lines.where(F.size(parts) == 2).select("line_no", F.trim(parts[0]).alias("key"), F.trim(parts[1]).try_cast("double").alias("value")).where("value IS NOT NULL")


def best_epoch(epochs: DataFrame, by: str = "val_macro_f1") -> DataFrame:
    """The epoch with the largest value above 0; the earliest of equals."""
    return epochs.where(F.col(by) > 0).agg(F.max_by(F.struct("*"), F.struct(by, -F.col("epoch"))).alias("x")).where("x IS NOT NULL").select("x.*")


def wide_summary(rows: DataFrame) -> DataFrame:
    """line_no and columns: the last row of a one-row summary."""
    return rows.agg(F.max_by(F.struct("*"), "line_no").alias("x")).select("x.*").drop("line_no")


def vertical_summary(rows: DataFrame) -> DataFrame:
    """model, key, value -> model, and a map of the numbers."""
    return rows.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.col("value").try_cast("double"))))).alias("metrics"))


def pair_epochs(lines: DataFrame) -> DataFrame:
    """class_a, class_b, epoch, train_errors, n_train, val_errors, n_val from lines of seven ints."""
    names = ("class_a", "class_b", "epoch", "train_errors", "n_train", "val_errors", "n_val")
    parts = F.split("value", ",")
    rows = lines.where(F.size(parts) == 7).select(*(F.trim(parts[k]).try_cast("int").alias(n) for k, n in enumerate(names)))
    return rows.na.drop()


def predictions(lines: DataFrame) -> DataFrame:
    """Predictions with one column or two, with a header or without -> line_no, original, predicted."""
    parts = F.split("value", ",")
    rows = lines.select("line_no", F.when(F.size(parts) > 1, F.trim(parts[0]).try_cast("int")).alias("original"), F.trim(F.element_at(parts, -1)).try_cast("int").alias("predicted"))
    return rows.where("predicted IS NOT NULL")


def latest(paths: DataFrame) -> DataFrame:
    """path, text: the log whose path sorts last."""
    return paths.agg(F.max_by("text", "path").alias("text"), F.max("path").alias("path"))


def improvements(epochs: DataFrame, min_delta: float = 1e-4, patience: int = 30) -> DataFrame:
    """epoch, f1 -> every epoch with the best so far, the epochs since, and whether training would have stopped.

    An epoch improves if its f1 exceeds the best so far by more than min_delta. The log is one run's, so
    it is folded as one array.
    """
    zero = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("since"), F.lit(False).alias("stopped"))
    all_rows = epochs.agg(F.sort_array(F.collect_list(F.struct("epoch", "f1"))).alias("e"))

    def step(s, x):
        better = x["f1"] > s["best"] + min_delta
        since = F.when(better, 0).otherwise(s["since"] + 1)
        return F.when(s["stopped"], s).otherwise(F.struct(F.when(better, x["f1"]).otherwise(s["best"]).alias("best"), since.alias("since"), (since >= patience).alias("stopped")))

    each = all_rows.select("e", F.posexplode("e").alias("i", "x")).withColumn("s", F.aggregate(F.slice("e", F.lit(1), F.col("i") + 1), zero, step))
    return each.select("x.epoch", "x.f1", "s.best", "s.since", "s.stopped")
