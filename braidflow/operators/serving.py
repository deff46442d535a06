"""Scoring without truth: a request's rows in, one verdict for each out.

A request is one batch, small by nature; percentile_radius checks that. The verdict columns are
predicted_class, predicted_label, confidence, votes (class name -> margin), is_uncertain, is_novel,
is_outlier, cluster_id, distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidflow.operators import scoring
from braidflow.operators.clustering import centroids, dbscan, nearest_centroid, percentile_radius
from braidflow.operators.hybrid import simulated_vote, strongest
from braidflow.operators.prep import finite
from braidflow.operators.taxonomy import NORMAL, name_of
from braidflow.shared import Scratch

# Confidence thresholds of serving, by model.
THRESHOLDS = {"cuda": 0.5, "mpi": 0.8, "openmp": 0.6, "thread": 1.0, "pyspark": 0.5}
MODELS = tuple(THRESHOLDS)
FEATURES = 52
MODES = ("none", "hybrid", "pure")


#: How each kind of model decides: confidence, rule, whether a score of zero is for the first class, space of the clusters.
LINEAR, KERNEL = ("votes", "votes", False, "scores"), ("margin", "weighted", True, "margins")
DECIDES = {"cuda": LINEAR, "mpi": LINEAR, "openmp": LINEAR, "thread": KERNEL, "pyspark": KERNEL}
CLUSTERS_ONLY = "dbscan"


class RequestError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def check_request(model: str, mode: str, width: int, expected: int = FEATURES, loadable: tuple[str, ...] = (*MODELS, CLUSTERS_ONLY), unknown: int = 400) -> None:
    """400 for an unknown model (404 where the model is what is asked for), 503 for one that can't be loaded, 400 for a bad mode, no features or another width."""
    if model not in (*MODELS, CLUSTERS_ONLY):
        raise RequestError(unknown, f"unknown model {model}")
    if model not in loadable:
        raise RequestError(503, f"{model} can't be loaded")
    if mode not in MODES:
        raise RequestError(400, f"unknown mode {mode}")
    if not width:
        raise RequestError(400, "no features")
    if width != expected:
        raise RequestError(400, f"{expected} features are expected, {width} came")


def base_label(label: Column) -> Column:
    """Without the suffixes that earlier passes may have left."""
    return F.regexp_replace(label, r" \((Unverified|DBSCAN verified)\)", "")


def plain(scored: DataFrame, confidence: str = "votes", rule: str = "votes", at_zero_first: bool = False) -> DataFrame:
    """row_id, scores -> verdicts of the classifier alone."""
    out = scoring.ballot(scored, at_zero_first).withColumn("predicted_class", scoring.predict(rule))
    out = out.withColumn("confidence", scoring.confidence(confidence, "predicted_class"))
    return out.withColumn("predicted_label", name_of(F.col("predicted_class"))).withColumn("vote_map", scoring.score_map())


def _unsure(verdicts: DataFrame, threshold: float) -> Column:
    return ~scoring.confident(F.col("confidence"), threshold, strict=True)


def hybrid_online(verdicts: DataFrame, threshold: float, space: str = "scores", normal_too: bool = False) -> DataFrame:
    """The unsure attack rows are clustered among themselves.

    A clustered row takes its cluster's simulated class and "(Cluster)"; noise keeps its class with
    "(Outlier)". Both stay uncertain; only clustered rows are novel. The radius is the 30th percentile of
    their distances (0.5 for fewer than two), and three rows make a core, or two where there are no more.
    """
    dims = 6 if space == "scores" else 4
    verdicts = verdicts.withColumn("unsure", _unsure(verdicts, threshold) & ((F.col("predicted_class") != NORMAL) | F.lit(normal_too)))
    points = verdicts.where("unsure").select(F.col("row_id").alias("id"), F.col(space).cast("array<double>").alias("v"))
    n = points.count()
    eps = percentile_radius(points, default=0.5)
    found = dbscan(points, eps, max(2, min(3, n)), dims).join(points, "id")
    centre = centroids(found.where("cluster_id >= 0"), dims)
    of = simulated_vote(F.col("centroid")) if space == "scores" else strongest(F.col("centroid"))
    labels = centre.select("cluster_id", name_of(of).alias("cluster_label"))
    found = found.select(F.col("id").alias("row_id"), "cluster_id").join(labels, "cluster_id", "left")
    out = verdicts.join(found, "row_id", "left")
    label = F.when(F.col("cluster_id") >= 0, F.concat("cluster_label", F.lit(" (Cluster)"))).when(F.col("cluster_id") < 0, F.concat(base_label(F.col("predicted_label")), F.lit(" (Outlier)"))).otherwise(F.col("predicted_label"))
    return out.select("row_id", "predicted_class", label.alias("predicted_label"), "confidence", F.col("unsure").alias("is_uncertain"), F.coalesce(F.col("cluster_id") >= 0, F.lit(False)).alias("is_novel"), "cluster_id")


def hybrid_pretrained(verdicts: DataFrame, threshold: float, model: list[tuple[int, list[float]]], fixed: float | None = None, space: str = "scores") -> DataFrame:
    """The unsure attack rows go to the nearest centroid of a stored cluster model.

    Those within the median of this batch's distances (or within fixed) are of that cluster and no longer
    uncertain; the others are outliers, uncertain and novel.
    """
    verdicts = verdicts.withColumn("unsure", _unsure(verdicts, threshold) & (F.col("predicted_class") != NORMAL))
    points = verdicts.where("unsure").select(F.col("row_id").alias("id"), F.col(space).cast("array<double>").alias("v"))
    near = nearest_centroid(points, model)
    bound = near.agg(F.coalesce(F.lit(fixed).cast("double"), F.median("distance")).alias("bound"))
    near = near.crossJoin(F.broadcast(bound)).select(F.col("id").alias("row_id"), "distance", F.when(F.col("distance") <= F.col("bound"), F.col("cluster_id")).otherwise(-1).alias("cluster_id"))  # one row
    out = verdicts.join(near, "row_id", "left")
    suffix = F.when(F.col("cluster_id") >= 0, " (Cluster)").otherwise(" (Outlier)")
    label = F.when(F.col("cluster_id").isNull(), F.col("predicted_label")).otherwise(F.concat(base_label(F.col("predicted_label")), suffix))
    outlier = F.coalesce(F.col("cluster_id") < 0, F.lit(False))
    return out.select("row_id", "predicted_class", label.alias("predicted_label"), "confidence", outlier.alias("is_uncertain"), outlier.alias("is_novel"), "cluster_id", "distance")


def standardized(batch: DataFrame, dims: int, column: str = "x") -> DataFrame:
    """The batch's vectors, scaled by its own means and population deviations."""
    c = F.col(column)
    row = batch.agg(*(F.avg(c[k]).alias(f"m{k}") for k in range(dims)), *(F.stddev_pop(c[k]).alias(f"s{k}") for k in range(dims))).first()
    return batch.withColumn("v", F.array(*((c[k] - F.lit(row[f"m{k}"] or 0.0)) / F.lit(row[f"s{k}"] or 1.0) for k in range(dims))))


def pure(batch: DataFrame, dims: int, column: str = "x") -> DataFrame:
    """Clusters the request's standardised features alone: no classes, only clusters and outliers.

    confidence is 1 - min(distance / (radius + 1e-6), 1) within the cluster, 0 for outliers. The radius of
    neighbourhoods is the 30th percentile of the batch's distances.
    """
    from braidflow.functions.vectors import sqdist

    points = standardized(batch, dims, column).select(F.col("row_id").alias("id"), "v")
    n = points.count()
    eps = percentile_radius(points, default=1.0)
    found = dbscan(points, eps, max(2, min(5, n // 20)), dims).join(points, "id")
    centre = centroids(found.where("cluster_id >= 0"), dims).select("cluster_id", "centroid")
    placed = found.join(centre, "cluster_id", "left").withColumn("d", F.sqrt(sqdist(F.col("v"), F.col("centroid"))))
    radius = placed.where("cluster_id >= 0").groupBy("cluster_id").agg(F.max("d").alias("radius"))
    placed = placed.join(radius, "cluster_id", "left")
    sure = F.when(F.col("cluster_id") < 0, 0.0).otherwise(1 - F.least(F.col("d") / (F.col("radius") + 1e-6), F.lit(1.0)))
    label = F.when(F.col("cluster_id") < 0, "Unknown (Outlier)").otherwise("Unknown (Cluster)")
    return placed.select(F.col("id").alias("row_id"), label.alias("predicted_label"), "cluster_id", (F.col("cluster_id") < 0).alias("is_outlier"), sure.alias("confidence"))


def legacy_bypass(verdicts: DataFrame) -> DataFrame:
    """The older rule: uncertain normal rows are normal."""
    return verdicts.withColumn("is_uncertain", F.col("is_uncertain") & (F.col("predicted_class") != NORMAL))


def shown(label: Column) -> Column:
    """A label for display: no "Novel: ", cluster numbers collapsed, a bare cluster renamed."""
    out = F.regexp_replace(label, "^Novel: ", "")
    out = F.regexp_replace(out, r" \(Cluster \d+\)", " (Cluster)")
    return F.regexp_replace(out, r"^Cluster \d+$", "Unknown (Cluster)")


def verdict_class(label: Column, uncertain: Column, novel: Column, confidence: Column) -> Column:
    """Display class: unknown, then unverified, novel, low-normal, normal, attack."""
    normal = F.contains(label, F.lit("Normal"))
    return F.when(F.contains(label, F.lit("Unknown")), "unknown").when(F.contains(label, F.lit("Unverified")) | (uncertain & ~novel), "unverified").when(novel, "novel").when(normal & (confidence < 0.5), "low-normal").when(normal, "normal").otherwise("attack")


def summary(verdicts: DataFrame) -> DataFrame:
    """One row of counts for the response; the overlapping tests are each counted by themselves."""
    n = F.count("*")
    pct = lambda c: F.coalesce(F.round(100 * F.try_divide(F.count_if(c), n), 2), F.lit(0.0))
    label = F.col("predicted_label")
    return verdicts.agg(
        n.alias("n"),
        F.count_if("is_uncertain").alias("n_uncertain"),
        F.count_if("is_novel").alias("n_novel"),
        F.count_if(F.contains(label, F.lit("DBSCAN verified"))).alias("n_verified"),
        F.count_if(F.contains(label, F.lit("(Cluster)"))).alias("n_clustered"),
        F.count_if(F.contains(label, F.lit("(Outlier)"))).alias("n_outlier"),
        F.count_if(F.contains(label, F.lit("Normal")) & F.col("is_uncertain") & ~F.col("is_novel")).alias("n_uncertain_normal"),
        pct(F.contains(label, F.lit("Normal"))).alias("pct_normal"),
    )


def predict(batch: DataFrame, model=None, mode: str = "hybrid", threshold: float | None = None, name: str = "mpi", clusters=None, fourier=None, dims: int = FEATURES, loadable: tuple[str, ...] = (*MODELS, CLUSTERS_ONLY)) -> DataFrame:
    """A request: row_id, x -> verdicts, by the rule, confidence, zero side and space of the named kind of model.

    mode: none, hybrid or pure. The model "dbscan" has no classifier, so it is always pure. A stored cluster model of
    another width than the space's isn't used. Rows of another width, or with values that aren't finite, are refused.
    """
    wrong = F.size("x") != dims
    seen = batch.agg(F.count("*").alias("n"), F.max(F.when(wrong, F.size("x"))).alias("other"), F.count_if(wrong).alias("wrong"), F.count_if(F.exists("x", lambda v: finite(v).isNull())).alias("odd")).first()
    check_request(name, mode, 0 if not seen["n"] else (seen["other"] if seen["wrong"] else dims), dims, loadable)
    if seen["odd"]:
        raise RequestError(400, "values must be finite")
    if mode == "pure" or name == CLUSTERS_ONLY:
        return pure(batch, dims)
    confidence, rule, at_zero_first, space = DECIDES[name]
    threshold = THRESHOLDS[name] if threshold is None else threshold
    scored = Scratch(batch.sparkSession, "request").write(scoring.score(batch, model, fourier).select("row_id", "scores"), "scored")
    verdicts = Scratch(batch.sparkSession, "request").write(plain(scored, confidence, rule, at_zero_first), "verdicts")
    if mode == "none":
        return verdicts.select("row_id", "predicted_class", "predicted_label", "confidence", "vote_map")
    width = 6 if space == "scores" else 4
    if clusters and all(len(c) == width for _, c in clusters):
        return hybrid_pretrained(verdicts, threshold, clusters, space=space)
    return hybrid_online(verdicts, threshold, space)


def class_summary(verdicts: DataFrame) -> DataFrame:
    """predicted_label, n."""
    return verdicts.groupBy("predicted_label").agg(F.count("*").alias("n"))


def breakdown(verdicts: DataFrame) -> DataFrame:
    """part, n, pct: the parts of a response; a row may be in several, and pct is of all rows."""
    label = F.col("predicted_label")
    if "is_outlier" in verdicts.columns:
        parts = {"clustered_samples": ~F.col("is_outlier"), "outliers": F.col("is_outlier")}
    else:
        unsure, novel = F.col("is_uncertain"), F.col("is_novel")
        parts = {"confident_predictions": ~unsure, "uncertain_normal": unsure & ~novel & F.contains(label, F.lit("Normal")), "dbscan_verified_attacks": F.contains(label, F.lit("DBSCAN verified")), "novel_unknown_attacks": novel}
    wide = verdicts.agg(F.count("*").alias("all"), *(F.count_if(c).alias(n) for n, c in parts.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("part"), F.col(n).alias("n")) for n in parts))
    long = wide.select("all", F.explode(rows).alias("x"))
    return long.select("x.part", "x.n", F.coalesce(F.round(100 * F.try_divide(F.col("x.n"), F.col("all")), 2), F.lit(0.0)).alias("pct"))


def predict_csv(lines: DataFrame, model=None, dims: int = FEATURES, **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """An uploaded CSV (line_no, value) -> verdicts by line, the summary of classes, and the breakdown where clusters were asked for."""
    from braidflow.sources.loaders import upload

    verdicts = predict(upload(lines, dims).withColumnRenamed("line_no", "row_id"), model, dims=dims, **options)
    return verdicts, class_summary(verdicts), None if "vote_map" in verdicts.columns else breakdown(verdicts)
