"""From scored rows to verdicts: routing, the clustering pool, cluster labels, and the profiles.

Rows have row_id, label, scores, votes, margins. In evaluation, rows whose true class is held out go
to the pool as anchors; in serving there are no labels, see serving.py.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidflow.functions.vectors import literal, sqdist
from braidflow.operators import scoring
from braidflow.operators.clustering import dbscan, kth_distances, knee_radius
from braidflow.operators.prep import first_rows, random_rows
from braidflow.operators.taxonomy import HOLDOUT, NORMAL, NOVEL, TRAINED, UNKNOWN
from braidflow.shared import Scratch


@dataclass(frozen=True)
class Profile:
    """How an evaluation routes, clusters and labels."""

    name: str
    confidence: str
    threshold: float
    rule: str
    normal_bypass: bool
    space: str
    eps: float | None  # None: from the knee of the k-distance curve
    min_samples: int
    near_normal: float
    unanchored: str  # distance: near the normal centroid; votes_and_distance; argmax_and_distance
    centroid_from: str  # predicted or true normal rows
    cap: int
    overflow_novel: bool
    random_cap: bool = False
    at_zero_first: bool = True
    strict: bool = False
    count_self: bool = True
    noise_keeps: bool = False
    unknown_keeps: bool = False

    @property
    def dims(self) -> int:
        return 6 if self.space == "scores" else 4


# The parameters of the five profiles.
PROFILES = {
    p.name: p
    for p in (
        Profile("pyspark", "margin", 0.5, "weighted", False, "margins", None, 8, 2.0, "distance", "predicted", 999_999, False, random_cap=True),
        Profile("cuda", "six", 0.5, "votes", False, "scores", 0.148, 8, 4.0, "distance", "true", 35_000, False, at_zero_first=False, strict=True, count_self=False),
        Profile("mpi", "votes", 0.8, "votes", True, "scores", 1.0, 8, 5.0, "votes_and_distance", "true", 110_000, True, noise_keeps=True),
        Profile("openmp", "votes", 0.67, "vote_margin", True, "votes", 1.1, 5, 1.5, "argmax_and_distance", "true", 110_000, True, unknown_keeps=True),
        Profile("thread", "margin", 0.5, "vote_margin", True, "margins", 0.148, 8, 7.0, "argmax_and_distance", "true", 110_000, True),
    )
}


def judge(scored: DataFrame, profile: Profile) -> DataFrame:
    """Adds votes, margins, pred, conf."""
    out = scoring.ballot(scored, profile.at_zero_first).withColumn("pred", scoring.predict(profile.rule))
    return out.withColumn("conf", scoring.confidence(profile.confidence))


def route(judged: DataFrame, profile: Profile) -> DataFrame:
    """Adds route: holdout, confident, normal (uncertain, yet taken as normal) or uncertain."""
    sure = scoring.confident(F.col("conf"), profile.threshold)
    bypass = F.lit(profile.normal_bypass) & (F.col("pred") == NORMAL)
    return judged.withColumn("route", F.when(F.col("label").isin(*HOLDOUT), "holdout").when(sure, "confident").when(bypass, "normal").otherwise("uncertain"))


def space(profile: Profile) -> Column:
    return F.col(profile.space).cast("array<double>")


def pool(routed: DataFrame, profile: Profile) -> DataFrame:
    """The rows to cluster: all holdout rows, then the uncertain ones up to the profile's cap, with id and v."""
    held = routed.where("route = 'holdout'")
    unsure = routed.where("route = 'uncertain'")
    unsure = random_rows(unsure, "row_id", profile.cap) if profile.random_cap else first_rows(unsure, "row_id", profile.cap)
    both = held.withColumn("anchor", F.lit(True)).unionByName(unsure.withColumn("anchor", F.lit(False)))
    # anchors come first in the order that numbers clusters; row ids stay under 2^61
    return both.select("row_id", "label", "pred", "anchor", (F.col("row_id") + F.when(F.col("anchor"), 0).otherwise(1 << 61)).alias("id"), space(profile).alias("v"))


def normal_centroid(routed: DataFrame, pooled: DataFrame, profile: Profile) -> list[float] | None:
    """The mean of the normal rows' vectors, one row; None where there are none."""
    mean = lambda df, c: df.agg(F.count("*").alias("n"), *(F.avg(c[k]).alias(f"m{k}") for k in range(profile.dims))).first()
    if profile.centroid_from == "true":
        row = mean(routed.where(F.col("label") == NORMAL), space(profile))
    else:
        unsure = pooled.where("NOT anchor")
        row = mean(unsure.where(F.col("pred") == NORMAL), F.col("v"))
        if not row["n"]:
            row = mean(unsure, F.col("v"))
    return [row[f"m{k}"] for k in range(profile.dims)] if row["n"] else None


def simulated_vote(centroid: Column) -> Column:
    """The class that a centroid of six scores would be given: most votes, ties to the lowest."""
    v = scoring.votes(centroid)
    return F.get(F.array(*map(F.lit, TRAINED)), (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def strongest(centroid: Column) -> Column:
    """The class of a four-place centroid's largest component, the first of equals."""
    return F.get(F.array(*map(F.lit, TRAINED)), (F.array_position(centroid, F.array_max(centroid)) - 1).cast("int"))


def label_clusters(clustered: DataFrame, normal: list[float] | None, profile: Profile) -> DataFrame:
    """clustered: cluster_id, anchor, label, v -> cluster_id, size, anchors, centroid, cluster_label.

    An anchored cluster takes the most frequent holdout class of its anchors (ties to the smallest); one
    without anchors is normal if it is near the normal centroid in the profile's sense, else unknown or what
    its centroid would be given. Without a normal centroid nothing is near it.
    """
    members = clustered.where("cluster_id >= 0")
    stats = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if("anchor").alias("anchors"), F.array(*(F.avg(F.col("v")[k]) for k in range(profile.dims))).alias("centroid"))
    votes = members.where("anchor").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    majority = votes.groupBy("cluster_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("majority"))
    c = F.col("centroid")
    near = sqdist(c, literal(normal)) < profile.near_normal**2 if normal else F.lit(False)
    if profile.unanchored == "distance":
        other = F.when(near, NORMAL).otherwise(UNKNOWN)
    elif profile.unanchored == "votes_and_distance":
        other = F.when((simulated_vote(c) == NORMAL) & near, NORMAL).otherwise(simulated_vote(c))
    else:
        other = F.when((strongest(c) == NORMAL) & near, NORMAL).otherwise(UNKNOWN)
    return stats.join(majority, "cluster_id", "left").select("cluster_id", "size", "anchors", "centroid", F.coalesce("majority", other).cast("int").alias("cluster_label"))


def cluster_pool(pooled: DataFrame, profile: Profile, eps: float | None = None, stored: bool = False) -> DataFrame:
    """Adds cluster_id. eps: in place of the profile's. stored: pooled is read from a table."""
    eps = eps or profile.eps
    if eps is None:
        found = knee_radius(kth_distances(pooled, profile.min_samples, profile.dims)).first()
        eps = found["eps"] if found and found["eps"] else 1e-9
    found = dbscan(pooled, eps, profile.min_samples, profile.dims, profile.strict, profile.count_self, stored)
    return pooled.join(found.select("id", "cluster_id"), "id")


def evaluate(scored: DataFrame, profile: Profile, eps: float | None = None) -> DataFrame:
    """scored: row_id, label, scores -> row_id, label, pred, conf, route, cluster_id, final."""
    scratch = Scratch(scored.sparkSession, "hybrid")
    routed = scratch.write(route(judge(scored, profile), profile).select("row_id", "label", "scores", "votes", "margins", "pred", "conf", "route"), "routed")
    pooled = scratch.write(pool(routed, profile), "pool")
    clustered = scratch.write(cluster_pool(pooled, profile, eps, True), "clustered")
    labels = label_clusters(clustered, normal_centroid(routed, pooled, profile), profile).select("cluster_id", "cluster_label")
    verdicts = clustered.join(labels, "cluster_id", "left").select("row_id", "cluster_id", "cluster_label")
    rows = routed.drop("scores", "votes", "margins").join(verdicts, "row_id", "left")
    noise = F.when((F.col("route") == "uncertain") & F.lit(profile.noise_keeps), F.col("pred")).otherwise(NOVEL)
    labelled = F.when((F.col("route") == "uncertain") & (F.col("cluster_label") == UNKNOWN) & F.lit(profile.unknown_keeps), F.col("pred")).otherwise(F.col("cluster_label"))
    overflow = F.lit(NOVEL) if profile.overflow_novel else F.col("pred")
    final = F.when(F.col("route") == "confident", F.col("pred")).when(F.col("route") == "normal", NORMAL).when(F.col("cluster_id").isNull(), overflow).when(F.col("cluster_id") < 0, noise).otherwise(labelled)
    return rows.select("row_id", "label", "pred", "conf", "route", "cluster_id", final.cast("int").alias("final"))
