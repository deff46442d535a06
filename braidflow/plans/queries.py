"""The registered queries: every operator on the driver's tables.

embeddings stand in for feature rows: labels 0 to 6 are the class ids, 2 to 5 of them trained. The model
of most queries is the diagonal discriminant, which SQL can follow. Doubles are rounded to six places.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.functions.vectors import doubles, rounded, total
from braidflow.operators import clustering, hybrid, metrics, prep, registry, scoring, service, serving, taxonomy, training
from braidflow.operators.hybrid import PROFILES
from braidflow.operators.models import Fourier, LinearPairs, centroid_pairs, class_moments, lda_pairs, prototype_kernel, save
from braidflow.operators.taxonomy import HOLDOUT, TRAINED
from braidflow.shared import Scratch, table
from braidflow.sources import loaders, logs, sinks
from braidflow.streaming import scoring as stream

DIMS = 64
#: Radii that suit the fixture's scores, in place of the profiles' own.
RADII = {"pyspark": None, "cuda": 0.9, "mpi": 1.0, "openmp": 1.1, "thread": 0.6}


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label BETWEEN 0 AND 6").select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"), doubles("embedding").alias("x"))


def trained(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where(F.col("label").isin(*TRAINED))


def lda(spark: SparkSession, d: str):
    return lda_pairs(class_moments(trained(spark, d), width=DIMS))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(rows(spark, d), lda(spark, d)).select("row_id", "label", "scores")


def judged(spark: SparkSession, d: str, name: str) -> DataFrame:
    return hybrid.judge(scored(spark, d), PROFILES[name])


def final(spark: SparkSession, d: str, name: str = "mpi") -> DataFrame:
    return hybrid.evaluate(scored(spark, d), PROFILES[name], RADII[name])


#: A second, intransitive scoring for the fixture: of trained rows a quarter score small, a quarter small and in a cycle, so that
#: every profile has unsure rows, clusters without anchors and noise; with these radii and caps also rows beyond the cap.
CYCLE = (0.35, -0.35, 0.35, 0.35, -0.35, 0.35)
MIXED = {"pyspark": (0.35, 150), "cuda": (0.35, 35), "mpi": (0.25, 30), "openmp": (1.1, 15), "thread": (0.35, 100)}


def mixed_scores(spark: SparkSession, d: str) -> DataFrame:
    quarter, trained_row = F.col("row_id") % 4, F.col("label").isin(*TRAINED)
    factor = F.when(~trained_row, 1.5).when(quarter == 0, 0.25).when(quarter == 1, 0.2).otherwise(0.5)
    cycle = F.array(*(F.when(trained_row & (quarter == 1), c).otherwise(0.0) for c in CYCLE))
    return scored(spark, d).select("row_id", "label", F.zip_with("scores", cycle, lambda x, c: x * factor + c).alias("scores"))


def mixed_profile(name: str) -> hybrid.Profile:
    return replace(PROFILES[name], eps=MIXED[name][0], cap=MIXED[name][1])


def mixed_final(spark: SparkSession, d: str, name: str) -> DataFrame:
    return hybrid.evaluate(mixed_scores(spark, d), mixed_profile(name))


def pool_points(spark: SparkSession, d: str) -> DataFrame:
    """The margin profile's pool in score space: id, v."""
    profile = replace(PROFILES["thread"], space="scores")
    routed = hybrid.route(judged(spark, d, "thread"), profile).select("row_id", "label", "scores", "pred", "route")
    return hybrid.pool(Scratch(spark, "pool").write(routed, "routed"), profile).select("id", "v")


# ---- preparation


def class_distribution(spark, d):
    return prep.distribution(rows(spark, d), "label")


def rare_class_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return prep.frequent_classes(docs, "lang", 150).groupBy("lang").agg(F.count("*").alias("n"))


def label_encode(spark, d):
    return prep.encode(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "event_type", F.col("code").cast("int").alias("code"))


def _dirty(spark, d):
    bad = F.when(F.col("l_orderkey") % 97 == 0, float("inf")).when(F.col("l_orderkey") % 89 == 0, float("nan")).when(F.col("l_orderkey") % 83 == 0, float("-inf"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(bad, "l_extendedprice").alias("price"), "l_quantity", F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias("Label"))


def clean_nonfinite(spark, d):
    return prep.clean(_dirty(spark, d), ["price", "l_quantity"], "Label").groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"), F.sum("l_quantity").alias("quantity"))


def ingest(spark, d):
    out = prep.ingest(_dirty(spark, d))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("price"), 2).alias("most"), F.max("l_linenumber").alias("lines"))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def feature_variance_mask(spark, d):
    items = table(spark, d, "lineitem").select(*LINE, F.lit(7.0).alias("constant"))
    return prep.variances(items, [*LINE, "constant"]).select("feature", F.round("variance", 4).alias("variance"), "kept")


def standardize(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return prep.standardize(items, prep.scaler(items, LINE)).select("l_orderkey", "l_linenumber", *(r6(c).alias(c) for c in LINE))


def class_weights(spark, d):
    return prep.class_weights(trained(spark, d), "label").select("label", "n", r6("weight").alias("weight"))


def stratified_split(spark, d):
    return prep.stratified_split(rows(spark, d), "label", "row_id").select("row_id", "label", "split")


def undersample(spark, d):
    return prep.undersample(rows(spark, d), "label", "row_id", {2: 10, 3: 15, 4: 30}).select("row_id", "label")


def balanced_pair_sample(spark, d):
    return prep.balanced_pair(rows(spark, d), "label", "row_id", 2, 5, 40).select("row_id", "label", "y")


def class_subsample(spark, d):
    return prep.per_class(rows(spark, d), "label", "row_id", 20).select("row_id", "label")


def first_n_cap(spark, d):
    return prep.first_rows(rows(spark, d), "row_id", 100).select("row_id", "label")


def random_cap(spark, d):
    return prep.random_rows(rows(spark, d), "row_id", 100).select("row_id", "label")


def holdout_spill(spark, d):
    split = prep.stratified_split(rows(spark, d), "label", "row_id")
    train, test = prep.spill_holdout(split.where("split = 'train'"), split.where("split = 'test'"), "label", HOLDOUT)
    return train.select("row_id", "label", F.lit("train").alias("part")).unionByName(test.select("row_id", "label", F.lit("test").alias("part")))


def remap_classes(spark, d):
    return taxonomy.remap(rows(spark, d)).select("row_id", "label", "internal_id")


def class_names(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), taxonomy.name_of(F.col("label")).alias("name"))


# ---- models and scores


def pair_models_centroid(spark, d):
    return centroid_pairs(class_moments(trained(spark, d), width=DIMS)).table(spark).select("pair", "pos", "neg", rounded(F.col("w")).alias("w"), r6("b").alias("b"))


def pair_models_lda(spark, d):
    return lda(spark, d).table(spark).select("pair", "pos", "neg", rounded(F.col("w")).alias("w"), r6("b").alias("b"))


def pair_scores(spark, d):
    return scored(spark, d).select("row_id", F.posexplode("scores").alias("pair", "score")).select("row_id", "pair", r6("score").alias("score"))


def ovo_votes(spark, d):
    return judged(spark, d, "mpi").select("row_id", *(F.col("votes")[k].alias(f"v{c}") for k, c in enumerate(TRAINED)))


def ovo_margins(spark, d):
    return judged(spark, d, "mpi").select("row_id", *(r6(F.col("margins")[k]).alias(f"m{c}") for k, c in enumerate(TRAINED)))


def ovo_predict(spark, d):
    b = scoring.ballot(scored(spark, d))
    return b.select("row_id", *(scoring.predict(r).cast("int").alias(f"by_{r}") for r in ("votes", "vote_margin", "weighted")))


def confidences(spark, d):
    b = judged(spark, d, "openmp")
    return b.select("row_id", *(r6(scoring.confidence(k)).alias(f"by_{k}") for k in ("votes", "six", "margin")))


def one_vs_all(spark, d):
    place, best = scoring.one_vs_all()
    return scored(spark, d).select("row_id", place.alias("place"), r6(best).alias("best"))


def score_maps(spark, d):
    b = judged(spark, d, "mpi").select("row_id", scoring.score_map().alias("votes"))
    return b.select("row_id", F.explode("votes").alias("name", "margin")).select("row_id", "name", r6("margin").alias("margin"))


def rbf_scores(spark, d):
    model = prototype_kernel(rows(spark, d), 5)
    return scoring.score(rows(spark, d), model).select("row_id", F.posexplode("scores").alias("pair", "score")).select("row_id", "pair", r6("score").alias("score"))


def rff_map(spark, d):
    z = scoring.fourier_features(Fourier.formula(DIMS, 8))
    return rows(spark, d).select("row_id", F.posexplode(z).alias("j", "z")).select("row_id", "j", r6("z").alias("z"))


def route_rows(spark, d):
    return hybrid.route(judged(spark, d, "thread"), PROFILES["thread"]).select("row_id", "pred", "route")


# ---- metrics


def confusion_matrix(spark, d):
    return metrics.confusion(final(spark, d))


def _prf(variant):
    def query(spark, d):
        out = metrics.per_class(final(spark, d, "thread"), variant)
        return out.select("class_id", "tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))

    return query


def macro_f1(spark, d):
    return metrics.macro_f1(final(spark, d, "thread"), "trained").select(r6("macro_f1").alias("macro_f1"))


def _rates(name):
    def query(spark, d):
        out = metrics.rates(final(spark, d, name), far_counts_unknown=name == "thread")
        return out.select(*(r6(c).alias(c) for c in out.columns))

    return query


def detection_by_class(spark, d):
    return metrics.detection_by_class(final(spark, d, "thread")).select(F.col("label").alias("class_id"), "n", "identified", "novel")


def pool_breakdown(spark, d):
    return metrics.breakdown(final(spark, d, "thread"))


def mean_confidence(spark, d):
    return judged(spark, d, "thread").agg(r6(F.avg("conf")).alias("mean_confidence"))


def quality_as_truth(spark, d):
    """Precision and recall of toxic labels taken as a guess at bad quality."""
    labels = table(spark, d, "labels")
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return labels.agg(n(0, 1).alias("tp"), n(1, 1).alias("fp"), n(0, 0).alias("fn")).select("*", r6(metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), r6(metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"))


# ---- clustering


def neighbour_counts(spark, d):
    return clustering.neighbour_counts(pool_points(spark, d), 1.0, 6).select(F.col("first").alias("id"), "m", "n")


def dbscan_clusters(spark, d):
    return clustering.dbscan(pool_points(spark, d), 0.7, 5, 6).select("id", "cluster_id", "core")


def dbscan_strict(spark, d):
    return clustering.dbscan(pool_points(spark, d), 0.7, 5, 6, strict=True, count_self=False).select("id", "cluster_id", "core")


def kth_distance(spark, d):
    return clustering.kth_distances(pool_points(spark, d), 8, 6).select("id", r6("kdist").alias("kdist"))


def knee_radius(spark, d):
    return clustering.knee_radius(clustering.kth_distances(pool_points(spark, d), 8, 6)).select(r6("eps").alias("eps"))


def percentile_radius(spark, d):
    eps = clustering.percentile_radius(pool_points(spark, d))
    return spark.createDataFrame([(round(eps, 6),)], "eps double")


def cluster_centroids(spark, d):
    points = pool_points(spark, d)
    found = clustering.dbscan(points, 0.7, 5, 6).where("cluster_id >= 0").join(points, "id")
    return clustering.centroids(found, 6).select("cluster_id", "size", F.posexplode("centroid").alias("place", "mean")).select("cluster_id", "size", "place", r6("mean").alias("mean"))


def nearest_centroid(spark, d):
    m = class_moments(trained(spark, d), width=DIMS)
    model = [(c, m[c][0].tolist()) for c in TRAINED]
    points = rows(spark, d).select(F.col("row_id").alias("id"), F.col("x").alias("v"))
    return clustering.nearest_centroid(points, model).select("id", "cluster_id", r6("distance").alias("distance"))


def _final(name):
    def query(spark, d):
        return final(spark, d, name).select("row_id", "label", "pred", "route", "cluster_id", "final")

    return query


def _mixed(name):
    def query(spark, d):
        return mixed_final(spark, d, name).select("row_id", "label", "pred", "route", "cluster_id", "final")

    return query


def cluster_labels(spark, d):
    return _labels(scored(spark, d), replace(PROFILES["thread"], eps=RADII["thread"]))


def cluster_labels_mixed(spark, d):
    return _labels(mixed_scores(spark, d), mixed_profile("thread"))


def _labels(scores: DataFrame, p: hybrid.Profile) -> DataFrame:
    scratch = Scratch(scores.sparkSession, "labels")
    routed = scratch.write(hybrid.route(hybrid.judge(scratch.write(scores, "scores"), p), p).select("row_id", "label", "scores", "votes", "margins", "pred", "conf", "route"), "routed")
    pooled = scratch.write(hybrid.pool(routed, p), "pool")
    clustered = hybrid.cluster_pool(pooled, p, stored=True)
    return hybrid.label_clusters(clustered, hybrid.normal_centroid(routed, pooled, p), p).select("cluster_id", "size", "anchors", "cluster_label")


# ---- serving


def serve_plain(spark, d):
    v = serving.plain(scored(spark, d))
    return v.select("row_id", F.col("predicted_class").cast("int").alias("predicted_class"), "predicted_label", r6("confidence").alias("confidence"))


def _margin_verdicts(spark, d):
    return Scratch(spark, "verdicts").write(serving.plain(scored(spark, d), "margin", "vote_margin"), "verdicts")


def serve_hybrid_online(spark, d):
    return serving.hybrid_online(_margin_verdicts(spark, d), 0.5).select("row_id", "predicted_label", "is_uncertain", "is_novel", "cluster_id")


def serve_hybrid_pretrained(spark, d):
    by_class = scored(spark, d).where(F.col("label").isin(*HOLDOUT)).groupBy("label").agg(F.array(*(F.avg(F.col("scores")[k]) for k in range(6))).alias("c"))
    model = [(r["label"], r["c"]) for r in by_class.collect()]  # a row for each class
    return serving.hybrid_pretrained(_margin_verdicts(spark, d), 0.5, model).select("row_id", "predicted_label", "is_uncertain", "is_novel", "cluster_id", r6("distance").alias("distance"))


def serve_summary(spark, d):
    return serving.summary(serving.hybrid_online(_margin_verdicts(spark, d), 0.5))


def _request(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), doubles("embedding").alias("x"))


def serve_pure(spark, d):
    return serving.predict(_request(spark, d), name="dbscan", dims=DIMS).select("row_id", "predicted_label", "cluster_id", "is_outlier", r6("confidence").alias("confidence"))


#: A confidence that some of the kernel model's attack rows reach.
KERNEL_THRESHOLD = 0.012


def serve_kernel(spark, d):
    found = serving.predict(rows(spark, d), prototype_kernel(rows(spark, d), 5), "hybrid", KERNEL_THRESHOLD, "thread", dims=DIMS)
    return found.select("row_id", F.col("predicted_class").cast("int").alias("predicted_class"), "predicted_label", "is_uncertain", "is_novel", "cluster_id")


def _upload(spark, d):
    """The embeddings as an uploaded CSV: a header, then a row for each vector."""
    body = table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("line_no"), F.array_join(F.transform(doubles("embedding"), lambda x: x.cast("string")), ",").alias("value"))
    return lines(spark, ",".join(f"f{k}" for k in range(DIMS))).unionByName(body)


def serve_csv(spark, d):
    """Of an upload the class summary and the breakdown, as one table."""
    linear = lda(spark, d)
    shifted = replace(linear, b=tuple(b + c for b, c in zip(linear.b, CYCLE, strict=True)))
    _, summary, parts = serving.predict_csv(_upload(spark, d), shifted, DIMS, mode="hybrid", name="mpi")
    return summary.select(F.lit("class").alias("kind"), F.col("predicted_label").alias("name"), "n", F.lit(None).cast("double").alias("pct")).unionByName(parts.select(F.lit("part").alias("kind"), F.col("part").alias("name"), "n", "pct"))


def validation_clusters(spark, d):
    judged_rows = Scratch(spark, "validation").write(hybrid.judge(mixed_scores(spark, d), PROFILES["cuda"]), "judged")
    return training.validation_clusters(judged_rows, eps=0.35)


def cluster_counts(spark, d):
    return clustering.cluster_counts(clustering.dbscan(pool_points(spark, d), 0.7, 5, 6))


def gradient_sums(spark, d):
    return training.gradient_sums(trained(spark, d), lda(spark, d), training.CLASS_WEIGHTS["mpi"]).select("pair", "place", F.round("gradient", 4).alias("gradient"))


def rbf_scores_wide(spark, d):
    """So many support vectors that the expanded distances of a matrix product are used."""
    return scoring.score(rows(spark, d), prototype_kernel(rows(spark, d), 30)).select("row_id", F.posexplode("scores").alias("pair", "score")).select("row_id", "pair", r6("score").alias("score"))


# ---- files and models, written and read again


def feature_files(spark, d):
    base = Scratch(spark, "files").base
    sinks.write_features(rows(spark, d), f"{base}/x")
    sinks.write_labels(rows(spark, d), f"{base}/y")
    both = loaders.zip_labels(loaders.feature_csv(spark, f"{base}/x", DIMS), loaders.label_csv(spark, f"{base}/y"))
    return both.select("row_id", "label", F.round(total(F.col("x")), 5).alias("total"))


def prediction_files(spark, d):
    """The verdicts in each of the three formats."""
    base, found = Scratch(spark, "predictions").base, final(spark, d, "thread")
    parts = []
    for k, (columns, header) in enumerate(((("final",), False), (("label", "final"), False), (("label", "final"), True))):
        sinks.write_predictions(found, f"{base}/{k}", columns, header)
        read = logs.predictions(loaders.numbered_lines(spark, f"{base}/{k}").selectExpr("row_id AS line_no", "value"))
        parts.append(read.groupBy("original", "predicted").agg(F.count("*").alias("n")).select(F.lit(k).alias("format"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def metric_files(spark, d):
    """One wide row of rates to metric rows and back."""
    wide = metrics.rates(final(spark, d, "thread"))
    return sinks.wide_row(sinks.metric_rows(wide)).select(*(r6(c).alias(c) for c in wide.columns))


def linear_model_files(spark, d):
    base, model = Scratch(spark, "models").base, lda(spark, d)
    save(model.table(spark), f"{base}/linear")
    return scoring.score(rows(spark, d), service.load_model(spark, f"{base}/linear")).select("row_id", F.posexplode("scores").alias("pair", "score")).select("row_id", "pair", r6("score").alias("score"))


def kernel_model_files(spark, d):
    base, model = Scratch(spark, "models").base, prototype_kernel(rows(spark, d), 5)
    save(model.table(spark), f"{base}/kernel")
    return scoring.score(rows(spark, d), service.load_model(spark, f"{base}/kernel")).select("row_id", F.posexplode("scores").alias("pair", "score")).select("row_id", "pair", r6("score").alias("score"))


def fourier_model_files(spark, d):
    """A stored projection, read with the check of its width; its features."""
    base, made = Scratch(spark, "models").base, Fourier.formula(DIMS, 8)
    save(made.table(spark), f"{base}/fourier")
    read = Fourier.of(spark.read.parquet(f"{base}/fourier"), DIMS, LinearPairs(((2, 3),), ((0.0,) * 8,), (0.0,)))
    return rows(spark, d).select("row_id", F.posexplode(scoring.fourier_features(read)).alias("j", "z")).select("row_id", "j", r6("z").alias("z"))


def cluster_model_files(spark, d):
    """Class means of the scores, stored as a cluster model and read again; the nearest of each row's scores."""
    base = Scratch(spark, "models").base
    mean = F.array(*(F.avg(F.col("scores")[k]) for k in range(6)))
    centre = scored(spark, d).where(F.col("label").isin(*TRAINED)).groupBy(F.col("label").alias("cluster_id")).agg(mean.alias("centroid"))
    service.save_clusters(centre.withColumn("cluster_label", F.col("cluster_id")), f"{base}/clusters", eps=1.0)
    points = scored(spark, d).select(F.col("row_id").alias("id"), F.col("scores").alias("v"))
    return clustering.nearest_centroid(points, service.load_clusters(spark, f"{base}/clusters", 6)).select("id", "cluster_id", r6("distance").alias("distance"))


def scaler_state(spark, d):
    items = table(spark, d, "lineitem").select(*LINE)
    rows_ = sinks.scaler_rows(spark, prep.scaler(items, LINE))
    return rows_.select("position", "feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


def weight_lines(spark, d):
    return sinks.weight_lines(prep.class_weights(trained(spark, d), "label"))


def config_lines(spark, d):
    """Feature names and the run's configuration as lines."""
    n = rows(spark, d).count()
    made = sinks.config_lines(list(HOLDOUT), list(TRAINED), taxonomy.NAMES, n_classes_total=len(taxonomy.NAMES), n_test=n)
    return sinks.name_lines(spark, LINE).select(F.lit("names").alias("file"), "line_no", "value").unionByName(lines(spark, *made).select(F.lit("config").alias("file"), F.col("line_no").cast("int"), "value"))


def epoch_log_lines(spark, d):
    return sinks.epoch_log_lines(spark, list(EPOCHS), ["epoch", "lr", "train_loss", "val_macro_f1"], best_f1=0.81052)


def epoch_trailer(spark, d):
    return logs.trailer(epoch_log_lines(spark, d)).select("key", "value")


def json_responses(spark, d):
    found = serve_plain(spark, d).select("row_id", "predicted_class", "predicted_label")
    return sinks.response(found)


def served_models(spark, d):
    base = Scratch(spark, "models").base
    save(lda(spark, d).table(spark), f"{base}/mpi")
    return service.loadable(spark, {"mpi": f"{base}/mpi", "cuda": f"{base}/none"})


def model_info(spark, d):
    return service.model_info(spark, "mpi", lda(spark, d))


# ---- sources and logs, on small literal inputs


def lines(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def parse_config(spark, d):
    found = loaders.run_config(lines(spark, "# run", "", "holdout_class_ids=0,1,6", "svm_class_ids = 2, 3,4,5", "n_test=756226", "note=a=b"))
    return found.select("key", "value", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def parse_label_map(spark, d):
    return loaders.label_map(lines(spark, "0:Bots [HOLDOUT]", "2: DDoS", "x:none", "4:Normal:Traffic"))


def parse_upload(spark, d):
    found = loaders.upload(lines(spark, "", "a,b,c", "1,2,3,4", " 5 , 6,7", "8,9", "x,1,2"), 3)
    return found.select("line_no", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


def parse_pasted(spark, d):
    found = loaders.pasted(lines(spark, "# block", "1, 2, x, 3", "", "4,5", "6,7,8,9"), 3)
    return found.select("line_no", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


def parse_section(spark, d):
    return loaders.section(lines(spark, "top", "== PortScan ==", "1,2", "end"), "PortScan")


def parse_json_features(spark, d):
    one = loaders.json_features(spark.createDataFrame([('{"model": "mpi", "features": [[1, 2.5], [3, 4]]}',), ('{"features": [5, 6]}',)], "body string"))
    return one.select("row_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


LOG = """Technique: hybrid
Train: 588,717 | Test: 756,226 | Features: 52 | Classes: 4
Train Accuracy: 97.25%
SVM training: 3072.4 ms
SVM prediction (all rows): 7130.3 ms
DBSCAN: 578.4 ms
Time: 18985.7 ms
GFLOPS: 10.7606
FLOP Count: 204,296,972,507
Confident: 749,343 | Uncertain: 2,911
Clusters: 42 | Noise: 713
"""


def parse_run_log(spark, d):
    return logs.run_log(spark.createDataFrame([("a", LOG), ("b", "Timing: Train=1.5 ms Predict=2 ms DBSCAN=3 ms Total=6.5 ms")], "model string, text string"))


# Results of two engines as their logs state them.
METRIC_LOG = (
    ("mpi", "n_test", "765495"), ("mpi", "macro_f1_hybrid", "0.832682"), ("mpi", "accuracy_hybrid", "0.923256"), ("mpi", "n_clusters", "42"),
    ("mpi", "predict_ms", "3457.93"), ("mpi", "dbscan_ms", "1712.97"), ("mpi", "total_ms", "5300.69"), ("mpi", "svm_gflops", "0.138137"), ("mpi", "dbscan_gflops", "3.61641"), ("mpi", "broken", "n/a"),
    ("openmp", "macro_f1_hybrid", "0.831914"), ("openmp", "holdout_detection_rate", "0.91549"), ("openmp", "predict_ms", "37.8494"), ("openmp", "total_time_ms", "3541.19"), ("openmp", "predict_gflops", "12.6203"), ("openmp", "dbscan_gflops", "26.2032"),
)


def latest_log(spark, d):
    texts = [("a/train_10.out", "Total Train Time : 5 ms"), ("a/train_9.out", "=== Summary ===\n  Total Train Time : 22,658.62 ms (22.66 s)\n  Effective GFLOPS : 63.085"), ("a/train_8.out", "x")]
    return logs.latest_values(spark.createDataFrame(texts, "path string, text string"))


# The published summary of one engine, and part of another's.
WIDE_SUMMARY = "technique,n_train,n_test,accuracy,total_ms\nfirst,1,2,3.5,4.5\nPySpark_3w,588717,756226,94.4775,18985.7"
VERTICAL_SUMMARY = (("technique", "cppthread"), ("total_ms", "36787.6"), ("gflops", "38.9949"))


def wide_summary(spark, d):
    header, *body = WIDE_SUMMARY.split("\n")
    parts = F.split("value", ",")
    cells = lines(spark, *body).select("line_no", *(parts[k].alias(c) for k, c in enumerate(header.split(","))))
    return logs.wide_summary(cells).select("technique", *(F.col(c).cast("bigint").alias(c) for c in ("n_train", "n_test")), *(F.col(c).cast("double").alias(c) for c in ("accuracy", "total_ms")))


def vertical_summary(spark, d):
    found = logs.vertical_summary(spark.createDataFrame([("thread", k, v) for k, v in VERTICAL_SUMMARY], "model string, key string, value string"))
    return found.select("model", F.explode("metrics").alias("key", "value"))


def flop_models(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.lit(250.0).alias("ms"))
    flops = {"linear": registry.linear_flops(F.col("n")), "kernel": registry.kernel_flops(F.col("n"), F.lit(600)), "pairwise": registry.pairwise_flops(F.col("n"), 6)}
    parts = F.array(*(F.struct(F.lit(k).alias("what"), c.cast("bigint").alias("flops")) for k, c in flops.items()))
    long = n.select("n", "ms", F.explode(parts).alias("x"))
    return long.select("x.what", "x.flops", F.round(registry.gflops(F.col("x.flops"), F.col("ms")), 6).alias("gflops"), F.round(registry.throughput(F.col("n"), F.col("ms")), 6).alias("rows_per_s"))


DURATIONS = (None, 0.0, 12.4, 999.4, 1000.0, 22658.62, 59_900.0, 90_000.0, 7_200_000.0)


def shown_durations(spark, d):
    out = spark.createDataFrame([(k, x) for k, x in enumerate(DURATIONS)], "k int, ms double")
    return out.select("k", registry.shown_duration(F.col("ms")).alias("duration"), registry.shown_number(F.col("ms")).alias("number"))


def legacy_bypass(spark, d):
    found = serving.hybrid_online(_margin_verdicts(spark, d), 0.5, normal_too=True)
    return serving.legacy_bypass(found).groupBy("predicted_class", "is_uncertain").agg(F.count("*").alias("n")).select(F.col("predicted_class").cast("int").alias("predicted_class"), "is_uncertain", "n")


def parse_metric_log(spark, d):
    found = logs.metric_log(spark.createDataFrame([(m, k, n, v) for k, (m, n, v) in enumerate(METRIC_LOG)], "model string, line_no int, metric string, value string"))
    return found.select("model", *(r6(c).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes if c != "model"))


EPOCHS = ((0, 0.05, 0.61, 0.70), (10, 0.049, 0.52, 0.81), (20, 0.047, 0.44, 0.8105), (30, 0.044, 0.45, 0.81052), (40, 0.04, 0.41, 0.8105), (50, 0.035, 0.4, 0.79))


def best_epoch(spark, d):
    text = lines(spark, "epoch,lr,train_loss,val_macro_f1", *(",".join(map(str, e)) for e in EPOCHS), "best_f1,0.81052")
    return logs.best_epoch(logs.epoch_rows(text, ["epoch", "lr", "train_loss", "val_macro_f1"])).select("epoch", "train_loss", "val_macro_f1")


def early_stopping(spark, d):
    return logs.improvements(spark.createDataFrame([(e, f) for e, _, _, f in EPOCHS], "epoch int, f1 double"), 1e-4, 3)


# The published results that the registry compares.
MODELS = (
    ("cuda", 95.54, 22658.62, 22658.62, 474.028, 63.085), ("mpi", 92.3256, 5300.69, 2014.76, 3457.93, 3.75455),
    ("openmp", 92.4066, 3541.19, 2159.47, 37.8494, 38.8235), ("thread", 82.33, 36787.6, 1.30649, 32023.6, 38.9949), ("pyspark", 94.4775, 18985.7, 3072.4, 7130.3, 10.7606),
)


def models(spark):
    return spark.createDataFrame(MODELS, "model string, accuracy double, total_ms double, train_ms double, predict_ms double, gflops double")


def registry_overview(spark, d):
    return registry.overview(models(spark)).withColumn("avg_accuracy", r6("avg_accuracy"))


def registry_comparison(spark, d):
    return registry.comparison(models(spark))


def speedups(spark, d):
    return registry.speedups(models(spark)).withColumn("ratio", r6("ratio"))


def cosine_rate(spark, d):
    return training.rate_table(spark)


def shown_labels(spark, d):
    labels = ("Novel: DoS (Cluster 12)", "Cluster 3", "PortScan (Outlier)", "NormalTraffic", "Unknown (Outlier)", "DoS (Unverified)")
    out = spark.createDataFrame([(k, x, k % 2 == 0, k % 3 == 0, 0.1 * k + 0.2) for k, x in enumerate(labels)], "k int, label string, unsure boolean, novel boolean, conf double")
    return out.select("k", serving.shown(F.col("label")).alias("shown"), serving.base_label(F.col("label")).alias("base"), serving.verdict_class(F.col("label"), F.col("unsure"), F.col("novel"), F.col("conf")).alias("verdict"))


# ---- trainers, whose results SQL can't follow


def _trained(fit):
    def query(spark, d):
        model = fit(rows(spark, d).where(F.col("label").isin(*TRAINED)))
        out = scoring.score(rows(spark, d), model)
        return hybrid.judge(out, PROFILES["openmp"]).groupBy("label", "pred").agg(F.count("*").alias("n"))

    return query


def train_validated_log(spark, d):
    train = prep.stratified_split(trained(spark, d), "label", "row_id").where("split = 'train'").drop("split")
    split = prep.stratified_split(train, "label", "row_id")  # a part of the training rows validates
    _, _, log = training.train_validated(split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split"), 3, 20)
    return spark.createDataFrame([tuple(map(float, r)) for r in log], "epoch double, rate double, accuracy double, macro_f1 double")


def prediction_distribution(spark, d):
    return service.prediction_distribution(judged(spark, d, "mpi").select(F.col("pred").alias("predicted")))


def epoch_errors(spark, d):
    return service.epoch_errors(lines(spark, "class_a,class_b,epoch,train_errors,n_train,val_errors,n_val", "2,3,0,10,100,5,20", "2,3,1,4,100,x,20", "2,4,0,0,0,1,4"))


def accuracy_csv(spark, d):
    return service.accuracy_csv(lines(spark, "train,test", "0.93,0.91", "1,1"))


def train_rff(spark, d):
    fourier = Fourier.draw(DIMS, 256, 0.5)
    model = training.train_fourier(rows(spark, d), fourier, 60)
    out = scoring.score(rows(spark, d), model, fourier)
    return hybrid.judge(out, PROFILES["cuda"]).groupBy("label", "pred").agg(F.count("*").alias("n"))


def principal_components(spark, d):
    return training.principal_components(rows(spark, d), 3).select("row_id", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


def stream_counts(spark, d):
    """The events table as a stream, drained at once: hourly counts by type."""
    base = Scratch(spark, "stream").base
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    events.repartition(4).write.parquet(f"{base}/in")
    hourly = stream.read(spark, f"{base}/in", events.schema).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    written = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        written.append(number)

    q = hourly.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out/{written[-1]}").select(F.col("window.start").alias("start"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        class_distribution, rare_class_filter, label_encode, clean_nonfinite, ingest, feature_variance_mask, standardize, class_weights, stratified_split, undersample, balanced_pair_sample,
        class_subsample, first_n_cap, random_cap, holdout_spill, remap_classes, class_names, pair_models_centroid, pair_models_lda, pair_scores, ovo_votes, ovo_margins, ovo_predict, confidences,
        one_vs_all, score_maps, rbf_scores, rff_map, route_rows, confusion_matrix, macro_f1, detection_by_class, pool_breakdown, mean_confidence, quality_as_truth, neighbour_counts, dbscan_clusters,
        dbscan_strict, kth_distance, knee_radius, percentile_radius, cluster_centroids, nearest_centroid, cluster_labels, serve_plain, serve_hybrid_online, serve_hybrid_pretrained, serve_summary,
        serve_pure, parse_config, parse_label_map, parse_upload, parse_pasted, parse_section, parse_json_features, parse_run_log, parse_metric_log, best_epoch, early_stopping, registry_overview,
        registry_comparison, speedups, cosine_rate, shown_labels, train_rff, train_validated_log, prediction_distribution, epoch_errors, accuracy_csv, principal_components, stream_counts,
        cluster_labels_mixed, serve_kernel, serve_csv, validation_clusters, cluster_counts, gradient_sums, rbf_scores_wide, feature_files, prediction_files, metric_files, linear_model_files, kernel_model_files,
        fourier_model_files, cluster_model_files, scaler_state, weight_lines, config_lines, epoch_log_lines, epoch_trailer, json_responses, served_models, model_info, latest_log, wide_summary, vertical_summary,
        flop_models, shown_durations, legacy_bypass,
    )
} | {
    **{f"per_class_prf_{v}": _prf(v) for v in ("all", "trained", "restricted")},
    **{f"hybrid_final_{p}": _final(p) for p in PROFILES},
    **{f"hybrid_mixed_{p}": _mixed(p) for p in PROFILES},
    **{f"hybrid_rates_{p}": _rates(p) for p in PROFILES},
    "train_linear_adam": _trained(lambda r: training.train_linear(r, training.CLASS_WEIGHTS["openmp"], 120)),
    "train_linear_all": _trained(lambda r: training.train_linear_all(r, epochs=10)),
    "train_linear_svc": _trained(training.train_svc),
    "train_kernel_smo": _trained(lambda r: training.train_kernel(r, 1.0)),
    "train_kernel_sgd": _trained(lambda r: training.train_kernel(r, 1.0, "sgd", 400)),
}
