"""Readers and writers: round trips, and what they refuse."""

import pytest

from braidflow.operators import prep, serving
from braidflow.sources import loaders, logs, sinks


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_feature_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k, [k + 0.25, -1.0 * k]) for k in range(50)], "row_id long, x array<double>")
    sinks.write_features(rows, str(tmp_path / "f"))
    back = loaders.feature_csv(spark, str(tmp_path / "f")).orderBy("row_id").collect()
    assert [r["x"] for r in back] == [[k + 0.25, -1.0 * k] for k in range(50)]
    sinks.write_labels(spark.createDataFrame([(k, k % 3) for k in range(50)], "row_id long, label int"), str(tmp_path / "l"))
    both = loaders.zip_labels(loaders.feature_csv(spark, str(tmp_path / "f")), loaders.label_csv(spark, str(tmp_path / "l")))
    assert {r["row_id"]: r["label"] for r in both.collect()} == {k: k % 3 for k in range(50)}


def test_ragged_features_are_an_error(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="numbers"):
        loaders.feature_csv(spark, str(tmp_path / "f.csv"), 2).collect()


def test_config(spark):
    text = lines(spark, "# c", "holdout_classes=9", "svm_class_ids=1, x,2")
    assert loaders.config_ids(text, "svm_class_ids") == [1, 2]
    assert loaders.config_ids(text, "holdout_class_ids") == [0, 1, 6]


def test_upload_without_header(spark):
    got = loaders.upload(lines(spark, "1,2,3", "4,5,6"), 3).collect()
    assert [r["x"] for r in got] == [[1, 2, 3], [4, 5, 6]]


def test_predictions_in_either_form(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2, -1), (1, 3, 3)], "row_id long, label int, final int")
    for columns, header in ((("final",), False), (("label", "final"), False), (("label", "final"), True)):
        sinks.write_predictions(rows, str(tmp_path / "p"), columns, header)
        back = loaders.numbered_lines(spark, str(tmp_path / "p")).selectExpr("row_id AS line_no", "value")
        assert sorted(r["predicted"] for r in logs.predictions(back).collect()) == [-1, 3]


def test_metrics_round_trip(spark):
    wide = spark.createDataFrame([(1.5, 2.0)], "a double, b double")
    assert sinks.wide_row(sinks.metric_rows(wide)).first().asDict() == {"a": 1.5, "b": 2.0}


def test_epoch_log_and_trailer(spark):
    text = lines(spark, "epoch,f1", "0,0.5", "10,0.7", "20,0.7", "best_f1,0.7")
    assert logs.best_epoch(logs.epoch_rows(text, ["epoch", "f1"]), "f1").first()["epoch"] == 10
    assert [(r["key"], r["value"]) for r in logs.trailer(text).where("key = 'best_f1'").collect()] == [("best_f1", 0.7)]
    assert logs.best_epoch(logs.epoch_rows(lines(spark, "0,0.0"), ["epoch", "f1"]), "f1").count() == 0


def test_requests_are_checked():
    for args, status in ((("none", "hybrid", 52), 400), (("mpi", "odd", 52), 400), (("mpi", "hybrid", 51), 400), (("mpi", "hybrid", 0), 400)):
        with pytest.raises(serving.RequestError) as e:
            serving.check_request(*args)
        assert e.value.status == status
    with pytest.raises(serving.RequestError) as e:
        serving.check_request("mpi", "hybrid", 52, loadable=())
    assert e.value.status == 503
    with pytest.raises(serving.RequestError) as e:
        serving.check_request("none", "none", 52, unknown=404)
    assert e.value.status == 404


def test_predictions_by_kind_of_model(spark):
    """Linear kinds count votes and give a zero to the second class; kernel kinds take margins and give it to the first."""
    from braidflow.operators.models import LinearPairs
    from braidflow.operators.taxonomy import PAIRS

    model = LinearPairs(PAIRS, ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)), (0.0,) * 6)
    batch = spark.createDataFrame([(0, [2.0, 3.0]), (1, [-1.0, 0.5])], "row_id long, x array<double>")
    by = lambda **k: serving.predict(batch, model, "none", dims=2, **k).orderBy("row_id").collect()
    linear, kernel = by(name="mpi"), by(name="thread")
    assert [(r["predicted_class"], r["confidence"]) for r in linear] == [(5, 1.0), (5, 1.0)]
    assert kernel[0]["predicted_class"] == 2 and kernel[0]["confidence"] == pytest.approx(5 / 3)
    for bad, kinds in (([(0, [1.0])], {}), ([], {}), ([(0, [1.0, float("nan")])], {}), ([(0, [1.0, 2.0])], {"name": "other"})):
        with pytest.raises(serving.RequestError) as e:
            serving.predict(spark.createDataFrame(bad, "row_id long, x array<double>"), model, dims=2, **kinds)
        assert e.value.status == 400
    assert "is_outlier" in serving.predict(batch, name="dbscan", dims=2).columns
    got = serving.predict(batch, model, "hybrid", dims=2, name="thread", clusters=[(0, [0.0] * 6)])
    assert "distance" not in got.columns  # stored clusters of another width aren't used
    got = serving.predict(batch, model, "hybrid", 9.0, dims=2, name="thread", clusters=[(3, [0.0] * 4)])
    assert "distance" in got.columns and all(r["cluster_id"] in (3, -1) for r in got.collect() if r["distance"] is not None)


def test_vectors_of_different_widths_are_an_error(spark):
    from braidflow.functions.vectors import dot

    rows = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="widths"):
        rows.select(dot(rows["a"], rows["b"])).collect()


def test_paths_maps_and_loggers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "map.txt").write_text("0:Bots [HOLDOUT]\n")
    found = loaders.first_path(spark, "map.txt", [str(tmp_path / "a"), str(tmp_path / "b")])
    assert found.endswith("b/map.txt") and loaders.first_path(spark, "no.txt", [str(tmp_path)]) == "no.txt"
    assert loaders.label_map_file(spark, found).count() == 1 and loaders.label_map_file(spark, str(tmp_path / "x")).count() == 0
    log = sinks.logger(str(tmp_path / "run.log"))
    log.info("one line")
    assert "one line" in (tmp_path / "run.log").read_text()
    fitted = {"a": (1.0, 2.0), "b": (0.0, 1.0)}
    assert sinks.read_scaler(sinks.scaler_rows(spark, fitted)) == fitted


def test_micro_batches_replace_their_own_result(spark, tmp_path):
    from braidflow.streaming import scoring as stream

    rows = spark.createDataFrame([(k, float(k)) for k in range(20)], "k int, x double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    read = stream.read(spark, str(tmp_path / "in"), rows.schema, 2)
    for _ in range(2):
        stream.each_batch(read, str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b.where("k % 2 = 0")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_single_row_requests(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "row_id long, x array<double>")
    got = serving.pure(one, 2).first()
    assert (got["is_outlier"], got["confidence"]) == (True, 0.0)


def test_cleaning_and_constant_features(spark):
    rows = spark.createDataFrame([(1.0, 5.0, " a "), (float("inf"), 5.0, "b"), (2.0, 5.0, "c"), (float("nan"), 5.0, "d"), (None, 5.0, "e")], "f double, g double, Label string")
    got = prep.ingest(rows)
    assert sorted(r["label"] for r in got.collect()) == ["a", "c"]
    assert {r["feature"]: r["kept"] for r in prep.variances(got, ["f", "g"]).collect()} == {"f": True, "g": False}
    with pytest.raises(ValueError):
        prep.label_column(rows.select("f"))
    assert prep.scaler(got, ["g"])["g"] == (5.0, 1.0)


def test_models_and_clusters_are_stored(spark, tmp_path):
    from braidflow.operators import models, service
    from braidflow.operators.taxonomy import PAIRS

    linear = models.LinearPairs(PAIRS, ((1.0, 2.0),) * 6, (0.5,) * 6, "final")
    assert service.load_model(spark, str(tmp_path / "none")) is None
    models.save(linear.table(spark), str(tmp_path / "m"))
    assert service.load_model(spark, str(tmp_path / "m")) == linear
    found = {r["model"]: r["loadable"] for r in service.loadable(spark, {"mpi": str(tmp_path / "m"), "cuda": str(tmp_path / "none")}).collect()}
    assert found == {"cuda": False, "mpi": True, "openmp": False, "thread": False, "pyspark": False}
    assert service.model_info(spark, "mpi", linear).first()["n_features"] == 2
    clusters = spark.createDataFrame([(0, [1.0, 2.0], 4), (1, [3.0, 4.0], -2)], "cluster_id int, centroid array<double>, cluster_label int")
    service.save_clusters(clusters, str(tmp_path / "c"), eps=1.0, min_samples=8)
    assert service.load_clusters(spark, str(tmp_path / "c"), 2) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert service.load_clusters(spark, str(tmp_path / "c"), 6) is None and service.load_clusters(spark, str(tmp_path / "x"), 2) is None
