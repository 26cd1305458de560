import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import model
from tallyscope.operators.features import allowlist, assert_feature_contract
from tallyscope.settings import FEATURE_ORDER


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(f"a{i:04d}", *map(float, rng.normal(10, 1, len(FEATURE_ORDER)))) for i in range(600)]
    rows.append(("odd", *([40.0] * len(FEATURE_ORDER))))
    return spark.createDataFrame(rows, "address string, " + ", ".join(f"{n} double" for n in FEATURE_ORDER))


@pytest.fixture(scope="module")
def fitted(frame):
    return model.fit_model(frame, trees=60)


def test_outlier_ranks_first(frame, fitted):
    scores, status, error = model.score_addresses(frame, fitted)
    top = scores.orderBy(F.desc("anomaly_score")).first()
    assert (status, error, top.address) == ("used", None, "odd") and top.anomaly_percentile > 99


def test_percentile_is_the_midpoint_rank(spark):
    reference = spark.createDataFrame([(1.0, 2), (2.0, 1), (5.0, 1)], "score double, weight bigint")
    values = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 3.0), ("d", 9.0)], "address string, anomaly_score double")
    got = {r.address: r.anomaly_percentile for r in model.percentile_rank(values, reference).collect()}
    assert got == {"a": 0.0, "b": 25.0, "c": 75.0, "d": 100.0}


def test_non_finite_features_stay_unscored(spark, frame, fitted):
    broken = frame.withColumn("tx_count", F.when(F.col("address") == "odd", F.lit(float("nan"))).otherwise(F.col("tx_count")))
    row = model.score_addresses(broken, fitted)[0].where("address = 'odd'").first()
    assert row.anomaly_score is None and row.unscored_reason


def test_without_model_rules_go_on(frame):
    scores, status, _ = model.score_addresses(frame, None)
    assert status == "unavailable" and scores.where("anomaly_score is not null").isEmpty()


def test_tables_round_trip_and_tampering_is_noticed(spark, frame, fitted, tmp_path):
    folder = str(tmp_path / "m")
    model.save_model_tables(fitted, folder)
    back = model.load_model_tables(spark, folder)
    a = model.score_addresses(frame, fitted)[0].select("address", "anomaly_score")
    b = model.score_addresses(frame, back)[0].select("address", "anomaly_score")
    assert a.exceptAll(b).isEmpty()
    spark.createDataFrame([(0.5, 1)], "score double, weight bigint").write.mode("append").parquet(f"{folder}/reference_scores")
    with pytest.raises(ValueError):
        model.load_model_tables(spark, folder)


def test_holdout_is_by_address(frame):
    fit, held = model.entity_holdout(frame, 0.25)
    assert fit.count() + held.count() == 601 and 90 < held.count() < 210


def test_normal_scores_are_monotone_and_average_path():
    table = np.tile(np.linspace(0, 10, 101), (1, 1))
    values = model._normal_scores(np.array([[0.0], [2.5], [5.0], [7.5], [10.0]]), table)[:, 0]
    assert values[2] == pytest.approx(0, abs=1e-9) and values[1] == pytest.approx(-0.67448975, abs=1e-6)
    assert list(values) == sorted(values) and values[0] == pytest.approx(-5.1993, abs=1e-3)
    assert model.average_path(np.array([1, 2, 256]))[2] == pytest.approx(10.2447, abs=1e-3)


def test_feature_contract(frame):
    with pytest.raises(ValueError):
        assert_feature_contract(["tx_count", "txid"])
    with pytest.raises(ValueError):
        allowlist(frame.drop("tx_count"))
