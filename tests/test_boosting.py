"""Boosted trees: bins, a task that is not linear, the same model however the rows are dealt, and a saved one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import boosting, evaluation, models, selection


def test_keys_keep_the_order_of_values():
    x = np.array([-np.inf, -1e30, -5.0, -1e-30, -0.0, 0.0, 1e-30, 0.5, 1.0, 1.001, 5.0, 1e30, np.inf])
    key = boosting.keys_of(x)
    assert (np.diff(key) >= 0).all() and key[4] == key[5] == boosting.keys_of(np.array([np.nan]))[0] and key[8] < key[9] and 0 <= key[0] and key[-1] < 1 << boosting.KEY_BITS


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1600, 3))
    stage = np.digitize(np.hypot(x[:, 0], x[:, 1]), [0.7, 1.2, 1.8])
    return spark.createDataFrame([(i, i % 2, int(s), float(a), float(b), None if i % 11 == 0 else float(c)) for i, (s, (a, b, c)) in enumerate(zip(stage, x, strict=True))], "id int, fold int, stage int, a double, b double, c double").repartition(3).cache()


def test_boosting_beats_a_linear_model_and_keeps_its_importance(spark, rings, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "BOOSTED", {"rounds": 12, "depth": 3, "bins": 32, "rate": 0.4})
    columns = ["a", "b", "c"]
    train, test = rings.filter("fold = 0"), rings.filter("fold = 1")
    score = {}
    for name in ("ridge", "boosted"):
        fitted = models.fit(train, columns, name)
        score[name] = evaluation.scores(models.predict(fitted, test, columns), "stage", "pred").first()["macro_f1"]
    assert score["boosted"] > score["ridge"] + 0.2 and score["boosted"] > 0.75
    ranked = models.importance(fitted, columns)
    assert {ranked[0][0], ranked[1][0]} == {"a", "b"} and ranked[2][1] < 0.3 * ranked[1][1]
    card = models.save(fitted, str(tmp_path / "m"), columns, {"c": 7}, "boosted", spark)
    again, read = models.load(str(tmp_path / "m"), spark)
    assert read == card and again.note() == fitted.note()
    one, two = (models.predict(m, test, columns).select("id", "proba").orderBy("id").collect() for m in (fitted, again))
    assert one == two and all(abs(sum(r["proba"]) - 1) < 1e-9 for r in one)


def test_the_model_does_not_depend_on_how_rows_are_dealt(rings, monkeypatch):
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    weighted = rings.withColumn("w", F.col("id") % 3 + 0.3)
    notes = [boosting.fit(df, ["a", "b", "c"], "stage", 4, weight="w", rounds=3, depth=2, bins=16).note() for df in (weighted, weighted.repartition(5, "id").orderBy(F.desc("b")))]
    assert notes[0] == notes[1] and len(notes[0]["rounds"]) == 3


def test_a_split_is_the_best_of_all(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i // 10), int(i % 10 > 5)) for i in range(100)], "a double, b double, y int")
    model = boosting.fit(rows, ["b", "a"], "y", 2, rounds=1, depth=1, bins=16, rate=1.0)
    tree = model.rounds[0][1]
    assert tree.columns.tolist() == [1] and model.edges[1][tree.bins[0]] == boosting.keys_of(np.array([5.0]))[0]
    p, n, h = 0.4, 60, 60 * 0.4 * 0.6
    assert np.allclose(tree.values[0], -p * n / (h + 1.0), rtol=1e-5)
    with pytest.raises(ValueError):
        boosting.fit(rows, ["a"], "y", 2, bins=300)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) + 1e6
    x[:, 7] = 3.0
    x[:, 8] = x[:, 9] * -2 + 5
    rows = [[None if (i * j) % 13 == 12 and j > 30 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(40)))
    full = np.array([[np.nan if v is None else v for v in r] for r in rows])
    full = np.where(np.isnan(full), np.nanmedian(full, axis=0), full)
    got = selection.correlations(df.repartition(5), df.columns).collect()
    assert len(got) == 40 * 39 // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        expect = np.nan_to_num(np.abs(np.corrcoef(full.T)))
    for r in got:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        assert abs(r["r"] - expect[i, j] * (7 not in (i, j))) < 1e-6
    assert selection.medians(df, ["c35", "c1"], 10_000)["c1"] == sorted(x[:, 1])[149]
    assert selection.correlations(df.filter("false"), ["c0", "c1"]).collect()[0]["r"] == 0
