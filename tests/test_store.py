"""Tables that are built once, sweeps that go on where they stopped, fingerprints, and made recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import spectra
from tidewave.plans import sweeps
from tidewave.sources import generator, store

WANTED = "recording string, version string"


def test_finished_recordings_are_skipped_and_broken_ones_completed(spark, tmp_path):
    made = []

    def build(keys, fail_at=None, factor=1):
        names = sorted(r["recording"] for r in keys.collect())
        made.append(names)
        rows = keys.filter("recording <> '004'").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("x", F.col("epoch") * factor)
        if fail_at in names:
            rows = rows.withColumn("x", F.when((F.col("recording") == fail_at) & (F.col("epoch") == 3), F.raise_error(F.lit("broken off")).cast("int")).otherwise(F.col("x")))
        return rows

    s = store.Store(spark, str(tmp_path), {"filter": "none"})
    wanted = spark.createDataFrame([(f"00{i}", "a") for i in range(1, 8)], WANTED)
    with pytest.raises(Exception, match="broken off"):
        s.update(wanted, lambda k: build(k, "005"), at_once=3)
    assert made == [["001", "002", "003"], ["004", "005", "006"]] and s.read().select("recording").distinct().count() == 3
    spark.createDataFrame([("005", 1, -1), ("005", 2, -2)], "recording string, epoch int, x int").write.mode("append").partitionBy("recording").parquet(f"{s.folder}/data")  # half-written
    assert s.read().filter("x < 0").count() == 0
    assert s.update(wanted, build, at_once=3) == 4 and made[2:] == [["004", "005", "006"], ["007"]]
    rows = sorted(map(tuple, s.read().select("recording", "epoch", "x").collect()))
    assert rows == [(f"00{i}", e, e) for i in range(1, 8) if i != 4 for e in (1, 2, 3)]
    assert {r["key"]: r["rows"] for r in s.manifest().collect()} == {f"00{i}": 0 if i == 4 else 3 for i in range(1, 8)}
    assert s.update(wanted, build) == 0 and len(made) == 4
    newer = wanted.withColumn("version", F.when(F.col("recording") == "002", "b").otherwise(F.col("version")))
    assert s.update(newer, lambda k: build(k, factor=10)) == 1 and made[-1] == ["002"]
    assert sorted(r["x"] for r in s.read().filter("recording = '002'").collect()) == [10, 20, 30] and s.read().count() == 18
    other = store.Store(spark, str(tmp_path), {"filter": "causal"})
    assert other.folder != s.folder and other.missing(wanted).count() == 7


def test_sweeps_run_build_each_table_once_and_go_on(spark, tmp_path):
    fixed = {"features": {"scale": 1}, "train": {"add": 0}}
    runs = [{"train": {"add": a}, "features": {"scale": s}} for s in (1, 2) for a in (0, 5)]
    tables, rated = spark.sparkContext.accumulator(0), []

    def table(f):
        tables.add(1)
        return spark.range(4).select((F.col("id") * f["scale"]).alias("x"))

    def rate(df, t, fail=None):
        rated.append(t["add"])
        total = df.agg(F.sum("x").alias("x")).withColumn("x", F.col("x") + t["add"])
        return total.withColumn("x", F.raise_error(F.lit("no luck")).cast("long")) if t["add"] == fail else total

    assert [p["table_exists"] for p in sweeps.plan(spark, str(tmp_path), fixed, runs)] == [False] * 4
    with pytest.raises(Exception, match="no luck"):
        sweeps.run(spark, str(tmp_path), fixed, runs, table, lambda d, t: rate(d, t, 5), at_once=1).collect()
    planned = sweeps.plan(spark, str(tmp_path), fixed, runs)
    assert tables.value == 2 and all(p["table_exists"] for p in planned) and any(p["result_exists"] for p in planned)
    before = len(rated)
    found = sweeps.run(spark, str(tmp_path), fixed, runs, table, rate)
    assert sorted(r["x"] for r in found.collect()) == [6, 11, 12, 17] and tables.value == 2
    assert len(rated) - before == 4 - sum(p["result_exists"] for p in planned)
    with pytest.raises(KeyError):
        sweeps.plan(spark, str(tmp_path), fixed, [{"typo": {}}])


def test_a_fingerprint_depends_on_values_alone(spark):
    settings = {"rate": 100.0, "channels": ("one", "two"), "without": ("complexity",)}

    def table(seed=0, without=settings["without"], parts=3):
        made = generator.recordings(spark, 2, 3, epoch_seconds=6.0, seed=seed)
        return spectra.epoch_features(made.repartition(parts), ["recording", "epoch_idx"], "signal", 100.0, settings["channels"], 600, without)

    first = store.fingerprint(table())
    assert first == store.fingerprint(table(parts=5).orderBy(F.desc("epoch_idx"))) and len(first) == 12
    assert len({first, store.fingerprint(table(seed=1)), store.fingerprint(table(without=()))}) == 3
    store.same_or_explain(first, first, "table")
    with pytest.warns(UserWarning, match="no fingerprint"):
        store.same_or_explain(None, first, "table")
    with pytest.raises(ValueError, match="build it anew"):
        store.same_or_explain("0" * 12, first, "table")
    gaps = spark.createDataFrame([(1, None, [0.1 + 0.2]), (2, float("nan"), None)], "i int, x double, v array<double>")
    same = spark.createDataFrame([(2, None, None), (1, float("nan"), [0.3])], "i int, x double, v array<double>")
    assert store.fingerprint(gaps) == store.fingerprint(same) != store.fingerprint(same.union(same))


def test_made_recordings_follow_their_rule(spark):
    rows = generator.recordings(spark, 2, 4, rate=50.0, epoch_seconds=10.0).orderBy("recording", "epoch_idx").collect()
    x = np.array([r["signal"] for r in rows]).reshape(2, 4, 2, 500).transpose(0, 2, 1, 3).reshape(2, 2, -1)
    t = np.arange(2000) / 50.0
    base = 40 * np.sin(2 * np.pi * t) + 15 * np.sin(12 * np.pi * t) + 5 * np.sin(44 * np.pi * t) + 10 * np.sin(26 * np.pi * t) * (np.sin(0.1 * np.pi * t) > 0.6)
    for rec in x:
        for own, share in zip(rec, (1.0, 0.6), strict=True):
            rest = own - share * base
            assert abs(rest.mean()) < 0.4 and 3.7 < rest.std() < 4.3
    assert abs(np.corrcoef(x[0, 0] - base, x[1, 0] - base)[0, 1]) < 0.1
