"""Versions put together, an audit trail, importance tables, checks by name, and folds of very many subjects."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import evaluation, models, quality, structure
from tidewave.plans.overlay import kept
from tidewave.sources import sinks

SF = "/root/testdata/sf0.001"


def test_reads_do_not_grow_with_the_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    write = sinks.append_versions(path, ["session", "seq"], ["seq"])
    batch = lambda n: spark.createDataFrame([("a", q, 100 * n + q) for q in range(n, n + 3)], "session string, seq long, x int")
    expect = {}
    for n in range(6):
        write(batch(n), n)
        expect |= {("a", q): 100 * n + q for q in range(n, n + 3)}
    state = lambda: {(r["session"], r["seq"]): r["x"] for r in sinks.current(spark, path, ["session", "seq"]).collect()}
    files = lambda: len(sinks.current(spark, path, ["session", "seq"]).inputFiles())
    assert state() == expect
    before, many = sinks.current(spark, path, ["session", "seq"]), files()
    assert sinks.compact(spark, path, ["session", "seq"]) == 5 and files() < many and state() == expect
    assert sinks.compact(spark, path, ["session", "seq"]) == 5  # nothing new
    assert {(r["session"], r["seq"]): r["x"] for r in before.collect()} == expect  # a reader that began before
    write(batch(5), 5)  # a batch that comes again
    write(batch(6), 6)
    expect |= {("a", q): 600 + q for q in range(6, 9)}
    assert state() == expect
    (tmp_path / "out" / "snapshots" / "upto=6").mkdir()  # one that broke off
    assert state() == expect and sinks.compact(spark, path, ["session", "seq"]) == 6 and state() == expect
    sinks.vacuum(spark, path)
    assert state() == expect and not (tmp_path / "out" / "batch=5").exists() and (tmp_path / "out" / "batch=6").exists()
    write(batch(7), 7)
    sinks.compact(spark, path, ["session", "seq"])
    sinks.vacuum(spark, path, keep=1)
    assert {p.name for p in (tmp_path / "out" / "snapshots").iterdir() if p.is_dir()} == {"upto=7"} and len(state()) == 10
    with pytest.raises(ValueError):
        sinks.current(spark, str(tmp_path / "none"), ["session"])


def test_audit_and_importance(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session string, seq int")
    sinks.audit(rows, str(tmp_path / "audit"), "flush", "end of night", "v3")
    sinks.audit(rows.filter("session = 'b'"), str(tmp_path / "audit"), "restart")
    found = spark.read.parquet(str(tmp_path / "audit"))
    assert found.columns == ["session", "event", "detail", "model_version", "created_at"] and found.filter("created_at IS NULL").count() == 0
    assert sorted(tuple(r)[:4] for r in found.collect()) == [("a", "flush", "end of night", "v3"), ("b", "flush", "end of night", "v3"), ("b", "restart", "", "")]
    gains = spark.createDataFrame([("x", 0.5), ("z", 2.0), ("y", 0.5)], "feature string, importance double")
    sinks.write_importance(gains, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("part-*.csv")
    assert file.read_text().split() == ["feature,importance", "z,2.0", "x,0.5", "y,0.5"]


def test_very_many_subjects_are_dealt_without_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(s, int(x)) for s in range(400) for x in rng.choice(4, size=int(rng.integers(5, 60)), p=rng.dirichlet(np.ones(4)))], "subject int, stage int").cache()
    spread = {}
    for name, limit in (("greedy", 10_000), ("ranges", 0)):
        monkeypatch.setattr(models, "GREEDY_SUBJECTS", limit)
        dealt = models.group_folds(rows, "subject", "stage", 5)
        assert [f"{n} {t}" for n, t in dealt.dtypes] == ["subject int", "fold int"]
        folds = dealt.collect()
        assert len({r["subject"] for r in folds}) == len(folds) == 400
        sizes = collections.Counter(r["fold"] for r in folds)
        assert set(sizes) == set(range(5)) and (limit or max(sizes.values()) == min(sizes.values()) == 80)
        assert sorted(map(tuple, folds)) == sorted(map(tuple, models.group_folds(rows.repartition(7), "subject", "stage", 5).collect()))
        ratios = evaluation.ratio_spread(evaluation.class_ratios(rows.join(dealt, "subject"), "fold", "stage"), "stage").collect()
        spread[name] = max(r["spread"] for r in ratios)
        models.whole_subjects(dealt, "subject", "fold")
    assert spread["greedy"] < 0.03 and spread["ranges"] < 0.06
    one = kept(spark, SF).filter("stage = 1")
    assert models.group_folds(one, "user_id", "stage", 3).select("fold").distinct().count() == 3


def test_checks_by_name_and_empty_tables(spark):
    rows = [(k, c, 60.0 * (0.3 if (k, c) == ("b", "two") else 1)) for k in "ab" for c in ("one", "two") for _ in range(20)]
    df = spark.createDataFrame(rows, "rec string, channel string, ptp double")
    assert {r["rec"]: (r["excluded"], r["reasons"]) for r in quality.assess(df, ["rec"], "channel", "ptp").collect()} == {"a": (False, ""), "b": (True, "flat:two")}
    with pytest.raises(KeyError, match="unknown checks humming"):
        quality.assess(df, ["rec"], "channel", "ptp", ["flat", "humming"])
    assert structure.require_rows(df, "epochs") is df
    with pytest.raises(ValueError, match="epochs has no rows"):
        structure.require_rows(df.filter("false"), "epochs")


def test_rescored_parts(spark):
    rows = [("a", i % 4, i % 4, 0) for i in range(8)] + [("b", i % 4, 0, i % 4) for i in range(4)]
    df = spark.createDataFrame(rows, "rec string, stage int, pred int, smoothed int")
    bad = spark.createDataFrame([("b",), ("b",), ("z",)], "rec string")
    found = {(r["column"], r["part"]): r for r in evaluation.rescore(df, bad, ["rec"], "stage", ["pred", "smoothed", "other"]).collect()}
    assert set(found) == {(c, p) for c in ("pred", "smoothed") for p in ("before", "after", "excluded_only")}
    assert found["pred", "after"]["macro_f1"] == found["smoothed", "excluded_only"]["accuracy"] == 1 and found["pred", "before"]["n"] == 12
    assert abs(found["pred", "after"]["gain_pp"] - 100 * (1 - found["pred", "before"]["macro_f1"])) < 1e-9 and found["pred", "before"]["gain_pp"] is None
    assert {k for k, _ in ((r["part"], r) for r in evaluation.rescore(df, bad.filter("rec = 'z'"), ["rec"], "stage", ["pred"]).collect())} == {"before", "after"}
    with pytest.raises(ValueError):
        evaluation.rescore(df, bad, ["rec"], "stage", ["other"])


def test_a_decoding_block_takes_what_most_folds_chose(spark):
    decoded = spark.createDataFrame([(0, 0.3), (0, 0.3), (1, 0.1), (2, 0.1), (3, 0.3)], "fold int, weight double")
    labels = spark.createDataFrame([("a", i, s) for i, s in enumerate([0, 0, 1, 2, 3, 3])], "rec string, t int, stage int")
    block = models.decoding_block(decoded, labels, ["rec"], "t", "fold")
    assert block["weight"] == 0.1 and np.allclose(np.exp(block["log_prob"]).sum(axis=1), 1) and block["log_prob"][0][0] == block["log_prob"][0][1] > block["log_prob"][0][2]
    with pytest.raises(ValueError):
        models.decoding_block(decoded.filter("false"), labels, ["rec"], "t", "fold")


def test_subjects_dealt_in_lots_lie_as_evenly_as_the_check_asks(spark, monkeypatch):
    monkeypatch.setattr(models, "GREEDY_SUBJECTS", 0)
    monkeypatch.setattr(models, "LOT", 250, raising=False)
    rng = np.random.default_rng(5)
    table = [(None if s == 7 else f"s{s}", t, int(x)) for s in range(4000) for t, x in enumerate(rng.poisson([15, 12, 9, 0.1]) + (s % 400 == 0) * 60)]
    counts = spark.createDataFrame(table, "subject string, stage int, n int").repartition(6)
    rows = counts.select("subject", "stage", F.explode(F.array_repeat("stage", F.col("n"))).alias("_")).cache()
    for folds in (3, 5):
        dealt = models.group_folds(rows, "subject", "stage", folds).cache()
        assert dealt.count() == dealt.distinct().count() == 4000 and dealt.filter("subject IS NULL").count() == 1
        held = rows.join(dealt, rows["subject"].eqNullSafe(dealt["subject"])).groupBy("stage", "fold").count().groupBy("stage")
        apart = {r["stage"]: r["apart"] for r in held.agg((F.max("count") - F.min("count")).alias("apart")).collect()}
        one = {r["stage"]: r["one"] for r in counts.groupBy("stage").agg(F.max("n").alias("one")).collect()}
        assert all(apart[t] <= 2 * one[t] for t in range(4)), (folds, apart, one)
