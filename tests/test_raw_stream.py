"""Raw signals in the stream: each filter's decisions equal the batch's, malformed epochs go aside, state stays bounded."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions.recordings import RunningOrder, RunningOrders
from tidewave.sources import sinks
from tidewave.streaming import stager

RATE, SAMPLES = 100.0, 300
SCHEMA = "session string, seq long, signal array<array<double>>, ended boolean"


def recorder(mode):
    return stager.Recorder(("one", "two"), RATE, SAMPLES, mode, ("complexity",))


def model_for(width, classes=None, n_classes=None):
    rng = np.random.default_rng(11)
    k, n = len(classes) if classes else 4, n_classes or 4
    return stager.LinearStager(
        tuple(map(tuple, rng.normal(size=(k, 3 * width)))), tuple(rng.normal(size=k).tolist()),
        tuple(map(tuple, np.log(rng.dirichlet(np.ones(n), n)))), 0.4, classes, n_classes,
    )


def sessions():
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 34), ("b", 27), ("c", 5), ("d", 4)):
        t = np.arange(n * SAMPLES) / RATE
        x = np.stack([np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t / 40))) * (20 + 10 * np.sin(t / 9)) + rng.normal(0, 3, len(t)) for f in (2.0, 10.0)])
        rows += [(s, q, x[:, q * SAMPLES : (q + 1) * SAMPLES].tolist(), False) for q in range(n)]
    return rows


def run(spark, stream, model, rec, tmp_path, name, state=None):
    out = str(tmp_path / f"{name}-out")
    write = sinks.append_versions(out, ["session", "seq"], ["seq"])
    started = stager.stage_stream(stream, model, rec, state).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start()
    assert started.awaitTermination(600)
    return {(r["session"], r["seq"]): r for r in sinks.current(spark, out, ["session", "seq"]).collect()}


@pytest.mark.parametrize("mode", ["none", "causal", "zerophase"])
def test_raw_stream_decides_as_the_batch_does(spark, tmp_path, mode):
    rec, rows = recorder(mode), sessions()
    model = model_for(len(rec.names))
    rows_by_time = sorted(rows, key=lambda r: r[1])
    bad = [("a", 500, [[1.0] * SAMPLES], False), ("b", 501, [[1.0] * SAMPLES, [1.0] * (SAMPLES - 1)], False), ("a", 502, None, False), ("c", 503, [[float("nan")] * SAMPLES] * 2, False)]
    splits = {"three": (0, 20, 61, None), "one": (0, None)} if mode == "zerophase" else {"three": (0, 20, 61, None)}
    batch = stager.stage_raw_batch(spark.createDataFrame(rows, SCHEMA), model, rec).collect()
    lost = 2 if mode == "zerophase" else 0  # of each session that fills the ring; a shorter one is never decided
    assert len(batch) == sum(n - lost for n in (34, 27, 5)) + (0 if lost else 4) and len({r["stage"] for r in batch}) > 1
    for name, cuts in splits.items():
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = rows_by_time[lo:hi] + bad[k : k + 2] + ([(s, 10**6, None, True) for s in "abcd"] if hi is None else [])
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
        good, malformed = stager.split(stream, rec)
        got = run(spark, good, model, rec, tmp_path, name)
        assert set(got) == {(r["session"], r["seq"]) for r in batch}
        for r in batch:
            own = got[r["session"], r["seq"]]
            assert own["stage"] == r["stage"] and math.isclose(own["confidence"], r["confidence"], abs_tol=1e-6)
        aside = malformed.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-bad").option("checkpointLocation", f"{tmp_path}/{name}-bad-cp").trigger(availableNow=True).start()
        assert aside.awaitTermination(300)
        seen = {r["seq"] for r in spark.read.parquet(f"{tmp_path}/{name}-bad").collect()}
        assert seen and seen <= {500, 501, 502, 503}


def test_state_is_bounded_but_for_the_norm(spark, tmp_path):
    rec = recorder("zerophase")
    rows = [r for r in sessions() if r[0] in "ab"]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = run(spark, stream, model_for(len(rec.names)), rec, tmp_path, "s")
    assert len(got) == 34 - rec.delay + 27 - rec.delay
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/s-cp")
    ring = spark.read.format("statestore").option("stateVarName", "ring").option("flattenCollectionTypes", True).load(f"{tmp_path}/s-cp")
    assert {(r["n"], r["b"]) for r in ring.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("list_element.x")).alias("b")).collect()} == {(5, 2 * SAMPLES * 8)}
    order = {r["k"]: r["b"] for r in read("order").select(F.col("key.session").alias("k"), F.length("value.values").alias("b")).collect()}
    assert order == {"a": 32 * 8 * len(rec.names), "b": 25 * 8 * len(rec.names)}


def test_classes_that_a_model_never_saw_have_no_probability(spark):
    model = stager.LinearStager(((1.0, 0, 0), (0, 1.0, 0)), (0.3, 0.0), None, 0.0, (3, 1), 4)
    proba = model.proba(np.array([0.5, 0.1, 0.0]))
    assert proba[0] == proba[2] == 0 and math.isclose(proba.sum(), 1) and proba[3] > proba[1]
    rows = spark.createDataFrame([("s", i, [float(i % 5)], False) for i in range(30)], "session string, seq long, features array<double>, ended boolean")
    found = stager.stage_batch(rows, model, 1).collect()
    assert len(found) == 30 and all(r["proba"][0] == r["proba"][2] == 0 and r["stage"] in (1, 3) for r in found)
    with pytest.raises(ValueError):
        stager.LinearStager(((1.0,), (0.0,)), (0.3, 0.0), None, 0.0, (1, 4), 4)
    with pytest.raises(ValueError):
        stager.LinearStager(((1.0,), (0.0,)), (0.3, 0.0), ((0.0, 0.0),))


def test_delay_counts_the_filter():
    assert [recorder(m).delay for m in ("none", "causal", "zerophase")] == [7, 7, 9]
    with pytest.raises(ValueError):
        recorder("notch")


def test_orders_side_by_side_equal_one_by_one():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 5)), 1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    side, each = RunningOrders(5), [RunningOrder() for _ in range(5)]
    for i, row in enumerate(x):
        side.add(row)
        for order, v in zip(each, row.tolist(), strict=True):
            if v == v:
                order.add(v)
        if i % 17 == 0:
            side = RunningOrders(5, *side.state())
        for q in (0.05, 0.5, 0.95):
            assert np.allclose(side.quantile(q), [o.quantile(q) if len(o) else np.nan for o in each], equal_nan=True)


def test_another_query_goes_on_with_the_sessions(spark, tmp_path):
    rec, rows = recorder("zerophase"), [r for r in sessions() if r[0] in "ac"]
    model = model_for(len(rec.names))
    batch = {(r["session"], r["seq"]): r["stage"] for r in stager.stage_raw_batch(spark.createDataFrame(rows, SCHEMA), model, rec).collect()}
    parts = {"one": [r for r in rows if r[1] < 14], "two": [r for r in rows if r[1] >= 12] + [(s, 10**6, None, True) for s in "ac"]}  # two epochs come twice
    got, state = {}, None
    for name, part in parts.items():
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/0")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
        found = run(spark, stream, model, rec, tmp_path, name, state)
        assert not set(found) & set(got)
        got |= {k: r["stage"] for k, r in found.items()}
        state = stager.session_state(spark, f"{tmp_path}/{name}-cp", raw=True)
    assert got == batch
    ended = {r["session"]: r for r in state.collect()}
    assert ended["a"]["received"] == 32 and ended["a"]["counts"] is None and ended["a"]["ring"] is None
