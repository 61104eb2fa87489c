"""The library's own operators: catalogue against DuckDB, kernels against formulas, stream against batch."""

import itertools
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.functions import arrays, windows
from tidewave.operators import decoding, evaluation, models, quality, selection, spectra, structure, tables
from tidewave.plans import catalogue, overlay, settings
from tidewave.sources import edf, sinks
from tidewave.streaming import stager

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


# Structure and windows


def test_intervals_must_be_whole_epochs(spark):
    df = spark.createDataFrame([("r", 0, 90.0), ("r", 90, 60.0)], "k string, onset int, seconds double")
    assert [r["epoch_idx"] for r in structure.expand_intervals(df, ["k"], "onset", "seconds").orderBy("epoch_idx").collect()] == list(range(5))
    with pytest.raises(Exception, match="multiple"):
        structure.expand_intervals(df.withColumn("seconds", F.lit(45.0)), ["k"], "onset", "seconds").collect()


def test_labels(spark):
    df = spark.createDataFrame([("a",), ("b",), ("x",), (None,)], "d string")
    code = structure.label(F.col("d"), {"a": 0, "b": 1}, ["x"])
    assert [r[0] for r in df.select(code).collect()] == [0, 1, -1, None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("?",)], "d string").select(code).collect()


@pytest.mark.parametrize(("stages", "edge", "bounds"), [([0] * 10 + [1, 2, 3] + [0] * 10, 2, (8, 15)), ([1, 0, 0, 1], 60, (0, 4)), ([0] * 5, 2, (0, 5))])
def test_crop_bounds(spark, stages, edge, bounds):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(stages)], "k string, pos long, stage int")
    assert tuple(structure.crop_bounds(df, ["k"], edge).select("lo", "hi").first()) == bounds


def test_shift_leaves_gaps_missing_and_expanding_sees_only_the_past(spark):
    df = spark.createDataFrame([("r", e, float(i)) for i, e in enumerate((10, 11, 20))], "k string, e long, x double")
    assert [r[0] for r in df.select(windows.gap_shift(F.col("x"), ["k"], "e", 1)).collect()] == [1.0, None, None]
    rows = [("r", i, float(i)) for i in range(60)]
    one = spark.createDataFrame(rows, "k string, e long, x double")
    two = spark.createDataFrame([(k, e, x if e < 50 else 999.0) for k, e, x in rows], "k string, e long, x double")
    z = lambda d: [r[0] for r in d.orderBy("e").select(windows.expanding_norm(F.col("x"), ["k"], "e")).collect()]
    a, b = z(one), z(two)
    assert a[:50] == b[:50] and a[:19] == [None] * 19 and a[19] is not None


def test_missing_values_and_constant_columns(spark):
    df = spark.createDataFrame([("r", i, None if i % 5 == 0 else 1.0, float(i % 7)) for i in range(60)], "k string, e long, flat double, x double")
    assert {r[0] for r in df.select(windows.expanding_norm(F.col("flat"), ["k"], "e")).collect()} == {None}
    wide = windows.normalise_wide(df, ["k"], "e", ["flat", "x"]).orderBy("e").collect()
    plain = df.withColumn("z", windows.expanding_norm(F.col("x"), ["k"], "e")).orderBy("e").collect()
    for w, p in zip(wide, plain, strict=True):
        assert w["flat_norm"] is None and (w["x_norm"] is None) == (p["z"] is None)
        assert p["z"] is None or math.isclose(w["x_norm"], p["z"], abs_tol=1e-12)


@pytest.mark.parametrize("n", [15, 40, 137])
def test_every_position_is_scored_once(spark, n):
    df = spark.createDataFrame([("r", i) for i in range(n)], "k string, pos long")
    scored = structure.sequence_windows(df, ["k"], 15, 5).filter("scored").groupBy("pos").count().collect()
    assert {r["pos"]: r["count"] for r in scored} == {i: 1 for i in range(n)}


def test_look_ahead_and_subsets():
    assert [windows.look_ahead(c) for c in ("a", "a_c7min", "a_ep+2", "a_ep-2")] == [0, 7, 2, 0] and windows.look_ahead("a_posthoc") > 10**6
    assert selection.within_budget({"a": 0, "b": 2, "c": 7}, 1.0) == ["a", "b"]
    assert selection.within_budget({"a": 0, "b": 2}, 1.0, fixed=0.5) == ["a"] and selection.within_budget({"c": 7}, None) == ["c"]
    channels = ("front", "back")
    names = ["front__mmd", "front__alpha_max_c7min", "back__alpha_p2min", "ratio__alpha", "corr__broad", "time_hour", "back__std_ep+2"]
    keeps = {
        "all": names, "fpz_only": [names[0], names[1], names[5]], "pz_only": [names[2], names[5], names[6]], "no_distance": names[1:],
        "no_p2min": [*names[:2], *names[3:]], "no_c7min": [names[0], *names[2:]], "smoothed_only": [names[1], names[2], names[5]],
        "no_extremes": [names[0], *names[2:]],
    }
    assert {k: selection.subset(names, k, channels) for k in selection.SUBSETS} == keeps
    with pytest.raises(ValueError):
        selection.subset([], "nothing", channels)
    assert selection.decorrelate(["c", "b", "a"], ["a", "b", "c"], {frozenset("ab"): 0.95, frozenset("bc"): 0.99}, 0.9) == ["c", "a"]
    selection.same_columns(["a", "b"], ["b", "a"])
    with pytest.raises(ValueError, match="b, c"):
        selection.same_columns(["a", "b"], ["a", "c"])


def test_selection_within_training_rows(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=600)
    rows = [(float(x), float(x), float(y), None if i < 5 else float(y + 3 * x)) for i, (x, y) in enumerate(zip(a, rng.normal(size=600), strict=True))]
    df = spark.createDataFrame(rows, "a double, twin double, b double, c double")
    gains = lambda train, columns: {"a": 1.0, "twin": 3.0, "b": 2.0, "c": 0.5}
    columns = ["a", "twin", "b", "c"]
    assert selection.select_columns(df, columns, "all", gains) == columns
    assert selection.select_columns(df, columns, "top:2", gains) == ["twin", "b"]
    assert selection.select_columns(df, columns, "corr:0.99", gains) == ["twin", "b", "c"]
    assert selection.select_columns(df, columns, "corr:0.99,top:1", gains) == ["twin"]
    for bad in ("top", "most:3", "top:0"):
        with pytest.raises(ValueError):
            selection.select_columns(df, columns, bad, gains)


# Joins


def test_attach_refuses_missing_and_double_keys(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    info = spark.createDataFrame([("a", 1), ("b", 2)], "s string, age int")
    assert {tuple(r) for r in tables.attach(df, info, ["s"], ["age"]).collect()} == {("a", 1), ("b", 2)}
    for bad in ([("a", 1)], [("a", 1), ("b", 2), ("b", 3)], [("a", 1), ("b", None)]):
        with pytest.raises(Exception, match="no single complete row"):
            tables.attach(df, spark.createDataFrame(bad, "s string, age int"), ["s"], ["age"]).collect()


def test_versions_keep_the_last_decision(spark, tmp_path):
    write = sinks.append_versions(str(tmp_path / "d"), ["session", "seq"], ["stage"])
    write(spark.createDataFrame([("s", 1, -2), ("s", 1, 0), ("s", 1, -1), ("s", 2, 1)], "session string, seq long, stage int"), 0)
    for _ in range(2):  # a batch that is done again
        write(spark.createDataFrame([("s", 2, 3)], "session string, seq long, stage int"), 1)
    assert [(r["seq"], r["stage"]) for r in sinks.history(spark, str(tmp_path / "d"), "s").collect()] == [(1, 0), (2, 3)]
    sinks.write_note(spark, {"b": 1, "a": [2]}, str(tmp_path / "n"))
    assert sinks.read_note(spark, str(tmp_path / "n")) == {"a": [2], "b": 1}


# Signals


def test_band_pass_gains_and_zero_phase():
    rate, t = 100.0, np.arange(6000) / 100
    for hz, gain in ((10.0, 1.0), (0.05, 0.0), (45.0, 0.0)):
        y = spectra.band_pass(np.sin(2 * np.pi * hz * t), rate, "zerophase")[1500:4500]
        assert abs(np.sqrt(2 * (y**2).mean()) - gain) < 0.02
    x = np.sin(2 * np.pi * 8 * t)
    assert np.abs(spectra.band_pass(x, rate, "zerophase") - x)[500:-500].max() < 0.01
    sections = spectra.butterworth(5, 0.4, 30.0, rate)
    z = np.exp(2j * np.pi * np.array([0.4, 30.0]) / rate)
    response = np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sections], axis=0)
    assert np.allclose(np.abs(response), np.sqrt(0.5), atol=1e-6) and all(abs(np.roots(s[3:])).max() < 1 for s in sections)
    with pytest.raises(ValueError):
        spectra.band_pass(x, rate, "nothing")


def test_power_of_noise_and_shares_of_tones():
    rng = np.random.default_rng(0)
    freqs, psd = spectra.welch(rng.normal(size=(200, 3000)), 100.0)
    assert abs(psd[:, 5:-5].mean() * 50 - 1) < 0.02
    t = np.arange(3000) / 100
    found = spectra.band_features(np.stack([np.sin(2 * np.pi * hz * t) for hz in (1.5, 10, 20)]), 100.0)
    shares = np.stack([found[b] for b in spectra.BANDS])
    assert np.allclose(shares.sum(0), 1, atol=1e-4) and shares.argmax(0).tolist() == [1, 3, 5]


def test_kernels_equal_expressions(spark):
    x = np.random.default_rng(1).normal(size=(3, 3000))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    kernel, c = spectra.time_features(x), F.col("x")
    native = {"mmd": arrays.max_min_distance(c, 300), "esis": arrays.energy_product(c), "petrosian": arrays.petrosian(c)}
    found = df.select("i", arrays.statistics(c).alias("s"), arrays.hjorth(c).alias("h"), *[v.alias(n) for n, v in native.items()])
    for r in found.select("*", "s.*", "h.*").collect():
        for n in kernel:
            assert math.isclose(r[n], kernel[n][r["i"]], rel_tol=1e-9)
        assert math.isclose(r["petrosian"], spectra.complexity_features(x)["petrosian"][r["i"]], rel_tol=1e-9)


def test_complexity_of_noise_and_lines():
    x = np.stack([np.random.default_rng(2).normal(size=3000), np.linspace(0, 1, 3000)])
    found = spectra.complexity_features(x)
    assert found["perm_entropy"][0] > 0.99 and abs(found["perm_entropy"][1]) < 1e-9
    assert abs(found["higuchi"][0] - 2) < 0.05 and abs(found["higuchi"][1] - 1) < 0.01


def test_spindles_and_runs():
    assert spectra.runs(np.array([1] * 60 + [0] * 10 + [1] * 20 + [0] * 5 + [1] * 250, bool), 100.0) == (1, 0.6)
    t = np.arange(3000) / 100
    noise = np.random.default_rng(3).normal(size=(25, 3000)) * 0.1
    noise[22] += np.sin(2 * np.pi * 13 * t) * ((t > 10) & (t < 11))
    counts, seconds = spectra.spindles(noise, 100.0)
    assert counts[22] >= 1 and seconds[22] >= 0.5
    size = np.abs(np.random.default_rng(4).normal(size=(45, 30)))
    expect = [np.quantile(size[: max((i + 1) // 20 * 20, 1), ::5], 0.92) for i in range(45)]
    assert np.allclose(spectra.spindle_thresholds(size), expect) and len(spectra.spindle_thresholds(size[:0])) == 0


def test_filtering_by_blocks_and_in_parts():
    sections, x = spectra.butterworth(5, 0.4, 30.0, 100.0), np.random.default_rng(5).normal(size=(2, 1000))
    y, z = np.moveaxis(x, -1, 0).copy(), np.zeros((len(sections), 2, 2))
    for i, s in enumerate(sections):  # sample by sample
        for t, v in enumerate(y.copy()):
            y[t] = s[0] * v + z[i, 0]
            z[i] = s[1] * v - s[4] * y[t] + z[i, 1], s[2] * v - s[5] * y[t]
    assert np.allclose(spectra.filter_sections(sections, x), y.T, atol=1e-10)
    first, state = spectra.filter_on(sections, x[:, :333])
    rest, end = spectra.filter_on(sections, x[:, 333:], state)
    assert np.allclose(np.hstack([first, rest]), y.T, atol=1e-10) and np.allclose(end, z, atol=1e-10)


def test_filtered_features_of_recordings(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{k}", e, rng.normal(size=(2, 3000)).tolist()) for k in range(2) for e in range(4)]
    df = spark.createDataFrame(rows, "rec string, epoch_idx long, signal array<array<double>>")
    clean = spectra.filter_recordings(df, ["rec"], "epoch_idx", "signal", 100.0, "zerophase")
    whole = np.concatenate([np.array(r[2]) for r in rows if r[0] == "r1"], axis=1)
    expect = spectra.band_pass(whole, 100.0, "zerophase")[:, 3000:6000]
    got = np.array(clean.filter("rec = 'r1' AND epoch_idx = 1").first()["signal"])
    assert np.allclose(got, expect)
    found = spectra.epoch_features(clean, ["rec", "epoch_idx"], "signal", 100.0, ["a", "b"], 3000).collect()
    names = spectra.feature_names(100.0, ["a", "b"], 3000)
    assert len(found) == 8 and all(len(r["features"]) == len(names) == 80 for r in found)
    assert spectra.spindle_features(clean, ["rec"], "epoch_idx", "signal", 100.0).count() == 8


# Evaluation and decoding


def test_scores_with_a_missing_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    r = evaluation.scores(df, "t", "p").first()
    assert r["f1_3"] == 0.0 and math.isclose(r["macro_f1"], (2 / 3 + 0.5 + 0) / 3) and r["accuracy"] == 0.5


def test_decoders_agree_and_weight_zero_is_the_first_maximum(spark):
    rng = np.random.default_rng(5)
    proba = rng.dirichlet(np.ones(4), size=(3, 60))
    rows = [(k, t, p.tolist()) for k in range(3) for t, p in enumerate(proba[k])]
    df = spark.createDataFrame(rows, "k int, t int, proba array<double>")
    table = np.log(rng.dirichlet(np.ones(4), size=4)).tolist()
    get = lambda d: {(r["k"], r["t"]): r["stage"] for r in d.collect()}
    native = get(decoding.forward(df, ["k"], "t", "proba", table, 0.7))
    assert native == get(decoding.decode(df, ["k"], "t", "proba", table, 0.7, 0))
    assert get(decoding.forward(df, ["k"], "t", "proba", table, 0.0)) == {(k, t): int(np.argmax(p)) for k, t, p in rows}
    whole = get(decoding.decode(df, ["k"], "t", "proba", table, 0.7, None))
    assert whole == get(decoding.decode(df, ["k"], "t", "proba", table, 0.7, 60)) and whole != native
    steps = 0.7 * np.array(table)
    for lag in (1, 3):  # by all paths through the rows that count
        got = get(decoding.decode(df.filter("t < 6"), ["k"], "t", "proba", table, 0.7, lag))
        for k in range(3):
            for t in range(6):
                first, last = 0, min(5, t + lag)
                mass = np.zeros(4)
                for path in itertools.product(range(4), repeat=last - first + 1):
                    log = sum(np.log(proba[k][u][s]) for u, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False))
                    mass[path[t]] += np.exp(log)
                assert got[k, t] == mass.argmax()
    grid = decoding.decode_grid(df, ["k"], "t", "proba", table, [0.0, 0.7])
    assert get(grid.filter("weight = 0.7")) == native
    best = decoding.best_weight(df.withColumn("stage", F.lit(1)), ["k"], "t", "proba", "stage", table, [0.0, 0.7]).collect()
    assert len(best) == 1


def test_recordings_come_whole_to_a_kernel(spark):
    from tidewave.functions.recordings import map_recordings

    df = spark.range(5000).select((F.col("id") % 37).alias("k"), F.col("id").alias("t")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        kernel = lambda rows: rows.slice(0, 1).append_column("n", pa.array([rows.num_rows])).append_column("last", rows.column("t").slice(rows.num_rows - 1))
        found = map_recordings(df, ["k"], "t", kernel, "k long, t long, n long, last long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in found) == [(k, k, len(range(k, 5000, 37)), max(range(k, 5000, 37))) for k in range(37)]
    assert map_recordings(df.filter("false"), ["k"], "t", kernel, "k long, t long, n long, last long").isEmpty()


def test_models_and_folds(spark):
    rows = overlay.kept(spark, "/root/testdata/sf0.01").select("user_id", "epoch_idx", "stage", F.col("value").alias("a"), F.col("k").alias("b"))
    rows = rows.withColumn("b", F.col("b") + F.col("stage") * 20.0)
    folds = [tuple(r) for r in models.group_folds(rows, "user_id", "stage", 3).collect()]
    assert len({s for s, _ in folds}) == len(folds) == 150 and {f for _, f in folds} == {0, 1, 2}
    df = rows.join(spark.createDataFrame(folds, "user_id long, fold int"), "user_id").cache()
    ratios = evaluation.ratio_spread(evaluation.class_ratios(df, "fold", "stage"), "stage").collect()
    assert max(r["spread"] for r in ratios) < 0.03
    found = models.cross_validate(df, ["a", "b"], "fold", [0, 1, 2]).cache()
    assert found.count() == df.count()
    assert evaluation.scores(found, "stage", "pred").first()["accuracy"] > 0.35
    fitted = models.fit(df.filter("fold = 0"), ["a", "b"], "forest")
    assert models.importance(fitted, ["a", "b"])[0][0] == "b"
    with pytest.raises(ValueError):
        models.fit(df, ["a"], "nothing")


def test_cross_validation_with_selection_decoding_delays_and_export(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for subject in range(9):
        stage = 0
        for t in range(40):
            stage = int(rng.integers(4)) if rng.random() < 0.15 else stage
            rows.append((subject, t, stage, subject % 3, stage + rng.normal() * 0.8, (stage % 2) + rng.normal() * 0.8, float(rng.normal()), stage + rng.normal() * 0.5))
    df = spark.createDataFrame(rows, "subject int, t long, stage int, fold int, a double, b double, noise double, a_c7min double").cache()
    columns, ahead = ["a", "b", "noise", "a_c7min"], {"a": 0, "b": 0, "noise": 0, "a_c7min": 7}
    seen = []
    chosen = selection.select_columns(df.filter("fold <> 0"), columns, "top:2", lambda train, names: seen.append(train.count()) or {"a": 2.0, "b": 1.0})
    assert chosen == ["a", "b"] and seen == [240]
    found = models.cross_validate(df, columns, "fold", [0, 1, 2], select="top:3").cache()
    plain = evaluation.scores(found, "stage", "pred").first()["accuracy"]
    decoded = models.nested_decode(found, ["subject"], "t", "fold", [0, 1, 2], [0.0, 0.5, 1.0]).cache()
    assert decoded.count() == 360 and evaluation.scores(decoded, "stage", "smoothed").first()["accuracy"] >= plain
    assert decoded.select("fold", "weight").distinct().count() == 3
    sweep = {r["minutes"]: r["n_columns"] for r in models.delay_sweep(df, ahead, "fold", [0, 1, 2], [0.0, None]).collect()}
    assert sweep == {0.0: 3, None: 4}
    with pytest.raises(ValueError):
        models.delay_sweep(df, {"a_c7min": 7}, "fold", [0], [1.0])
    split = models.validation_subjects(df, "subject").collect()
    assert len(split) == 9 and sum(r["validates"] for r in split) == 2
    fitted = models.fit(df, ["a", "b"], "ridge")
    models.save(fitted, str(tmp_path / "m"), ["a", "b"], ahead, "ridge", spark, version="1")
    again, card = models.load(str(tmp_path / "m"), spark)
    assert card == {"model": "ridge", "columns": ["a", "b"], "look_ahead": {"a": 0, "b": 0}, "delay": 0, "version": "1"}
    same = lambda m: [r["pred"] for r in models.predict(m, df, ["a", "b"]).orderBy("subject", "t").collect()]
    assert same(again) == same(fitted)
    with pytest.raises(ValueError):
        models.save(fitted, str(tmp_path / "n"), [], {}, "nothing", spark)


def test_signed_rank_by_all_sign_patterns():
    for own in ([1.0, -2.0, 3.0, 4.0, 5.5], [0.5, 0.5, -0.5, 0.0, 2.0], [1.0] * 8):
        kept = [d for d in own if d]
        sizes = sorted(abs(d) for d in kept)
        rank = [np.mean([i + 1 for i, x in enumerate(sizes) if x == abs(d)]) for d in kept]
        least = min(sum(r for r, d in zip(rank, kept, strict=True) if d > 0), sum(r for r, d in zip(rank, kept, strict=True) if d < 0))
        sums = [sum(r for r, up in zip(rank, signs, strict=True) if up) for signs in itertools.product((0, 1), repeat=len(kept))]
        assert math.isclose(evaluation.signed_rank(own), min(1.0, 2 * sum(x <= least for x in sums) / len(sums)))
    assert evaluation.signed_rank([0.0, 0.0]) == 1.0


def test_quality_scan_and_its_refusals(spark):
    rows = [("a", "x", 80.0, "c"), ("a", "x", 90.0, "c"), ("b", "x", 5.0, "c"), ("b", "x", 6.0, "c"), ("b", "y", 80.0, "c")]
    df = spark.createDataFrame(rows, "rec string, ch string, ptp double, config string")
    report = quality.scan(df, ["rec"], "ch", "ptp", "config")
    assert (report["n_recordings"], report["n_excluded"], report["n_epochs_excluded"], report["excluded"]) == (2, 1, 2, [["b"]])
    assert quality.excluded(report, "c") == [("b",)]
    for bad in (lambda: quality.excluded(report, "d"), lambda: quality.scan(df.filter("false"), ["rec"], "ch", "ptp", "config"),
                lambda: quality.scan(df.withColumn("config", F.col("rec")), ["rec"], "ch", "ptp", "config")):
        with pytest.raises(ValueError):
            bad()


def test_leaks_and_unpaired_files_stop(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert tables.paired(names("SC4001E0-PSG", "SC4001EC-Hypnogram")).first()["key"] == "SC400N1"
    for bad in (names("SC4001E0-PSG"), names("XX-PSG", "XX-Hypnogram")):
        with pytest.raises(Exception, match="no single label file|unknown file name"):
            tables.paired(bad).collect()
    tables.no_leak(names("a"), names("b"))
    with pytest.raises(ValueError, match="a"):
        tables.no_leak(names("a", "c"), names("a"))


# Files, settings, stream


def edf_file(path, signals, seconds=1.0, start="01.01.2000.00.00"):
    """signals: (label, unit, [record][sample] int16 or bytes)."""
    pad = lambda text, n: str(text).encode("latin-1").ljust(n)[:n]
    n, records = len(signals), len(signals[0][2])
    count = [len(s[2][0]) // 2 if isinstance(s[2][0], bytes) else len(s[2][0]) for s in signals]
    head = pad("0", 8) + pad("p", 80) + pad("r", 80) + pad(start, 16) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(seconds, 8) + pad(n, 4)
    columns = [[s[0] for s in signals], [""] * n, [s[1] for s in signals], [-1000] * n, [1000] * n, [-2000] * n, [2000] * n, [""] * n, count, [""] * n]
    for values, width in zip(columns, (16, 80, 8, 8, 8, 8, 8, 80, 8, 32), strict=True):
        head += b"".join(pad(v, width) for v in values)
    body = b"".join(s[2][r] if isinstance(s[2][r], bytes) else np.array(s[2][r], "<i2").tobytes() for r in range(records) for s in signals)
    path.write_bytes(head + body)


def test_edf_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    raw = rng.integers(-2000, 2000, (7, 2, 10))
    edf_file(tmp_path / "SC4001E0-PSG.edf", [("A", "uV", raw[:, 0].tolist()), ("B", "mV", raw[:, 1].tolist())])
    notes = b"+0\x14\x14\x00+0\x1560\x14Sleep stage W\x14\x00+60\x1530\x14Sleep stage 1\x14\x00".ljust(80, b"\0")
    edf_file(tmp_path / "SC4001EC-Hypnogram.edf", [("EDF Annotations", "", [notes])])
    found = edf.read_annotations(spark, str(tmp_path)).orderBy("onset").collect()
    assert [tuple(r)[1:] for r in found] == [(0.0, 60.0, "Sleep stage W"), (60.0, 30.0, "Sleep stage 1")]
    got = edf.read_epochs(spark, str(tmp_path), ["B", "A"], 10.0, 3.0).orderBy("epoch_idx").collect()
    assert len(got) == 2 and got[0]["name"] == "SC4001E0-PSG.edf"
    whole = np.concatenate([np.array(r["signal"]) for r in got], axis=1)
    assert np.allclose(whole[1], raw[:6, 0].ravel() * 0.5) and np.allclose(whole[0], raw[:6, 1].ravel() * 500.0)
    for channels, rate, why in ((["C"], 10.0, "no channel"), (["A"], 100.0, "Hz")):
        with pytest.raises(Exception, match=why):
            edf.read_epochs(spark, str(tmp_path), channels, rate, 3.0).collect()


def test_settings():
    base = {"filter": {"mode": "none", "order": 5}, "n": 1}
    new = settings.override(base, ["filter.mode=causal", "n=2.5", "filter.order=null"])
    assert new == {"filter": {"mode": "causal", "order": None}, "n": 2.5} and base["n"] == 1
    for bad, error in (("filter.nothing=1", KeyError), ("n", ValueError)):
        with pytest.raises(error):
            settings.override(base, [bad])
    assert settings.digest(base) == settings.digest({"n": 1, "filter": {"order": 5, "mode": "none"}}) != settings.digest(new)
    plan = settings.sweep(base, [{"n": 3}, {"filter": {"order": 4}}])
    assert [p["n"] for p in plan] == [3, 1] and plan[1]["filter"] == {"mode": "none", "order": 4}


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    rng = np.random.default_rng(7)
    model = stager.LinearStager(tuple(map(tuple, rng.normal(size=(4, 6)))), (0.1, 0.0, 0.2, -0.1), tuple(map(tuple, np.log(rng.dirichlet(np.ones(4), 4)))), 0.4)
    rows = []
    for s, n in (("a", 45), ("b", 12), ("c", 30)):
        rows += [(s, t, [float(rng.normal()), None if t % 9 == 4 else float(rng.normal())], False) for t in range(n)]
    schema = "session string, seq long, features array<double>, ended boolean"
    for k, part in enumerate((rows[:30], rows[20:60], rows[60:] + [(s, 10**6, None, True) for s in "abc"])):  # with epochs sent twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    write = sinks.append_versions(str(tmp_path / "out"), ["session", "seq"], ["seq"])
    started = stager.stage_stream(stream, model).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert started.awaitTermination(300)
    got = {(r["session"], r["seq"]): r for r in sinks.current(spark, str(tmp_path / "out"), ["session", "seq"]).collect()}
    batch = stager.stage_batch(spark.createDataFrame(rows, schema), model, 2).collect()
    assert len(got) == len(batch) == len(rows)
    for r in batch:
        assert got[r["session"], r["seq"]]["stage"] == r["stage"]
        assert math.isclose(got[r["session"], r["seq"]]["confidence"], r["confidence"], abs_tol=1e-9)


def test_settings_from_a_file(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"model": {"name": "ridge"},\n "edge": 60}')
    found = settings.load(spark, str(tmp_path / "run.json"))
    assert found == {"model": {"name": "ridge"}, "edge": 60}
    assert settings.override(found, ["model.name=forest"])["model"]["name"] == "forest"
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        settings.load(spark, str(tmp_path / "list.json"))


def test_merged_manifest_and_cross_check(spark):
    new = spark.createDataFrame([(1, "x", None, True), (2, "x", None, True), (3, "x", 7, False), (4, "x", None, True)], "k int, config string, n int, skipped boolean")
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "x", 1)], "k int, config string, n int")
    assert sorted((r.k, r.n) for r in tables.merge_manifest(new, old, ["k"], "config", "skipped", ["n"]).collect()) == [(1, 5), (2, None), (3, 7), (4, None)]
    a = spark.createDataFrame([(1, "W", 1.0), (2, "W", 1.0), (3, None, None), (4, "W", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "W", 1.0005), (2, "R", 1.1), (3, None, None), (5, "W", 1.0)], "k int, s string, v double")
    found = {r.k: (r.in_both, r.exact, r.near) for r in tables.cross_check(a, b, ["k"], ["s"], ["v"]).collect()}
    no, yes = (False, False, False), (True, True, True)
    assert found == {1: yes, 2: (True, False, False), 3: yes, 4: no, 5: no}


def test_subjects_in_several_folds_stop(spark):
    dealt = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "subject int, fold int")
    models.whole_subjects(dealt, "subject", "fold")
    with pytest.raises(ValueError, match="7"):
        models.whole_subjects(dealt.union(spark.createDataFrame([(7, 0), (7, 1)], dealt.schema)), "subject", "fold")
