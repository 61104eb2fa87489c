"""EDF files by ranges of records, and stored epochs replayed as a stream."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import edf_file
from test_raw_stream import model_for, recorder, sessions

from tidewave.sources import edf, sinks
from tidewave.streaming import replay, stager


@pytest.mark.parametrize("seconds, per_record", [(1.0, 10), (3.0, 30), (7.0, 70)])
def test_ranges_give_each_epoch_once(spark, tmp_path, seconds, per_record):
    rng = np.random.default_rng(6)
    raw = {name: rng.integers(-2000, 2000, (records, 2, per_record)) for name, records in (("SC4001E0", 41), ("SC4002E0", 17), ("SC4011E0", 1))}
    for name, x in raw.items():
        edf_file(tmp_path / f"{name}-PSG.edf", [("A", "uV", x[:, 0].tolist()), ("B", "uV", x[:, 1].tolist())], seconds)
    for split in (100, 777, 1 << 20):
        got = edf.read_epochs(spark, str(tmp_path), ["B"], 10.0, 4.0, split_bytes=split)
        rows = got.collect()
        assert len({(r["name"], r["epoch_idx"]) for r in rows}) == len(rows)
        for name, x in raw.items():
            own = sorted((r["epoch_idx"], r["signal"][0]) for r in rows if r["name"] == f"{name}-PSG.edf")
            whole = x[:, 1].ravel() * 0.5
            assert [i for i, _ in own] == list(range(len(whole) // 40))
            assert np.allclose(np.concatenate([v for _, v in own] or [[]]), whole[: len(own) * 40])
    assert edf.read_epochs(spark, str(tmp_path), ["B"], 10.0, 4.0, split_bytes=777).rdd.getNumPartitions() > 3


def test_names_choose_files_before_they_are_read(spark, tmp_path):
    edf_file(tmp_path / "SC4001E0-PSG.edf", [("A", "uV", [[1] * 10] * 8)])
    edf_file(tmp_path / "SC4002E0-PSG.edf", [("Z", "uV", [[1] * 10] * 8)])
    (tmp_path / "SC4003E0-PSG.edf").write_bytes(b"no such file")
    all_files = edf.read_epochs(spark, str(tmp_path), ["A"], 10.0, 4.0)
    assert all_files.filter("name = 'SC4001E0-PSG.edf'").count() == 2
    assert all_files.filter(F.col("name").isin("SC4001E0-PSG.edf", "other")).filter("epoch_idx > 0").count() == 1
    assert all_files.filter("name LIKE 'SC4001%'").count() == 2
    for name, why in (("SC4002E0-PSG.edf", "no channel A"), ("SC4003E0-PSG.edf", "no EDF")):
        with pytest.raises(Exception, match=why):
            all_files.filter(F.col("name") == name).collect()
    (tmp_path / "empty").mkdir()
    assert edf.read_epochs(spark, str(tmp_path / "empty"), ["A"], 10.0).count() == 0


def test_other_starts_are_refused(spark, tmp_path):
    edf_file(tmp_path / "SC4001E0-PSG.edf", [("A", "uV", [[1] * 10] * 8)])
    edf_file(tmp_path / "SC4001EC-Hypnogram.edf", [("EDF Annotations", "", [b"+0\x14\x14\x00".ljust(80, b"\0")])])
    pairs = spark.createDataFrame([("SC4001E0-PSG.edf", "SC4001EC-Hypnogram.edf")], "signal_name string, label_name string")
    headers = edf.read_headers(spark, str(tmp_path))
    assert {(r["name"], r["records"], r["seconds"], tuple(r["labels"])) for r in headers.collect()} == {("SC4001E0-PSG.edf", 8, 1.0, ("A",)), ("SC4001EC-Hypnogram.edf", 1, 1.0, ("EDF Annotations",))}
    assert edf.refuse_other_starts(headers, pairs).collect()[0]["signal_start"] == "01.01.2000.00.00"
    edf_file(tmp_path / "SC4001EC-Hypnogram.edf", [("EDF Annotations", "", [b"+0\x14\x14\x00".ljust(80, b"\0")])], start="01.01.2000.00.01")
    with pytest.raises(Exception, match="different times: SC4001E0-PSG.edf"):
        edf.refuse_other_starts(edf.read_headers(spark, str(tmp_path)), pairs).collect()


def test_a_replay_goes_on_where_it_stopped(spark, tmp_path):
    rec, rows = recorder("zerophase"), [r for r in sessions() if r[0] in "bc"]
    model = model_for(len(rec.names))
    table = spark.createDataFrame([r[:3] for r in rows], "session string, seq long, signal array<array<double>>")
    replay.store(table, str(tmp_path / "epochs"))
    out, began, listener = str(tmp_path / "out"), time.time() - 12, replay.Latency()
    spark.streams.addListener(listener)

    def play(speed, until):
        source = replay.stream(spark, str(tmp_path / "epochs"), began, seconds=1.0, speed=speed)
        write = sinks.append_versions(out, ["session", "seq"], ["seq"])
        query = stager.stage_stream(source, model, rec).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            limit = time.time() + 150
            while query.exception() is None and not until() and time.time() < limit:
                time.sleep(0.5)
            assert query.exception() is None
        finally:
            query.stop()

    log = tmp_path / "cp" / "commits"
    play(0.5, lambda: log.exists() and any(f.name.isdigit() for f in log.iterdir()))  # some epochs are due, not all
    ends = lambda: [json.loads((tmp_path / "cp" / "offsets" / n).read_text().splitlines()[-1])["seq"] for n in sorted((f.name for f in (tmp_path / "cp" / "offsets").iterdir() if f.name.isdigit()), key=int)]
    before = ends()
    assert 0 < before[-1] < 28
    play(100.0, lambda: ends()[-1] == 28 and len([f for f in log.iterdir() if f.name.isdigit()]) == len(ends()))
    spark.streams.removeListener(listener)
    assert ends()[: len(before)] == before and ends() == sorted(ends())
    written = spark.read.parquet(out)
    got = sinks.current(spark, out, ["session", "seq"])
    assert written.count() == got.count()  # nothing was decided twice
    batch = {(r["session"], r["seq"]): r["stage"] for r in stager.stage_raw_batch(spark.createDataFrame(rows, replay.SCHEMA), model, rec).collect()}
    assert {(r["session"], r["seq"]): r["stage"] for r in got.collect()} == batch
    labels = spark.createDataFrame([(s, q, batch.get((s, q), 0) if q % 2 else 9, 3) for s, q, _, _ in rows], "session string, seq long, stage int, warm_up int")
    found = {r["session"]: r for r in replay.figures(got, labels, rec.delay).collect()}
    for s, n in (("b", 27), ("c", 5)):
        judged = [q for (t, q) in batch if t == s and q >= 3]
        assert (found[s]["n_epochs"], found[s]["n_decisions"], found[s]["delay"], found[s]["first_answer_after"]) == (n, len(judged), 9, 9)
        assert abs(found[s]["accuracy"] - sum(q % 2 for q in judged) / max(len(judged), 1)) < 1e-9
    ms = listener.figures()
    assert sum(n for n, _ in listener.batches) >= len(rows) and 0 < ms["mean"] <= ms["max"] and ms["p95"] <= ms["max"]
    with pytest.raises(Exception, match="time at which it began"):
        spark.readStream.format("tidewave_replay").load(str(tmp_path / "epochs")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).start().processAllAvailable()
