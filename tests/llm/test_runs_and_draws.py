"""Periodic runs and importance resampling against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, SF, docs, none, odd  # noqa: F401

from tidewave.llm import queries, resampling, runs


def brute_runs(x, least=6, times=4):
    """Every stretch that agrees with itself a period on, of each period that no smaller one explains."""
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(x[k] == x[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(3)
    for _ in range(4000):
        n, k = random.randint(0, 70), random.choice([1, 2, 2, 3])
        x = [random.randrange(k) for _ in range(n)]
        if random.random() < 0.6 and n > 4:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randint(3, 10)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        assert runs.runs_of(x) == brute_runs(x)
        assert runs.runs_of(x, 1, 3) == brute_runs(x, 1, 3)


def test_hashes_that_lie_change_no_run(monkeypatch):
    monkeypatch.setattr(runs, "_BASE", 0)  # every hash is that of the last word alone
    x = [0, 1, 2] * 30 + [3, 1, 2, 0] * 20 + [5] * 40
    assert (0, 90, 3) in runs.runs_of(x) and set(runs.runs_of(x)) <= set(brute_runs(x))


def test_long_loops_are_one_run():
    assert runs.runs_of([0] * 50_000) == [(0, 50_000, 1)]
    assert runs.runs_of([7, *[0, 1, 0, 0] * 9000, 9]) == [(1, 36_000, 4)]


def plain_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_of_documents(spark, odd, none):  # noqa: F811
    rows = [r for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    looped = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [*map(tuple, rows), *((i, " ".join(f"w{k}" for k in range(i + 7))) for i in looped), (7, "so so so so so so and la la"), (8, "x y " * 9)]
    got = runs.periodic_runs(docs(spark, rows), loops=True)
    assert [f"{n} {t}" for n, t in got.dtypes[:6]] == ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint"]
    expect = collections.Counter((i, *plain_runs(i, t)) for i, t in rows)
    assert collections.Counter(map(tuple, got.collect())) == expect and sum(v for k, v in expect.items() if k[1]) > 5
    short = odd.filter("doc_id IS NULL OR doc_id <> 5")
    assert collections.Counter(map(tuple, runs.periodic_runs(short).collect())) == collections.Counter((r[0], *plain_runs(None, r[1])) for r in ODD if r[0] != 5)
    assert {r["length"] for r in runs.periodic_runs(odd).filter("doc_id = 5").collect()} == {30_000}
    assert runs.periodic_runs(none).count() == 0


def brute_draw(rows, items, percent=5, least=20):
    def grams(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    found = [(i, *grams(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, g in found for b in g), collections.Counter(b for x in items for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out, fit = [], []
    for i, words, g in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None])
        if len(words) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return collections.Counter(map(tuple, out))


def test_draws_equal_brute_force(spark, monkeypatch):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [r["text"] for r in queries.table(spark, SF, "benchmark").collect()]
    expect = brute_draw(rows, items)
    run = lambda: collections.Counter(map(tuple, resampling.resample(docs(spark, rows), spark.createDataFrame([(x,) for x in items], "text string")).collect()))
    assert run() == expect and sum(r[4] is not None for r in expect) == 5 * sum(len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) >= 20 for _, t in rows) // 100
    monkeypatch.setattr(resampling, "LONG_BYTES", 500)
    monkeypatch.setattr(resampling, "CHUNK_WORDS", 17)
    assert run() == expect


def test_checksums_follow_from_those_of_words():
    random.seed(1)
    texts = [[bytes(random.choice(b"ab\xc3\xa9") for _ in range(random.choice([1, 2, 9, 300, 70_000]))) for _ in range(random.randint(0, 5))] for _ in range(20)]
    got = collections.defaultdict(list)
    for text, bucket in resampling.Hasher().buckets_of(texts, np.full(len(texts), 1 << 31)):
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            got[t].append(b)
    for i, w in enumerate(texts):
        assert got[i] == [zlib.crc32(b" ".join(w[k : k + n])) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def test_odd_rows_are_drawn_as_often_as_they_come(spark, odd, none, monkeypatch):  # noqa: F811
    nothing = spark.createDataFrame([], "text string")
    target = spark.createDataFrame([("wort wort twice",), (None,)], "text string")
    rows = odd.unionAll(odd.filter("doc_id = 5"))
    for limit in (1 << 16, 10):
        monkeypatch.setattr(resampling, "LONG_BYTES", limit)
        for t, items in ((nothing, []), (target, ["wort wort twice", None])):
            got = collections.Counter(map(tuple, resampling.resample(rows, t, percent=50).collect()))
            assert got == brute_draw([r[:2] for r in [*ODD, *(r for r in ODD if r[0] == 5)]], items, percent=50)
    assert resampling.resample(none, target).count() == 0
    with pytest.raises(ValueError):
        resampling.resample(odd, target, percent=101)
    assert resampling.noise(F.lit(None).cast("long")) is not None
