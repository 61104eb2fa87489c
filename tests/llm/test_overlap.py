"""The Jaccard join by adaptive prefixes against brute force, with groups, boilerplate and odd rows."""

import collections
import itertools
import random

import numpy as np
import pytest
from test_text_operators import ODD, SF, brute_components, docs, none, odd  # noqa: F401

from tidewave.llm import overlap, queries


def brute_sets(rows, shingle=4):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def brute(rows, p=85):
    sets = brute_sets(rows)
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])]
    label = brute_components(range(len(rows)), near)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[label[i]] = min(doc, least.get(label[i], doc))
    return collections.Counter((doc, len(sets[i]), least.get(label[i])) for i, (doc, _) in enumerate(rows))


def run(spark, rows, **kw):
    return collections.Counter(map(tuple, overlap.similar_documents(docs(spark, rows), **kw).collect()))


def test_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    expect = brute(rows)
    assert sum(d != c for d, _, c in expect) > 5
    got = queries.op11_similarity(spark, SF)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["doc_id bigint", "n_shingles bigint", "component_id bigint"]
    assert collections.Counter(map(tuple, got.collect())) == expect


@pytest.mark.parametrize("sample, meetings", [(1, 0), (1, 8), (16, 8)])
def test_groups_chains_and_boilerplate_equal_brute_force(spark, monkeypatch, sample, meetings):
    monkeypatch.setattr(overlap, "SAMPLE", sample)
    monkeypatch.setattr(overlap, "MEETINGS", meetings)  # 0: pivots are tried in every round
    draw = random.Random(sample * 10 + meetings)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(60):  # texts that are mostly one passage
        texts.append([word() for _ in range(draw.randrange(14))] + passage + [word() for _ in range(draw.randrange(4))])
    base = [word() for _ in range(90)]
    for _ in range(80):  # copies of one text with some words changed, some too many
        text = list(base)
        for _ in range(draw.randrange(6)):
            text[draw.randrange(len(text))] = word()
        texts.append(text)
    chain = [word() for _ in range(60)]
    for _ in range(25):  # each like the one before, not like the first
        chain = [*chain[2:], word(), word()]
        texts.append(chain)
    texts += [[w] * draw.randrange(1, 9) for w in "abab"]
    rows = [(i, " ".join(t)) for i, t in enumerate(draw.sample(texts, len(texts)))]
    assert run(spark, rows) == brute(rows)


def test_thresholds_are_exact(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words[:203])), (2, " ".join(words[15:218])), (3, " ".join(words[38:218]))]  # 185 of 215; 180 - 3 = 177 of 200
    for similarity, p in ((0.86, 86), (0.85, 85), (0.885, 88.5), (0.8851, 88.51)):
        assert run(spark, rows, similarity=similarity) == brute(rows, p)


def test_prefixes_meet_as_often_as_asked():
    draw = random.Random(4)
    often = np.unique(np.array([draw.getrandbits(64) for _ in range(40)], np.uint64))
    counts = np.array([draw.randrange(4, 90) for _ in often], np.int64)
    asked, t = set(), overlap.Threshold.of(0.8)
    for _ in range(3000):
        pool = np.concatenate((np.array([draw.getrandbits(64) for _ in range(draw.randrange(1, 30))], np.uint64), often))
        a = np.unique(np.array(draw.sample(pool.tolist(), draw.randrange(1, min(50, len(pool)))), np.uint64))
        b = np.unique(np.concatenate((a[draw.randrange(3) :], np.array([draw.getrandbits(64) for _ in range(draw.randrange(6))], np.uint64))))
        if not len(b) or 10 * len(np.intersect1d(a, b)) < 8 * len(np.union1d(a, b)):
            continue
        (p, l), (q, m) = overlap.prefix(a, t, often, counts), overlap.prefix(b, t, often, counts)
        if (len(a), a.tolist()) > (len(b), b.tolist()):
            p, l, q, m, a, b = q, m, p, l, b, a
        first = len(a) - -(-2 * t.p * len(a) // (t.p + t.q)) + l
        assert len(np.intersect1d(p[:first], q)) >= min(l, m)
        asked.add(l)
    assert len(asked) > 1


def test_odd_rows(spark, odd, none):  # noqa: F811
    assert collections.Counter(map(tuple, overlap.similar_documents(odd).collect())) == brute([r[:2] for r in ODD])
    assert overlap.similar_documents(none).count() == 0
    rows = [(None, "one two three four five"), (None, "One  two three four FIVE"), (3, None), (9, "six"), (8, "Six"), (9, "six")]
    assert run(spark, rows) == brute(rows)
    for bad in ({"similarity": 0}, {"similarity": 1.5}, {"shingle": 0}):
        with pytest.raises(ValueError):
            run(spark, rows, **bad)
