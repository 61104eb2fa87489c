"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

Units are words reduced to their letters (inserted marks go, single letters set apart are put together), with a mark at
either end. The kernel of two units sums over all common subsequences of three symbols within SPAN places, gaps allowed, LAMBDA
to the power of the spans in both, and is scaled by the units' lengths. Long units are looked at by overlapping windows of WINDOW letters. So an insult with a letter put in or left out keeps most of its
similarity. Landmark units give each unit Nyström coordinates; the machine is linear in them. Because the kernel is an
inner product of subsequence weights, landmarks and machine together come down to one weight for each triple of symbols,
and a unit's margin is a sum over its own triples: scoring needs no landmark at all, and is exact.

A text is toxic if any of its units is: its margin is the largest of theirs. Labels tell of whole texts, so units are
labelled first: those found in toxic texts far more often than chance allows, and hardly in clean ones, against units of clean
texts. These labelled units are the machine's training rows. Copies of a text count once. Every choice is made in a full
order, so the model depends on the labelled rows alone, not on how they are partitioned.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, slices, words
from .shingles import shingle_hashes

LAMBDA = 0.7
SPAN = 8  # places that a subsequence may lie across; a wider one would weigh LAMBDA ** 9 or less
WINDOW = 24  # letters of a long unit that are looked at together
EDGE, OTHER, OTHERS = 26, 27, 6  # letters outside a-z share OTHERS symbols by hash
SYMBOLS = OTHER + OTHERS
#: Labelled texts and units that training looks at, at most (about): toxic texts, clean texts, clean units, landmarks.
TOXIC_TEXTS, CLEAN_TEXTS, CLEAN_UNITS, LANDMARKS = 4000, 8000, 20_000, 400
#: Times that all clean units are searched for those nearest to insults, and how many of them training takes up each time.
MINING_ROUNDS, HARD_UNITS = 2, 2000
FALSE_ALARM = 3
CHANCE = 0.05  # that any unit is taken for an insult by chance
_TABLE = {i: None for i in range(128) if not chr(i).isalpha()}


def letters(word: str) -> str:
    """A word's letters, lower-cased, without accents; other scripts' letters stay."""
    word = word.translate(_TABLE).lower()
    if word.isascii():
        return word
    word = unicodedata.normalize("NFKD", word.replace("ß", "ss"))
    return "".join(c for c in word if c.isalpha())


def _codes(unit: str) -> list[int]:
    return [EDGE, *(ord(c) - 97 if "a" <= c <= "z" else OTHER + ord(c) * 2654435761 % (1 << 32) * OTHERS // (1 << 32) for c in unit), EDGE]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < k within SPAN places in n symbols, and their weights, scaled to a vector of length 1 if no triple repeats."""
    at = np.array([t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN], np.int64).reshape(-1, 3)
    weight = LAMBDA ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / max(np.sqrt((weight**2).sum()), 1e-12)


def _windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[a : a + WINDOW] for a in range(0, len(unit) - WINDOW // 2, WINDOW // 2)]


def _by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, triple codes [row, triple], weights) for the units of each length."""
    length = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(length).tolist():
        at, weight = _triples(n + 2)
        rows = np.flatnonzero(length == n)
        for part in np.array_split(rows, max(1, len(rows) * len(weight) // 250_000)):
            symbols = np.array([_codes(units[r]) for r in part.tolist()], np.int64).reshape(len(part), n + 2)
            codes = (symbols[:, at[:, 0]] * SYMBOLS + symbols[:, at[:, 1]]) * SYMBOLS + symbols[:, at[:, 2]]
            yield part, codes, weight


def _window_values(units: list[str], weights: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(unit, window, margin) of all windows. Sums in other portions differ in the last places; decisions must not."""
    if all(0 < len(u) <= WINDOW for u in units):
        windows, owner = units, np.arange(len(units))
    else:
        parts = [(r, w) for r, u in enumerate(units) for w in _windows(u) if w]
        windows, owner = [w for _, w in parts], np.array([r for r, _ in parts], np.int64)
    value = np.empty(len(windows))
    for rows, codes, weight in _by_length(windows):
        value[rows] = weights[codes] @ weight
    return owner, windows, np.round(value, 9)


def margins(units: list[str], weights: np.ndarray) -> np.ndarray:
    """Each unit's margin without the intercept, its largest window's if it is long; units without letters get -inf."""
    owner, _, value = _window_values(units, weights)
    out = np.full(len(units), -np.inf)
    np.maximum.at(out, owner, value)
    return out


def largest_windows(units: list[str], weights: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """margins() and the window that each comes from, the first of equals."""
    owner, windows, value = _window_values(units, weights)
    out, best = np.full(len(units), -np.inf), [""] * len(units)
    for r, w, v in zip(owner.tolist(), windows, value.tolist(), strict=True):
        if v > out[r]:
            out[r], best[r] = v, w
    return out, best


def features(units: list[str]) -> np.ndarray:
    """The units' subsequence vectors, dense: for the few units of training."""
    out = np.zeros((len(units), SYMBOLS**3), np.float32)
    for rows, codes, weight in _by_length(units):
        np.add.at(out, (rows[:, None], codes), np.broadcast_to(weight, codes.shape))
    return out


def units_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, unit of each word, text of each word); runs of three or more single letters make one unit too."""
    flat, per = words(texts)
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(per)), per)
    reduced = [letters(w) for w in distinct]
    number, unique = pd.factorize(np.array(reduced, object)) if reduced else (np.zeros(0, np.int64), [])
    units, ids = list(unique), number[ids]
    single = np.array([len(u) == 1 for u in units], bool)[ids] if len(ids) else np.zeros(0, bool)
    if single.sum() >= 3:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        known = {u: i for i, u in enumerate(units)}
        more: list[tuple[int, int]] = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            cuts = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1).tolist(), b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x >= 3:
                    joined = "".join(units[i] for i in ids[x:y].tolist())
                    more.append((known.setdefault(joined, len(known)), int(owner[x])))
        units = list(known)
        if more:
            ids = np.concatenate([ids, np.array([m[0] for m in more])])
            owner = np.concatenate([owner, np.array([m[1] for m in more])])
    return units, ids, owner


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the triples
    slope: float
    middle: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        units, ids, owner = units_of(texts)
        out = np.full(len(texts), -np.inf)
        if len(ids):
            np.maximum.at(out, owner, margins(units, self.weights)[ids])
        return out

    def scores(self, margin: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a text without letters gets the least."""
        margin = np.nan_to_num(margin, neginf=-1e3)
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -50, 50)))


def nystrom_svm(units: list[str], labels: np.ndarray, landmarks: list[str], cost: float = 1000.0) -> np.ndarray:
    """The triples' weights of a machine with squared hinge loss, both classes counted alike, in Nyström coordinates."""
    base = features(landmarks)
    own = (base @ base.T).astype(float)
    value, vector = np.linalg.eigh(own + 1e-6 * np.eye(len(own)))
    value = np.maximum(value, 1e-6)
    root = vector / np.sqrt(value) @ vector.T
    kernel = np.concatenate([features(units[i : i + 500]) @ base.T for i in range(0, len(units), 500)]).astype(float)
    x = np.hstack([kernel @ root, np.ones((len(units), 1))])
    y = np.where(labels, 1.0, -1.0)
    share = np.where(labels, 0.5 / max(labels.sum(), 1), 0.5 / max((~labels).sum(), 1)) * cost * 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):  # Newton steps: within a set of violated margins the loss is quadratic
        active = y * (x @ w) < 1
        a = x[active] * share[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return (root @ w[:-1]) @ base.astype(float)


def _unit_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, unit, toxic) once for each unit of a labelled text."""
    for batch in batches:
        release()
        docs, toxic = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for at, texts in slices(batch.column(1)):
            units, ids, owner = units_of(texts)
            if len(ids):
                pair = pd.unique(owner << 32 | ids)
                unit, text = pair & 0xFFFFFFFF, (pair >> 32) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[text]), pa.array(units, pa.string()).take(pa.array(unit)), pa.array(toxic[text])],
                    names=["doc_id", "unit", "toxic"],
                )


def training_texts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text, toxic): a sample by hash of the labelled texts, about TOXIC_TEXTS and CLEAN_TEXTS at most, copies once."""
    told = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    told = told.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    many = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, F.lit(TOXIC_TEXTS / max(many.get(1, 0), 1))).otherwise(F.lit(CLEAN_TEXTS / max(many.get(0, 0), 1)))
    picked = told.filter(draw < share)  # bounded by the two parameters, hence fit to be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    key = F.pandas_udf(_copy_key, "long")
    first = F.min(F.struct("doc_id", "text")).alias("_first")
    once = found.withColumn("_key", key("text")).groupBy("_key", "toxic").agg(first)
    return materialize(once.select("_first.doc_id", "_first.text", "toxic"))


#: Near copies share the least shingle in all of so many orders; texts that share a line don't.
ORDERS = 4


def _copy_key(texts: pd.Series) -> pd.Series:
    """One number for the least shingles of a text in ORDERS orders, each by an odd multiple of the shingles' hashes."""
    odd = np.array([2 * xxhash.xxh64_intdigest(bytes([k])) + 1 & 0xFFFFFFFFFFFFFFFF for k in range(ORDERS)], np.uint64)
    out = []
    for t in texts:
        found = shingle_hashes((t or "").lower().encode().split())
        least = [int((found * m).min()) for m in odd] if len(found) else []
        out.append(xxhash.xxh64_intdigest(repr(least).encode()) - (1 << 63))
    return pd.Series(out, dtype="int64")


def _by_chance(toxic: int, clean: int, share: float) -> float:
    """The probability that of toxic + clean texts at least `toxic` are toxic ones, where a share of them is."""
    n, log = toxic + clean, math.lgamma
    return sum(
        math.exp(log(n + 1) - log(k + 1) - log(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
        for k in range(toxic, n + 1)
    )


def _insults(tally: DataFrame, n_toxic: int, n_clean: int, n_units: int) -> list[str]:
    """Units that toxic texts hold more often than chance allows, all units considered, and clean texts hardly ever."""
    share = n_toxic / (n_toxic + n_clean)
    likely = tally.filter((F.col("toxic") >= 2) & (F.col("clean") * 50 <= F.col("toxic")) & (F.length("unit") > 1)).collect()
    return sorted(r["unit"] for r in likely if _by_chance(r["toxic"], r["clean"], share) * n_units < CHANCE)


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text") -> Model:
    """Fit a model to labelled texts (labels: doc_id, toxic 0 or 1). Without toxic or clean texts all scores are zero.

    What comes to the driver is bounded by the parameters above: counts, likely units of the sampled toxic texts, sampled
    clean units, and the margins of the sampled texts.
    """
    texts = training_texts(docs, labels, id_col, text_col)
    many = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = many.get(1, 0), many.get(0, 0)
    nothing = Model(np.zeros(SYMBOLS**3), 1.0, 1e3)
    if not n_toxic or not n_clean:
        return nothing
    pairs = materialize(texts.mapInArrow(_unit_task, "doc_id long, unit string, toxic int"))
    tally = materialize(pairs.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")))
    n_units = tally.count()
    insults = _insults(tally, n_toxic, n_clean, n_units)
    if not insults:
        return nothing
    clean = tally.filter((F.col("clean") > 0) & (F.length("unit") > 0))
    clean = clean.withColumn("_draw", F.pmod(F.xxhash64("unit"), F.lit(1_000_000))).filter(
        F.col("_draw") < F.lit(1e6 * CLEAN_UNITS / max(n_units, 1))
    )
    insults = sorted({w for u in insults for w in _windows(u)})
    rest = sorted({w for r in clean.select("unit").collect() for w in _windows(r["unit"])} - set(insults))
    weights = fit_units(insults, rest)
    for _ in range(MINING_ROUNDS):
        held = tally.filter((F.col("clean") > 0) & (F.col("clean") * 50 > F.col("toxic")) & (F.length("unit") > 0))
        near = held.select("unit").mapInArrow(_mining_task(weights), "unit string, margin double")
        hard = near.groupBy("unit").agg(F.max("margin").alias("margin")).orderBy(F.desc("margin"), "unit").limit(HARD_UNITS).collect()
        rest = sorted({*rest, *(r["unit"] for r in hard)} - set(insults))
        weights = fit_units(insults, rest)
    model = Model(weights, 1.0, 0.0)
    seen = texts.mapInArrow(_margin_task(model, False), "doc_id long, margin double").join(texts.select("doc_id", "toxic"), "doc_id")
    seen = sorted(seen.select("margin", "toxic").collect())
    margin = np.nan_to_num(np.array([r["margin"] for r in seen], float), neginf=-1e3)
    return _calibrated(weights, margin, np.array([r["toxic"] for r in seen], bool))


def fit_units(insults: list[str], clean: list[str], rounds: int = 3, first: int = 2000) -> np.ndarray:
    """Train on insults and some clean units, then add the clean units that come nearest, and train again."""
    step = max(1, len(clean) // first)
    chosen = near = clean[::step]
    weights = np.zeros(SYMBOLS**3)
    for _ in range(rounds):
        half = LANDMARKS // 2
        landmarks = insults[:: max(1, -(-len(insults) // half))] + near[:: 1 if weights.any() else max(1, -(-len(near) // half))][:half]
        weights = nystrom_svm(insults + chosen, np.arange(len(insults) + len(chosen)) < len(insults), landmarks)
        near = [clean[i] for i in np.argsort(-margins(clean, weights), kind="stable")[:HARD_UNITS]]
        chosen = sorted({*chosen, *near})
    return weights


def _mining_task(weights: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, window = largest_windows(batch.column(0).to_pylist(), weights)
            release()
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.string()), pa.array(value)], names=["unit", "margin"])

    return run


def _calibrated(weights: np.ndarray, margin: np.ndarray, toxic: np.ndarray) -> Model:
    """The middle lies where margins part the two kinds of texts with the least loss, the slope spans the gap there.

    A clean text taken for a toxic one counts as FALSE_ALARM missed ones.
    """
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], toxic[order]
    wrong = np.concatenate(([0], np.cumsum(t))) + FALSE_ALARM * (np.sum(~t) - np.concatenate(([0], np.cumsum(~t))))
    cuts = np.flatnonzero(wrong == wrong.min())
    lo, hi = (m[cuts[0] - 1] if cuts[0] else m[0] - 1), (m[cuts[-1]] if cuts[-1] < len(m) else m[-1] + 1)
    middle, gap = lo + (hi - lo) / 5, max(hi - lo, 0.05)
    slope = 8 / gap
    return Model(weights, slope, middle - 0.85 / slope)  # 0.7 is scored at the middle itself


def _margin_task(model: Model, score: bool = True):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for at, texts in slices(batch.column(1)):
                value = model.margins(texts)
                value = model.scores(value) if score else value
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(value)], names=["doc_id", "score" if score else "margin"]
                )

    return run


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 if the score is `threshold` or more).

    Only the text counts. Null, empty and letterless texts score least; repeated rows score alike; an empty table gives no
    rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_margin_task(model), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: Model, *, text_col="text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns. Nothing is shuffled.

    Null, empty and letterless texts stay; repeated rows are decided alike; an empty table stays empty.
    """

    def passes(texts: pa.Array) -> pa.Array:
        out = [model.scores(model.margins(part)) < threshold for _, part in slices(texts)]
        release()
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(F.arrow_udf(passes, "boolean")(F.col(text_col)))
