"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides.

Every rule looks at a document's counts and votes good, votes bad or abstains. Documents with the same votes are alike to
the model, so all that it needs from the corpus is how often each pattern of votes occurs: at most 3^rules counts, summed
by Spark over all documents. The model (a hidden quality; each rule's votes independent given it) is fitted to those
counts, which gives each rule's accuracy and each pattern's posterior probability of good quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, words

BAD, ABSTAIN, GOOD = 0, 1, 2
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_marks", "n_upper", "n_symbol_words", "n_symbol_lines")


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


@dataclass(frozen=True)
class Rule:
    """A rule's vote from the counts, a name and a vectorised function."""

    name: str
    vote: Callable[[dict[str, np.ndarray]], np.ndarray]


def _between(name: str, top: str, base: str, good: tuple, bad: tuple, least: int = 1) -> Rule:
    """Good if top / base lies in `good`, bad if outside `bad`; abstains between, and where base is under `least`."""

    def vote(c):
        x, ok = _share(c[top], c[base]), c[base] >= least
        return _vote(ok & ((x < bad[0]) | (x > bad[1])), ok & (x >= good[0]) & (x <= good[1]))

    return Rule(name, vote)


RULES: tuple[Rule, ...] = (
    _between("symbols", "n_symbols", "n_words", (0, 0.05), (0, 0.25)),
    _between("symbol words", "n_symbol_words", "n_words", (0, 0.05), (0, 0.2)),
    _between("symbol lines", "n_symbol_lines", "n_lines", (0, 0.1), (0, 0.5)),
    _between("repeated words", "n_repeat_words", "n_words", (0, 0.1), (0, 0.2)),
    _between("repeated lines", "n_dup_lines", "n_lines", (0, 0), (0, 0.3), 3),
    _between("distinct words", "n_distinct", "n_words", (0.5, 1), (0.25, 1), 30),
    _between("marks", "n_marks", "n_words", (0.03, 0.5), (0, 1)),
    _between("upper case", "n_upper", "n_words", (0, 0.05), (0, 0.3)),
    _between("word length", "word_chars", "n_words", (3, 7), (2, 12)),
)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE for each text of a string array without nulls.

    n_repeat_words counts the words that lie in some window of five words which occurs twice or more in its text.
    """
    n = len(texts)
    flat, per = words(texts)
    owner = np.repeat(np.arange(n), per)
    coded = flat.dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    total = lambda values: np.bincount(owner, weights=values[ids], minlength=n).astype(np.int64)
    symbols = pc.count_substring_regex(distinct, SYMBOLS).to_numpy(zero_copy_only=False)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    upper = pc.utf8_is_upper(distinct).to_numpy(zero_copy_only=False) & (length > 1)
    out = {
        "n_words": per,
        "word_chars": total(length),
        "n_symbols": total(symbols),
        "n_marks": total(pc.count_substring_regex(distinct, r"[.,!?]").to_numpy(zero_copy_only=False)),
        "n_upper": total(upper.astype(float)),
        "n_symbol_words": total((symbols > 0).astype(float)),
        "n_distinct": np.bincount(pd.unique(owner << 32 | ids) >> 32, minlength=n),
    }
    lists = pc.split_pattern(texts, "\n")
    line_owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = lists.flatten()
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    lines, line_owner = lines.filter(pa.array(full)), line_owner[full]
    line_ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(pd.unique(line_owner << 32 | line_ids) >> 32, minlength=n)
    busy = pc.count_substring_regex(lines, SYMBOLS).to_numpy(zero_copy_only=False) >= 3
    out["n_symbol_lines"] = np.bincount(line_owner[busy], minlength=n)
    out["n_repeat_words"] = _repeated(ids, owner, per)
    return {k: out[k].astype(np.int64) for k in (*COUNTS, *MORE)}


def _repeated(ids: np.ndarray, owner: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Words covered by repeated windows, per text: equal pairs get one number, then equal fours, then equal fives."""
    n = len(per)
    if len(ids) < WINDOW:
        return np.zeros(n, np.int64)
    number = lambda a, b: pd.factorize(a.astype(np.int64) << 32 | b.astype(np.int64))[0]
    two = number(ids[:-1], ids[1:])
    four = number(two[:-2], two[2:])
    five = number(four[:-1], ids[4:])
    starts = np.flatnonzero(owner[: -WINDOW + 1] == owner[WINDOW - 1 :])
    key = number(five[starts], owner[starts])
    again = starts[np.bincount(key)[key] > 1] if len(key) else starts
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=n)


def pattern(c: dict[str, np.ndarray], rules=RULES) -> np.ndarray:
    """The votes of all rules as one number, a digit of base 3 for each rule."""
    return sum(r.vote(c).astype(np.int64) * 3**i for i, r in enumerate(rules))


def _count_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            c = counts(texts)
            columns = [batch.column(0).slice(at, len(texts)), *(pa.array(c[k]) for k in COUNTS), pa.array(pattern(c))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "_pattern"])


@dataclass(frozen=True)
class LabelModel:
    prior: float  # probability of good quality
    votes: np.ndarray  # [rule, quality, vote] probabilities
    posterior: np.ndarray  # of good quality, per pattern given to fit()

    def accuracy(self) -> np.ndarray:
        """Per rule: how often a vote that isn't an abstention is right."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.votes[:, 0, BAD] + p[1] * self.votes[:, 1, GOOD]
        cast = (p[:, None] * self.votes[:, :, [BAD, GOOD]]).sum(axis=(1, 2))
        return right / np.maximum(cast, 1e-12)


def fit(patterns: np.ndarray, weights: np.ndarray, n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over patterns that occur `weights` times, begun at the share of good votes.

    Probabilities are smoothed by one count each. Sums run in the order of the patterns, so equal counts give equal results.
    """
    order = np.argsort(patterns)
    digits = (patterns[order][:, None] // 3 ** np.arange(n_rules)) % 3
    w = weights[order].astype(float)
    good, bad = (digits == GOOD).sum(1), (digits == BAD).sum(1)
    q = (good + 1) / (good + 3 * bad + 2)
    hot = np.stack([(digits == v) for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    for _ in range(rounds):
        mass = np.stack([w * (1 - q), w * q])
        prior = float((mass[1].sum() + 1) / (w.sum() + 2))
        votes = np.einsum("yp,prv->ryv", mass, hot) + 1
        votes /= votes.sum(axis=2, keepdims=True)
        score = np.einsum("prv,ryv->py", hot, np.log(votes)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))
        done = np.abs(new - q).max(initial=0) < tolerance
        q = new
        if done:
            break
    posterior = np.empty_like(q)
    posterior[order] = q
    return LabelModel(prior, votes, posterior)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    base_failed: under 10 words, or over a fifth of the words repeated. kept: not failed and the posterior probability of good quality at
    least `threshold`. Null and empty texts have no words and fail; repeated rows are judged alike; an empty table gives
    no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", _pattern long"
    counted = materialize(rows.mapInArrow(_count_task, schema))
    tally = counted.groupBy("_pattern").count().collect()  # at most 3^rules rows
    patterns = np.array([r["_pattern"] for r in tally], np.int64)
    model = fit(patterns, np.array([r["count"] for r in tally]), len(RULES))
    found = spark.createDataFrame(
        list(zip(patterns.tolist(), model.posterior.tolist(), strict=True)), "_pattern long, posterior double"
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.join(F.broadcast(found), "_pattern").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior"
    )
