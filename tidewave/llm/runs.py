"""Periodic runs of words: stretches that come again and again, found by their Lyndon roots.

Every run of a text holds a Lyndon word of its period's length that is the longest one from where it starts, under one of
two opposite orders of the words. So a text is scanned from right to left once under each order, with a stack of suffixes:
what is left on top is the next smaller suffix, and the way to it the longest Lyndon word. Each of these words is a period
to try; where it comes again at once it is extended as far as it goes to both sides. Suffixes are compared word by word at first and then
by rolling hashes and binary search (the length of their longest common extension); a run is compared word by word before
it counts, and extended word by word should a hash have lied. A text of n words takes some 2n comparisons, whatever is in it.

A text is looked at by itself, so nothing is shuffled, and a task holds one text's words at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_TIMES = 4
#: Words compared one by one before hashes are asked.
NEAR = 8
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Extensions:
    """Longest common extensions of places in a sequence of numbers, by rolling hashes that are made when first needed."""

    def __init__(self, codes: list[int]):
        self.codes, self.n, self._hashes, self._powers, self._stretches = codes, len(codes), None, None, {}

    def _same(self, i: int, j: int, length: int) -> bool:
        h, p = self._hashes, self._powers[length]
        return (h[i + length] - h[i] * p - h[j + length] + h[j] * p) % _PRIME == 0

    def _prepare(self) -> None:
        if self._hashes is None:
            self._hashes = list(accumulate(self.codes, lambda h, c: (h * _BASE + c + 1) % _PRIME, initial=0))
            self._powers = list(accumulate(range(self.n), lambda p, _: p * _BASE % _PRIME, initial=1))

    def _search(self, most: int, same) -> int:
        """The greatest length up to `most` that is the same: doubled while it is, then halved."""
        low, step = 0, NEAR
        while low < most:
            to = min(most, low + step)
            if not same(to):
                most = to - 1
                break
            low, step = to, 2 * step
        while low < most:
            mid = (low + most + 1) // 2
            if same(mid):
                low = mid
            else:
                most = mid - 1
        return low

    def after(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j.

        The stretch that was found last for each distance j - i is kept: next to it nothing needs to be compared again.
        """
        start, stop = self._stretches.get(j - i, (0, -1))
        if start <= i <= stop:
            return stop - i
        self._prepare()
        length = self._search(self.n - j, lambda length: self._same(i, j, length))
        self._stretches[j - i] = (i, i + length)
        return length

    def met(self, i: int, j: int, length: int) -> None:
        """The words from i and from j on were found to be the same for this length and then to differ."""
        self._stretches[j - i] = (i, i + length)

    def before(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        self._prepare()
        return self._search(i, lambda length: self._same(i - length, j - length, length))


def lyndon_lengths(codes: list[int], extensions: Extensions) -> np.ndarray:
    """The length of the longest Lyndon word from each place on, by the order of the codes; an end comes before all codes.

    The stack of suffixes lies in `below`: under a suffix is the next smaller one.
    """
    n = len(codes)
    x = [*codes, min(codes, default=0) - 1]
    below = [0] * n
    for i in range(n - 1, -1, -1):
        own, j = x[i], i + 1
        while own <= (other := x[j]):
            if own == other:
                k = 1
                while k < NEAR and x[i + k] == x[j + k]:
                    k += 1
                if k == NEAR:
                    k += extensions.after(i + k, j + k)
                    extensions.met(i, j, k)
                if x[j + k] < x[i + k]:
                    break
            j = below[j]
        below[i] = j
    return np.array(below, np.int64) - np.arange(n)


def _extent(x: np.ndarray, i: int, period: int, extensions: Extensions) -> tuple[int, int]:
    """(start, stop) of the run of this period about the place i, whose words agree with those a period on."""
    n = len(x)
    start, stop = i - extensions.before(i, i + period), i + period + extensions.after(i, i + period)
    right = np.array_equal(x[start : stop - period], x[start + period : stop])
    if right and (not start or x[start - 1] != x[start - 1 + period]) and (stop == n or x[stop] != x[stop - period]):
        return start, stop
    differ = np.flatnonzero(x[: n - period] != x[period:])  # a hash lied: word by word
    at = int(np.searchsorted(differ, i))
    return (int(differ[at - 1]) + 1 if at else 0), (int(differ[at]) + period if at < len(differ) else n)


def runs_of(codes: list[int], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `times` periods (3 or more), by start, then period."""
    if times < 3:
        raise ValueError("a run needs three periods at least")
    n = len(codes)
    if n < max(least, times):
        return []
    x, extensions, found = np.array(codes), Extensions(codes), set()
    for order in (codes, [-c for c in codes]):
        periods = lyndon_lengths(order, extensions)
        # a run of `times` periods holds its root times - 1 times in a row; the first of them agrees for so long with what is a period on
        at = np.flatnonzero(np.arange(n) + (times - 1) * periods <= n)
        for offset in (0, 1, n):
            look = at + np.minimum(offset, periods[at] * (times - 2) - 1)
            at = at[x[look] == x[look + periods[at]]]
        until: dict[int, int] = {}
        for i, period in zip(at.tolist(), periods[at].tolist(), strict=True):
            if i + 2 * period <= until.get(period, 0):
                continue  # inside the run of this period that was found last
            start, stop = _extent(x, i, period, extensions)
            until[period] = max(stop, until.get(period, 0))
            if stop - start >= max(least, times * period):
                found.add((start, stop - start, period))
    least_periods: dict[tuple[int, int], int] = {}  # a hash that lied may have given a multiple of one as well
    for start, length, period in found:
        least_periods[start, length] = min(period, least_periods.get((start, length), period))
    return sorted(((s, m, p) for (s, m), p in least_periods.items()), key=lambda r: (r[0], r[2]))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by their id, go on in a loop from some word: cases with many runs. Others are as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    loop = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (loop * ((n - a) // len(loop) + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that repeat a run's first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(kept).tolist())


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
           ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def describe(words: list[bytes]) -> tuple:
    """The values of _FIELDS for a text's words."""
    ids: dict[bytes, int] = {}
    found = runs_of([ids.setdefault(w, len(ids)) for w in words])
    best = (None,) * 4
    if found:
        start, length, period = found[0]
        for s, m, p in found[1:]:
            if m * period > length * p:  # ties: the first by start, then period
                start, length, period = s, m, p
        best = (start, length, period, 1000 * length // period)
    digest = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
    return len(found), *best, digest, hashlib.sha256(collapsed(words, found)).hexdigest()


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loops: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A run is a stretch of words with a smallest period q, of at least LEAST_WORDS words and LEAST_TIMES * q, that no
    neighbouring word extends. start, length, period and exponent_milli are of the run with the greatest length / period
    (ties: the smallest start, then period), null where there is none. With `loops` the words are those of looped().
    A null, empty or blank text has no words and no runs; a null id loops nothing; repeated rows are alike; an empty table
    gives no rows; further columns are ignored.
    """
    types = pa.struct([pa.field(*f) for f in _FIELDS])

    def found(ids: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for i, text in zip(ids.to_pylist(), texts, strict=True):
            words = (text.as_py() or b"").split()
            rows.append(describe(looped(words, i) if loops else words))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)] if rows else [pa.array([], t) for _, t in _FIELDS], fields=list(types))

    schema = ", ".join(f"{name} {'string' if t == pa.string() else 'long'}" for name, t in _FIELDS)
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.arrow_udf(found, schema)(doc_id, F.col(text_col).cast("binary")).alias("_r")).select("doc_id", "_r.*")
