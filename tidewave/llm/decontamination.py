"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by up to `budget` character edits, a share of its length. Cut the item into
budget + 1 pieces: an occurrence within the budget holds at least one piece unchanged. So one automaton with the pieces
of all items runs over a text, each exact hit names a window of the text in which the item may lie, and Myers'
bit-parallel distance decides there. Texts and items are compared in lower case with single spaces.

The items are the stated query set. They are read in blocks of bounded size, and each block passes over all documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.08
#: Characters of normalised items in one block, which every worker holds as an automaton.
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _whole(text: str, start: int, stop: int) -> bool:
    """Whether a stretch neither begins nor ends inside a word."""
    before, after = text[start - 1 : start] if start else "", text[stop : stop + 1]
    return not (before.isalnum() and text[start].isalnum()) and not (after.isalnum() and text[stop - 1].isalnum())


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.size = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i

    def best(self, window: str) -> tuple[int, int]:
        """(distance, end) of the nearest substring of the window, the first to end of those at the least distance."""
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        masks, up, down, score = dict(self.masks), full, 0, self.size
        least, at = score, 0
        for i, c in enumerate(window):
            eq = masks.get(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = (down | ~(across | up)) & full
            minus = up & across
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < least:
                    least, at = score, i + 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical
        return least, at


class Matcher:
    """Finds occurrences of a block of items: (item number, text) pairs, normalised and not empty."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}
        by_piece: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                by_piece[piece].append((n, offset + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def _verify(self, n: int, text: str, start: int, stop: int) -> tuple[int, int, int] | None:
        """(distance, start, stop) of the best occurrence in a stretch of the text, if within the budget."""
        _, item, budget = self.items[n]
        at = text.find(item, start, stop)
        while not budget and at >= 0 and not _whole(text, at, at + len(item)):
            at = text.find(item, at + 1, stop)
        if at >= 0:
            return 0, at, at + len(item)
        if not budget:
            return None
        if n not in self.patterns:
            self.patterns[n] = (Pattern(item), Pattern(item[::-1]))
        ahead, back = self.patterns[n]
        distance, end = ahead.best(text[start:stop])
        if distance > budget:
            return None
        _, length = back.best(text[max(start, start + end - len(item) - distance) : start + end][::-1])
        return distance, start + end - length, start + end

    def find(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop), the best occurrence of each item, leftmost of equals; only one if `first`."""
        if not len(self.automaton):
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for n, shift in places:
                begins[n].add(end - shift)
        out = []
        for n, starts in sorted(begins.items()):
            item_id, item, budget = self.items[n]
            best, stretch = None, None
            for s in [*sorted(starts), None]:
                a, b = (max(0, s - budget), s + len(item) + budget) if s is not None else (0, 0)
                if stretch and s is not None and a <= stretch[0] + 2 * budget:
                    stretch = (stretch[0], max(stretch[1], b))  # begins of one occurrence shift by the edits before them
                    continue
                if stretch:
                    found = self._verify(n, text, *stretch)
                    best = min((x for x in (best, found) if x), default=None)
                stretch = (a, b)
            if best:
                out.append((item_id, *best))
                if first:
                    return out
        return out


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items, rate: float) -> Matcher:
    """A worker builds a block's automaton once and forgets the block before."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items.value, rate)
    return _matchers[key]


def blocks(items: DataFrame, *, id_col="item_id", text_col="text", most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `most` characters; null and blank ones match nothing and are left out."""
    block, size = [], 0
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator(prefetchPartitions=True):
        text = normalise(r[1])
        if text:
            block.append((r[0], text))
            size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _find_task(key: str, items, rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, rate)
        for batch in batches:
            release()
            out = [
                (doc_id, *found)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for found in matcher.find(normalise(text.as_py()))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 5)],
                names=["doc_id", "item_id", "distance", "start", "stop"],
            )

    return run


def find(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", rate: float = ERROR_RATE) -> DataFrame:
    """One row per (row of docs, item) with an occurrence within the budget: doc_id, item_id, distance, start, stop.

    The budget is `rate` times the item's characters, rounded down. start and stop count code points of the normalised
    text and bound the best occurrence. Null and empty texts hold nothing, repeated rows are found as often as they come,
    repeated items are told by their id and give a row each, and empty tables give no rows. An item too short for an edit must
    stand as whole words: "cat" isn't found in "category".
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance long, start long, stop long"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    out = spark.createDataFrame([], schema)
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(_find_task(uuid.uuid4().hex, shared, rate), schema))
    return out


def _holds(key: str, items, rate: float):
    def run(texts: pa.Array) -> pa.Array:
        release()
        matcher = _matcher(key, items, rate)
        return pa.array([bool(matcher.find(normalise(t.as_py()), first=True)) for t in texts], pa.bool_())

    return run


def clean(docs: DataFrame, items: DataFrame, *, text_col="text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs whose text holds no item within the budget, with all their columns. Nothing is shuffled.

    Null and empty texts stay; repeated rows are decided alike; no items or no documents leave everything as it is. Short
    items count as in find().
    """
    spark = docs.sparkSession
    for block in blocks(items):
        holds = F.arrow_udf(_holds(uuid.uuid4().hex, spark.sparkContext.broadcast(block), rate), "boolean")
        docs = docs.filter(~holds(F.col(text_col)))
    return docs
