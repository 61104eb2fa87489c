"""Jaccard join of texts on word shingles by adaptive multi-match prefixes.

All shingles have one order, those that a sample of the texts holds often last. If two texts of n and m distinct shingles are as
similar as asked, they share a number of them at least, `need`, and of their first n - need + l and m - need + l shingles at
least l. So texts meet by equality of these few, and a pair counts as a candidate only if it meets l times. Each text
chooses its own l: a longer prefix meets more texts, but fewer of them often enough. It takes the l with the least
estimated cost, from how often its shingles occur in the sample; for a pair the lesser of the two counts, and no pair as similar
as asked is missed whatever they choose. Of a pair the smaller text needs a shorter prefix than the larger one, so where most
of many texts is one common passage, they don't meet in it.

Copies by set are one class. Before all that meet are compared, each text under a shingle is compared with one other of them, the
pivot, and what is similar becomes one component; only texts of different components then meet. So a group of near copies
costs work in proportion to its size. Pairs are thrown out by an upper bound from counts by hash bucket, and the rest is verified by
the whole sets.

The identity of a class is a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, join_hot, materialize, release, text_node
from .components import merged
from .shingles import SEED, votes

SHINGLE = 4
SIMILARITY = 0.85
SAMPLE = 16  # one text of so many is looked through for frequent shingles
FREQUENT = 4
FREQUENT_AT_MOST = 100_000  # only the order and the estimates depend on it
MATCHES = 4  # the most shared prefix shingles that a text may ask for
VERIFY = 16.0  # the cost of verifying a pair, in meetings under a shingle
BUCKETS = 128
#: Pivots are tried again while texts of different components would meet over so many times for each row, and half as often as before.
MEETINGS, ROUNDS = 128, 3
WORDS_KEPT = 1 << 15


@dataclass(frozen=True)
class Threshold:
    """A similarity p / q in whole numbers."""

    p: int
    q: int

    @classmethod
    def of(cls, similarity: float) -> Threshold:
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be over 0 and at most 1")
        return cls(*Fraction(similarity).limit_denominator(1_000_000).as_integer_ratio())

    def need(self, n: int) -> int:
        """The least that a text of n shingles shares with any similar one."""
        return -(-self.p * n // self.q)

    def allows(self, shared: Column, n: Column, m: Column) -> Column:
        """Whether so many shared shingles are enough for texts of n and m."""
        return shared.cast("long") * (self.p + self.q) >= (n.cast("long") + m) * self.p

    def sizes(self, n: Column, m: Column) -> Column:
        return F.least(n, m).cast("long") * self.q >= F.greatest(n, m).cast("long") * self.p

    def first(self, n: Column, matches: Column) -> Column:
        """The length of the prefix by which a text of n meets those that aren't smaller, `matches` times."""
        whole = n.cast("long") * (2 * self.p)
        return n - F.ceil(whole / (self.p + self.q)) + matches


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _Words()


def shingles_of(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of the lower-cased words, sorted; of all words where there are fewer; none without words."""
    tokens = (text or b"").lower().split()
    if len(_words) > WORDS_KEPT:
        _words.clear()
    ids = np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))
    size = min(shingle, len(ids))
    count = len(ids) - size + 1 if size else 0
    h = ids[:count] + np.uint64(size)
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + count]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(32)))


def in_order(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in the common order, the rarest first, and how often the sample has each: zero for those not frequent."""
    times = np.zeros(len(shingles), np.int64)
    if len(frequent) and len(shingles):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        times = np.where(frequent[at] == shingles, counts[at], 0)
    order = np.concatenate((np.flatnonzero(times == 0), (often := np.flatnonzero(times))[np.argsort(times[often], kind="stable")]))
    return shingles[order], times[order]


def prefix(shingles: np.ndarray, threshold: Threshold, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A text's prefix and how many of its shingles another text must share: the number of the least estimated cost.

    A prefix meets as many texts as the sample tells of its shingles, and of these at most a share of 1 / l can meet it l times.
    """
    n = len(shingles)
    if not n:
        return shingles, 1
    ordered, times = in_order(shingles, frequent, counts)
    need = threshold.need(n)
    most = min(MATCHES, need)
    met = np.cumsum(times[: n - need + most])[n - need :] * SAMPLE
    matches = 1 + int(np.argmin(met * (1 + VERIFY / np.arange(1, most + 1))))
    return ordered[: n - need + matches], matches


def _sketches(text: Column, shingle: int, threshold: Threshold, frequent, prints: bool) -> Column:
    """Of each text: node (identity of its set), n (its size), keys (its prefix), matches, spread (counts by bucket), print."""

    def found(texts: pa.Array) -> pa.Array:
        rows, (often, counts) = [], frequent.value
        for t in texts:
            whole = shingles_of(t.as_py(), shingle)
            keys, matches = prefix(whole, threshold, often, counts)
            spread = np.bincount((whole % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            few_enough = spread.max() < 256
            node = xxhash.xxh64_intdigest(whole.tobytes(), SEED)
            rows.append((node, len(whole), keys.view(np.int64), matches, spread.astype(np.uint8).tobytes() if few_enough else None, votes(whole) if prints and len(whole) else 0))
        nodes, sizes, keys, matches, spreads, marks = zip(*rows, strict=True) if rows else [()] * 6
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        release()
        columns = [long(nodes), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(matches, pa.int32()), pa.array(spreads, pa.binary()), long(marks)]
        return pa.StructArray.from_arrays(columns, names=["node", "n", "keys", "matches", "spread", "print"])

    return F.arrow_udf(found, "node long, n int, keys array<long>, matches int, spread binary, print long")(text.cast("binary"))


def _sets(text: Column, shingle: int) -> Column:
    def found(texts: pa.Array) -> pa.Array:
        release()
        sets = [shingles_of(t.as_py(), shingle) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "set"])

    return F.arrow_udf(found, "node long, set array<long>")(text.cast("binary"))


def _sampled(texts: DataFrame, shingle: int) -> DataFrame:
    """(_hash, s): the shingles of a sample of the different texts. With explode(), Spark would look for empty sets first, by
    shingling each text once more in a second Python worker of the task."""
    sample = texts.filter(F.pmod("_hash", F.lit(SAMPLE)) == 0).select("_hash", _sets(F.col("_text"), shingle).alias("_s"))
    return sample.select("_hash", F.explode_outer("_s.set").alias("s")).filter("s IS NOT NULL").distinct()


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the different texts, sorted, and in how many of these each is."""
    rows = _sampled(texts, shingle).groupBy("s").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(FREQUENT_AT_MOST).toArrow()
    found = rows["s"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["count"].to_numpy()[order]


class Texts:
    """Texts (`_id`, `_text`) sketched once: `rows` has a row for each text, `classes` one for each different set of shingles."""

    def __init__(self, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, prints: bool = False):
        if shingle < 1:
            raise ValueError("a shingle needs a word at least")
        self.threshold, self.shingle = Threshold.of(similarity), shingle
        self.texts = texts.select("_id", "_text", text_node(F.col("_text")).alias("_hash"))
        frequent = texts.sparkSession.sparkContext.broadcast(_frequent(self.texts, shingle))
        sketch = _sketches(F.col("_text"), shingle, self.threshold, frequent, prints)
        found = materialize(self.texts.select("_id", "_hash", sketch.alias("_f")).select("_id", "_hash", "_f.*"), forget=True)
        self.rows = found.select("_id", "_hash", "node", "n")
        kept = F.first(F.struct("n", "keys", "matches", "spread", "print")).alias("_f")
        self.classes = materialize(found.groupBy("node").agg(F.min("_hash").alias("_hash"), F.min("_id").alias("_first"), kept).select("node", "_hash", "_first", "_f.*"), forget=True)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of some classes: one text of each is shingled again, and only these sets are shuffled."""
        heads = self.classes.join(nodes, "node", "left_semi").select("_hash")
        found = self.texts.join(few(materialize(heads, forget=True)), "_hash", "left_semi").select(_sets(F.col("_text"), self.shingle).alias("_s")).select("_s.*")
        return found.groupBy("node").agg(F.first("set").alias("set"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of different classes that are similar enough."""
        columns = {x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("spread").alias(f"_{x}")) for x in "ab"}
        near = pairs.join(columns["a"], "a").filter("_na > 0").join(columns["b"], "b").filter(self.threshold.sizes(F.col("_na"), F.col("_nb")))
        enough = self.threshold.allows(F.coalesce(_most(F.col("_a"), F.col("_b")), F.least("_na", "_nb").cast("long")), F.col("_na"), F.col("_nb"))
        near = materialize(near.filter(enough).select("a", "b"), forget=True)
        if near.isEmpty():
            return near
        sets = materialize(self.sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct()), forget=True)
        one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"_{x}")) for x in "ab")
        shared = F.size(F.array_intersect("_a", "_b"))
        return materialize(near.join(one, "a").join(two, "b").filter(self.threshold.allows(shared, F.size("_a"), F.size("_b"))).select("a", "b"), forget=True)

    def labels(self, proposed: DataFrame | None = None) -> DataFrame:
        """(node, label) of all classes: the components over all similar pairs. `proposed` pairs are looked at first, in place of
        the first pivots."""
        entries = self.classes.select("node", "n", "matches", F.posexplode("keys").alias("pos", "key"))
        early = F.col("pos").cast("long") * (1 << 32) + F.pmod("node", F.lit(1 << 32))  # who has it first has the fewest shingles of its own
        pivots = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.min_by("node", early).alias("_pivot")).filter("_c > 1").drop("_c")
        met = materialize(entries.join(pivots, "key"), forget=True)
        given = proposed is not None
        if not given:
            proposed = met.filter("node <> _pivot").select(F.least("node", "_pivot").alias("a"), F.greatest("node", "_pivot").alias("b"))
        met = met.drop("_pivot")
        before, labels, fresh = None, self.classes.select("node", F.col("node").alias("label")), self.verified(proposed.distinct())
        for turn in range(ROUNDS + 1):
            labels = merged(labels, fresh)
            met, meetings, rows = self._apart(met, labels)
            if not rows:
                break
            if turn == ROUNDS or meetings <= MEETINGS * rows or before is not None and 2 * meetings > before:
                labels = merged(labels, self.verified(self._candidates(met)))
                break
            before, draw = meetings, F.col("pos").cast("long") if given and not turn else F.xxhash64("node", "key", F.lit(turn))
            pivot = met.groupBy("key").agg(F.min(F.struct(draw.alias("_d"), "node", "label")).alias("_p"))
            pairs = met.join(pivot, "key").filter("label <> _p.label").select(F.least("node", "_p.node").alias("a"), F.greatest("node", "_p.node").alias("b"))
            fresh = self.verified(pairs.distinct())
        return labels

    def _apart(self, met: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
        """What may still meet: rows under shingles that several components have and a text has in its shorter prefix, with labels; how
        often texts of different components meet there, and the rows. All else is settled."""
        part = materialize(met.drop("label").join(labels, "node"), forget=True)
        short = F.count_if(F.col("pos") < self.threshold.first(F.col("n"), F.col("matches")))
        each = part.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_c"), short.alias("_s"))
        keys = each.groupBy("key").agg(F.sum("_c").alias("_all"), F.sum("_s").alias("_short"), F.sum(F.col("_c") * F.col("_s")).alias("_own"), F.count(F.lit(1)).alias("_labels"))
        keys = materialize(keys.filter("_labels > 1 AND _short > 0"), forget=True)
        sums = keys.agg(F.sum(F.col("_all") * F.col("_short") - F.col("_own")).alias("m"), F.sum("_all").alias("r"), F.count(F.lit(1)).alias("k")).first()
        left = keys.select("key")
        return part.join(F.broadcast(left) if sums["k"] <= BROADCAST_ROWS else left, "key", "left_semi"), int(sums["m"] or 0), int(sums["r"] or 0)

    def _candidates(self, part: DataFrame) -> DataFrame:
        """Pairs of different components that meet often enough. The smaller text of a pair meets by its shorter prefix."""
        t, c = self.threshold, F.col
        x, y = ({name: c(name).alias(f"{name}_{side}") for name in ("node", "n", "matches", "pos", "label")} for side in "xy")
        small = part.filter(c("pos") < t.first(c("n"), c("matches"))).select("key", *x.values())
        large = part.select("key", *y.values())
        n, m, i, j = c("n_x"), c("n_y"), c("pos_x"), c("pos_y")
        ordered = (n < m) | ((n == m) & (c("node_x") < c("node_y")))
        after = F.least(n - i, m - j)
        met = small.join(large, "key").filter((c("label_x") != c("label_y")) & ordered & t.sizes(n, m) & t.allows(F.least(i, j) + after, n, m))
        found = met.groupBy("node_x", "node_y").agg(
            F.count(F.lit(1)).alias("_times"), F.min(F.least("matches_x", "matches_y")).alias("_asked"),
            F.max(t.allows(after, n, m)).alias("_first"),  # holds for the first shingle that a similar pair shares
        )
        pairs = found.filter("_times >= _asked AND _first")
        return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _most(a: Column, b: Column) -> Column:
    """The most shingles that two texts can share: the lesser counts of all buckets, null where one isn't known."""

    def found(xs: pa.Array, ys: pa.Array) -> pa.Array:
        release()
        known = np.flatnonzero([x.is_valid and y.is_valid for x, y in zip(xs, ys, strict=True)])
        out = np.zeros(len(xs), np.int64)
        if len(known):
            p, q = (np.frombuffer(b"".join(v.take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, BUCKETS) for v in (xs, ys))
            out[known] = np.minimum(p, q).sum(axis=1, dtype=np.int64)
        gone = np.ones(len(xs), bool)
        gone[known] = False
        return pa.array(out, mask=gone)

    return F.arrow_udf(found, "long")(a, b)


def similar_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of `shingle` words is `similarity` or more. component_id is the smallest
    doc_id reachable by links, itself included; null ids never name a component unless it has no other (then it is null). Null, empty
    and blank texts have no shingles and link with nothing; repeated rows are returned as often as they come; an empty table
    gives no rows; further columns are ignored.
    """
    texts = Texts(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), shingle, similarity)
    joined = materialize(texts.labels().join(texts.classes.select("node", "_first"), "node"), forget=True)
    heads = joined.groupBy("label").agg(F.min("_first").alias("_least"))
    found = join_hot(texts.rows, join_hot(joined, heads, "label").select("node", "_least"), "node")
    return found.select(F.col("_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("_least")).alias("component_id"))
