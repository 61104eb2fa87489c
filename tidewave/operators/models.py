"""Subject-grouped models: folds, a registry of estimators (Spark's own, and boosted trees) and the cross-validated run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tidewave.functions.lineage import cut
from tidewave.sources.sinks import read_note, write_note

from . import boosting
from .decoding import best_weight, decode
from .evaluation import CLASSES, balanced_weights, scores, transitions
from .selection import select_columns, within_budget

MODELS: dict[str, Callable[[], list]] = {
    "ridge": lambda: [
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(family="multinomial", regParam=0.01, maxIter=50, weightCol="weight", labelCol="stage", probabilityCol="probability"),
    ],
    "forest": lambda: [
        StandardScaler(inputCol="raw_features", outputCol="features"),
        RandomForestClassifier(numTrees=40, maxDepth=6, seed=0, weightCol="weight", labelCol="stage", probabilityCol="probability"),
    ],
}


#: Parameters of the model "boosted".
BOOSTED = {"rounds": 40, "depth": 3, "bins": 64, "rate": 0.3}
NAMES = (*MODELS, "boosted")


def majority(df: DataFrame, fold: str, stage: str) -> DataFrame:
    """df with `pred`: the most frequent stage of the other folds, the smaller one of equals. Only counts are shuffled."""
    wide = df.groupBy(fold).pivot(stage).count().na.fill(0)
    names = [c for c in wide.columns if c != fold]
    every = W.partitionBy(F.lit(0))  # over the counts, a row per fold
    others = [F.struct((F.sum(c).over(every) - F.col(c)).alias("n"), (-F.lit(int(c))).alias("s")) for c in names]
    best = wide.select(fold, (-F.array_max(F.array(*others))["s"]).alias("pred"))
    return df.join(F.broadcast(best), fold)


#: Up to so many subjects each is dealt by what all before it have left; it takes a row of counts per subject on the driver.
GREEDY_SUBJECTS = 10_000
#: More are dealt in lots of so many, or more where there would be over LOTS lots.
LOT, LOTS = 1_000, 10_000


def group_folds(df: DataFrame, subject: str, stage: str, folds: int = 10, seed: int = 0) -> DataFrame:
    """(subject, fold): whole subjects, dealt so that the stages' shares stay even.

    Up to GREEDY_SUBJECTS come in the order of how uneven their own counts are (equal ones by a hash); each goes to the fold whose
    shares it then leaves most even, the one with fewer rows of equals. More of them are drawn into lots. In each lot subjects that are
    alike form rounds, a subject for each fold, and the lots' sums are dealt like rounds once more; only these reach the driver.
    """
    counts = df.groupBy(subject).pivot(stage).count().na.fill(0)
    names = [c for c in counts.columns if c != subject]
    rows = cut(counts.withColumn("_hash", F.xxhash64(F.col(subject), F.lit(seed))))
    if rows.count() <= GREEDY_SUBJECTS:
        return df.sparkSession.createDataFrame(_greedy(rows.collect(), names, subject, folds), rows.select(subject).schema.add("fold", IntegerType()))
    return _in_lots(rows, names, subject, folds)


def _in_lots(rows: DataFrame, names: Sequence[str], subject: str, folds: int) -> DataFrame:
    n, most = rows.count(), rows.agg(*[F.max(c) for c in names]).first()
    lots = -(-n // max(LOT, -(-n // LOTS)))
    scale = np.array([1, *most], float)  # what one subject has at most: itself, and its rows of each stage

    def deal(lot: pa.Table) -> pa.Table:
        counts = np.stack([lot[c].to_numpy() for c in names], axis=1)
        size, top = counts.sum(axis=1), counts.argmax(axis=1)
        order = np.lexsort((lot["_hash"].to_numpy(), -size, (10 * counts.max(axis=1) / size).round(), top))
        own = np.zeros((-(-len(order) // folds) * folds, len(scale)), np.int64)
        own[: len(order), 0], own[: len(order), 1:] = 1, counts[order]
        rounds = own.reshape(-1, folds, len(scale))
        parts = _even(rounds, scale)
        held = np.zeros(rounds.shape[1:], np.int64)
        np.add.at(held, parts.ravel(), own)
        first = [held.ravel().tolist(), *[None] * (len(order) - 1)]
        columns = [lot[subject].take(pa.array(order)), lot["_lot"], pa.array(parts.ravel()[: len(order)], pa.int32()), pa.array(first, pa.list_(pa.int64()))]
        return pa.table(columns, names=[subject, "_lot", "_part", "_held"])

    schema = rows.select(subject).schema.add("_lot", LongType()).add("_part", IntegerType()).add("_held", ArrayType(LongType()))
    dealt = cut(rows.withColumn("_lot", F.pmod("_hash", F.lit(lots))).groupBy("_lot").applyInArrow(deal, schema))
    sums = dealt.filter("_held IS NOT NULL").select("_lot", "_held").orderBy("_lot").collect()  # a row per lot
    placed = _even(np.array([r["_held"] for r in sums]).reshape(len(sums), folds, -1), scale)
    turns = rows.sparkSession.createDataFrame([(r["_lot"], p) for r, p in zip(sums, placed.tolist(), strict=True)], "_lot long, _turn array<int>")
    return dealt.join(F.broadcast(turns), "_lot").select(subject, F.col("_turn")[F.col("_part")].alias("fold"))


def _even(loads: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(load, part) -> fold, for loads of a part for each fold: one part to each, so that all columns' sums stay even over the folds.

    The most uneven come first. Two parts change places while that lessens the squares of what the folds are then apart, of which
    only the products of the parts with what is held depend on the choice.
    """
    apart = loads / scale
    apart -= apart.mean(axis=1, keepdims=True)
    folds = apart.shape[1]
    held, out = np.zeros(apart.shape[1:]), np.tile(np.arange(folds), (len(apart), 1))
    for i in np.argsort(-(apart**2).sum(axis=(1, 2)).round(9), kind="stable"):
        cost, to, moved = (apart[i] @ held.T).tolist(), out[i].tolist(), True
        while moved:
            moved = False
            for p in range(folds):
                for q in range(p):
                    if cost[p][to[q]] + cost[q][to[p]] < cost[p][to[p]] + cost[q][to[q]] - 1e-9:
                        to[p], to[q], moved = to[q], to[p], True
        out[i] = to
        held[to] += apart[i]
    return out


def _greedy(rows: Sequence, names: Sequence[str], subject: str, folds: int) -> list[tuple]:
    total = [sum(r[c] for r in rows) or 1 for c in names]
    spread = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)
    held = [[0] * len(names) for _ in range(folds)]
    out = []
    for r in sorted(rows, key=lambda r: (-spread([r[c] for c in names]), r["_hash"])):
        own = [r[c] for c in names]

        def cost(i: int, own=own) -> tuple:
            shares = [[(h + (own[j] if f == i else 0)) / total[j] for f, h in enumerate(x[j] for x in held)] for j in range(len(names))]
            return round(sum(spread(s) ** 0.5 for s in shares) / len(names), 12), sum(held[i]), i

        best = min(range(folds), key=cost)
        held[best] = [a + b for a, b in zip(held[best], own, strict=True)]
        out.append((r[subject], best))
    return out


def whole_subjects(dealt: DataFrame, subject: str, fold: str, named: int = 5) -> None:
    """Each subject lies in one fold; else this stops and names the first few that lie in several."""
    found = dealt.groupBy(subject).agg(F.count_distinct(fold).alias("_n")).filter("_n > 1").orderBy(subject).limit(named).collect()
    if found:
        raise ValueError("in several folds: " + ", ".join(str(r[subject]) for r in found))


def fit(train: DataFrame, columns: Sequence[str], model: str):
    """A fitted pipeline; classes are weighted alike. Missing values become zero, which is the middle of a normalised column."""
    if model not in NAMES:
        raise ValueError(f"unknown model {model}; known: {', '.join(sorted(NAMES))}")
    weights = balanced_weights(train, "stage").select("stage", "weight")  # a row per class
    weighted = train.na.fill(0.0, list(columns)).join(F.broadcast(weights), "stage")
    if model == "boosted":
        return boosting.fit(weighted, columns, "stage", CLASSES, weight="weight", **BOOSTED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw_features"), *MODELS[model]()]).fit(weighted)


def predict(fitted, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with proba (an array by class) and pred, the first most likely class."""
    out = fitted.transform(df.na.fill(0.0, list(columns))).withColumn("proba", vector_to_array("probability"))
    top = F.array_position("proba", F.array_max("proba")) - 1
    return out.select(*df.columns, "proba", top.cast("int").alias("pred"))


def cross_validate(
    df: DataFrame, columns: Sequence[str], fold: str, folds: Sequence[int], model: str = "ridge", select: str = "all", ranked_by: str = "forest"
) -> DataFrame:
    """Predictions of every row by the model of the other folds. One fit per fold; the rows are never collected.

    With a selection (selection.select_columns) the columns are chosen anew in each fold, from its training rows alone.
    """

    def gains(train: DataFrame, names: Sequence[str]) -> dict[str, float]:
        return dict(importance(fit(train, names, ranked_by), names))

    df, out = cut(df), None  # its windows are computed once, not for every fold
    for k in folds:
        train, test = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        own = list(columns) if select == "all" else select_columns(train, columns, select, gains)
        found = predict(fit(train, own, model), test, own)
        out = found if out is None else out.unionByName(found)
    return out


def delay_sweep(
    df: DataFrame, look_ahead: Mapping[str, int], fold: str, folds: Sequence[int], minutes: Sequence[float | None], fixed: float = 0.0, model: str = "ridge"
) -> DataFrame:
    """(minutes, n_columns, n, accuracy, macro_f1): cross-validated scores with the columns that each delay lets through.

    A delay of None lets all through and is null in the result. One that lets none through stops it.
    """
    out = None
    for m in minutes:
        names = within_budget(look_ahead, m, fixed)
        if not names:
            raise ValueError(f"no column fits a delay of {m} minutes")
        rated = scores(cross_validate(df, names, fold, folds, model), "stage", "pred").select("n", "accuracy", "macro_f1")
        found = rated.select(F.lit(m).cast("double").alias("minutes"), F.lit(len(names)).alias("n_columns"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def nested_decode(
    predicted: DataFrame, keys: Sequence[str], order: str, fold: str, folds: Sequence[int], weights: Sequence[float], lag: int | None = 0
) -> DataFrame:
    """predicted (stage, proba and fold a row) with `smoothed` and `weight`: each fold is decoded by the steps and at the
    weight that suit the other folds best."""
    predicted, out = cut(predicted), None
    for k in folds:
        others, own = predicted.filter(F.col(fold) != k), predicted.filter(F.col(fold) == k)
        cells = {(r["source"], r["target"]): r["log_prob"] for r in transitions(others, keys, order, "stage").collect()}  # a row per pair of classes
        table = [[cells[i, j] for j in range(CLASSES)] for i in range(CLASSES)]
        weight = best_weight(others, keys, order, "proba", "stage", table, weights).first()["weight"]
        states = decode(own, keys, order, "proba", table, weight, lag).withColumnRenamed("stage", "smoothed")
        found = own.join(states, [*keys, order]).withColumn("weight", F.lit(weight))
        out = found if out is None else out.unionByName(found)
    return out


def decoding_block(decoded: DataFrame, labels: DataFrame, keys: Sequence[str], order: str, fold: str) -> dict:
    """What a decoder needs beside a model: the weight that most folds chose in nested_decode (the smaller one of equals) and the log
    probabilities of steps in all labels."""
    chosen = decoded.select(fold, "weight").distinct().groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    weight = chosen.orderBy(F.desc("n"), "weight").first()  # a row per weight of the grid
    if weight is None:
        raise ValueError("no fold chose a weight")
    cells = {(r["source"], r["target"]): r["log_prob"] for r in transitions(labels, keys, order, "stage").collect()}  # a row per pair of classes
    return {"weight": weight["weight"], "log_prob": [[cells[i, j] for j in range(CLASSES)] for i in range(CLASSES)]}


def validation_subjects(df: DataFrame, subject: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """(subject, validates): a share of the subjects, one at least, drawn by hash; whole subjects go to either side."""
    drawn = df.select(subject).distinct().withColumn("_draw", F.xxhash64(F.col(subject).cast("string"), F.lit(seed)))
    n = max(1, round(drawn.count() * share))
    last = drawn.orderBy("_draw", subject).limit(n).agg(F.max("_draw")).first()[0]
    return drawn.select(subject, (F.col("_draw") <= F.lit(last)).alias("validates"))


def save(fitted: PipelineModel, path: str, columns: Sequence[str], look_ahead: Mapping[str, int], model: str, spark, **more) -> dict:
    """Write a fitted pipeline and its card: model, columns in order, the look-ahead of these columns alone, and what else is given."""
    if model not in NAMES:
        raise ValueError(f"unknown model {model}; known: {', '.join(sorted(NAMES))}")
    card = {"model": model, "columns": list(columns), "look_ahead": {c: look_ahead.get(c, 0) for c in columns}, "delay": max((look_ahead.get(c, 0) for c in columns), default=0), **more}
    if model == "boosted":
        write_note(spark, fitted.note(), f"{path}/model")
    else:
        fitted.write().overwrite().save(f"{path}/model")
    write_note(spark, card, f"{path}/card")
    return card


def load(path: str, spark) -> tuple[PipelineModel, dict]:
    """A saved pipeline and its card."""
    card = read_note(spark, f"{path}/card")
    if card.get("model") not in NAMES:
        raise ValueError(f"unknown model {card.get('model')}; known: {', '.join(sorted(NAMES))}")
    if card["model"] == "boosted":
        return boosting.Boosted.of(read_note(spark, f"{path}/model")), card
    return PipelineModel.load(f"{path}/model"), card


def importance(fitted, columns: Sequence[str]) -> list[tuple[str, float]]:
    """(column, importance), greatest first: of trees their gains, of a linear model the mean size of its coefficients."""
    if isinstance(fitted, boosting.Boosted):
        return sorted(((c, fitted.gains[c]) for c in columns), key=lambda x: (-x[1], x[0]))
    last = fitted.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    return sorted(zip(columns, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(W.orderBy(F.desc("n"), column))).filter("_r = 1").drop("_r")
