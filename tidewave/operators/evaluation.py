"""Class balance, weights, scores and transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLASSES = 4
SMOOTHING = 0.1


def class_ratios(df: DataFrame, fold: str, stage: str) -> DataFrame:
    """Each stage's share in each fold."""
    counts = df.groupBy(fold, stage).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy(fold)))


def ratio_spread(ratios: DataFrame, stage: str) -> DataFrame:
    """Over the folds: smallest and largest share and their difference."""
    per = ratios.groupBy(stage).agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    return per.withColumn("spread", F.col("high") - F.col("low"))


def balanced_weights(df: DataFrame, stage: str) -> DataFrame:
    """Per class: n and weight, n of all / (classes present * n), from counts; nothing but the counts is shuffled."""
    counts = df.groupBy(stage).agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(0))  # over the counts, a row per class
    return counts.select(stage, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def band(x: Column, edges: Sequence[float]) -> Column:
    """The number of the half-open band [edge, next edge); null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((x >= a) & (x < b), i).otherwise(out)
    return out


def band_weights(df: DataFrame, band_column: str) -> DataFrame:
    """Per band: n and a weight that gives each band that has rows the same total."""
    return balanced_weights(df.filter(F.col(band_column).isNotNull()), band_column)


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("c"))


def _scores(by: Sequence[str], classes: int) -> list[Column]:
    n = F.sum("c")
    hit, truth, pred = (
        [F.sum(F.when(cond(k), F.col("c")).otherwise(0)) for k in range(classes)]
        for cond in (
            lambda k: (F.col("t") == k) & (F.col("p") == k),
            lambda k: F.col("t") == k,
            lambda k: F.col("p") == k,
        )
    )
    f1 = [F.coalesce(F.try_divide(2.0 * h, t + p), F.lit(0.0)) for h, t, p in zip(hit, truth, pred, strict=True)]
    present = [F.when(t + p > 0, 1).otherwise(0) for t, p in zip(truth, pred, strict=True)]
    chance = sum((t * p for t, p in zip(truth, pred, strict=True)), F.lit(0)) / (n * n)
    accuracy = sum(hit, F.lit(0)) / n
    macro = sum(f1, F.lit(0.0)) / sum(present, F.lit(0))
    return [
        n.alias("n"), accuracy.alias("accuracy"), macro.alias("macro_f1"),
        F.try_divide(accuracy - chance, 1 - chance).alias("kappa"), *[f.alias(f"f1_{k}") for k, f in enumerate(f1)],
    ]


def scores(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), classes: int = CLASSES) -> DataFrame:
    """n, accuracy, macro_f1 (over the labels that occur), kappa and each class's F1, from confusion counts."""
    return confusion(df, truth, pred, by).groupBy(*by).agg(*_scores(by, classes))


def pooled_and_fold(df: DataFrame, truth: str, pred: str, fold: str, classes: int = CLASSES) -> DataFrame:
    """Scores of each fold, and of all rows where the fold is null; one pass over the rows."""
    counts = confusion(df, truth, pred, [fold])
    return counts.groupingSets([[F.col(fold)], []], fold).agg(*_scores([fold], classes))


def gain(before: DataFrame, after: DataFrame, on: str) -> DataFrame:
    """Per key the macro F1 before and after, and the gain in points."""
    a, b = before.select(on, F.col("macro_f1").alias("before")), after.select(on, F.col("macro_f1").alias("after"))
    return a.join(b, on).withColumn("gain_pp", (F.col("after") - F.col("before")) * 100)


def transitions(df: DataFrame, keys: Sequence[str], order: str, stage: str, classes: int = CLASSES) -> DataFrame:
    """(source, target, n, log_prob): steps from row to row within a recording, SMOOTHING added to every cell."""
    following = F.lead(stage).over(W.partitionBy(*keys).orderBy(order))
    steps = df.select(F.col(stage).cast("int").alias("source"), following.cast("int").alias("target")).filter("target is not null")
    counts = steps.groupBy("source", "target").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.range(classes * classes).select(
        (F.col("id") / classes).cast("int").alias("source"), (F.col("id") % classes).cast("int").alias("target")
    )
    full = grid.join(counts, ["source", "target"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = (F.col("n") + SMOOTHING) / F.sum(F.col("n") + SMOOTHING).over(W.partitionBy("source"))
    return full.withColumn("log_prob", F.ln(share))


def fold_summary(per_fold: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Over the folds: how many, mean, and standard deviation (of all, not of a sample)."""
    return per_fold.agg(F.count(score).alias("folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def fold_lists(per_fold: DataFrame, by: Sequence[str], fold: str, score: str, folds: int = 10) -> DataFrame:
    """(by, mean, scores): the scores in the order of folds, only where all folds are there, each once."""
    rows = F.sort_array(F.collect_list(F.struct(fold, score)))
    found = per_fold.groupBy(*by).agg(
        F.avg(score).alias("mean"), rows.alias("_rows"), F.count(F.lit(1)).alias("_n"), F.count_distinct(fold).alias("_folds")
    )
    return found.filter((F.col("_n") == folds) & (F.col("_folds") == folds)).select(*by, "mean", F.col(f"_rows.{score}").alias("scores"))


def versus(runs: DataFrame, name: str, setting: str, score: str, baseline: str | int) -> DataFrame:
    """runs with `gain`: the score over the baseline's in the same setting; null where the baseline wasn't run."""
    base = runs.filter(F.col(name) == baseline).groupBy(setting).agg(F.max(score).alias("_base"))
    return runs.join(base, setting, "left").withColumn("gain", F.col(score) - F.col("_base")).select(*runs.columns, "gain")


def signed_rank(differences: Sequence[float]) -> float:
    """The exact two-sided p of Wilcoxon's signed-rank test, zeros left out, equal sizes sharing their ranks; 1 if all are zero.

    For folds: the counts of all sign patterns are summed up rank by rank, in half ranks.
    """
    sizes = sorted(abs(d) for d in differences if d)
    if not sizes:
        return 1.0
    doubled = {x: sizes.index(x) * 2 + sizes.count(x) + 1 for x in set(sizes)}
    ranks = [(doubled[abs(d)], d > 0) for d in differences if d]
    ways = {0: 1}
    for r, _ in ranks:
        more = dict(ways)
        for total, n in ways.items():
            more[total + r] = more.get(total + r, 0) + n
        ways = more
    least = min(sum(r for r, up in ranks if up), sum(r for r, up in ranks if not up))
    return min(1.0, 2 * sum(n for total, n in ways.items() if total <= least) / 2 ** len(ranks))


def compared(gains: DataFrame) -> dict:
    """Of gain()'s rows, one a fold: folds, improved, mean gain in points and the signed-rank p."""
    own = [r["gain_pp"] for r in gains.select("gain_pp").collect()]
    return {"folds": len(own), "improved": sum(d > 0 for d in own), "gain_pp": sum(own) / max(len(own), 1), "p": signed_rank(own)}


def rescore(predicted: DataFrame, excluded: DataFrame, keys: Sequence[str], stage: str, columns: Sequence[str]) -> DataFrame:
    """(column, part, n, accuracy, macro_f1, gain_pp) of columns of predictions, those that the table lacks left out: before the
    excluded recordings go (`before`), without them (`after`) and on them alone (`excluded_only`). gain_pp is that of `after` over `before`, in points of macro-F1."""
    out = None
    marked = predicted.join(excluded.select(*keys).distinct().withColumn("_gone", F.lit(True)), list(keys), "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    parts = F.explode(F.array(F.lit("before"), F.when(F.col("_gone"), F.lit("excluded_only")).otherwise(F.lit("after")))).alias("part")
    every = marked.select("*", parts)
    for c in columns:
        if c not in predicted.columns:
            continue
        found = scores(every, stage, c, ["part"]).select(F.lit(c).alias("column"), "part", "n", "accuracy", "macro_f1")
        base = F.max(F.when(F.col("part") == "before", F.col("macro_f1"))).over(W.partitionBy("column"))
        found = found.withColumn("gain_pp", F.when(F.col("part") == "after", (F.col("macro_f1") - base) * 100))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"the predictions have none of the columns {', '.join(columns)}")
    return out
