"""The library's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import arrays as A
from tidewave.functions import windows as X
from tidewave.operators import decoding, evaluation, quality, selection, structure, tables

from .overlay import BANDS, EDGE, EPOCHS_SQL, KEYS, WARM_UP, epochs, kept, signals, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# A fixed table of log probabilities for the decoding queries.
STEPS = [[-0.2, -2.0, -3.0, -3.5], [-2.0, -0.4, -1.8, -2.2], [-3.0, -1.6, -0.4, -3.0], [-2.5, -1.9, -3.2, -0.4]]
WEIGHT = 0.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def R(sql: str, name: str) -> str:
    return f"round({sql}, 6) + 0.0 AS {name}"


# Structure


@query(EPOCHS_SQL + "SELECT user_id, event_id, epoch_idx, stage, pos FROM kept")
def label_map_drop(spark, d):
    return kept(spark, d).select("user_id", "event_id", "epoch_idx", "stage", "pos")


@query(EPOCHS_SQL + "SELECT event_type, count(*) AS n FROM epochs WHERE stage = -1 GROUP BY event_type")
def drop_reason_counts(spark, d):
    return structure.drop_counts(epochs(spark, d), "event_type")


@query(
    "WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), "
    "s AS (SELECT k, n, q, coalesce(sum(q) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM i) "
    "SELECT k, n, CAST(b + u AS BIGINT) AS epoch_idx FROM (SELECT k, n, b, unnest(range(CAST(q AS BIGINT))) AS u FROM s)"
)
def interval_expand(spark, d):
    i = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    i = i.withColumn("seconds", F.col("q") * 30.0)
    return structure.expand_intervals(i, ["k"], "n", "seconds").select("k", "n", F.col("epoch_idx").cast("long").alias("epoch_idx"))


@query(
    "SELECT vec_id, CAST(i AS BIGINT) AS epoch_idx, round(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE)), 6) + 0.0 AS total "
    "FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 8)) AS i FROM embeddings)"
)
def epoch_slices(spark, d):
    cut = structure.cut_epochs(signals(spark, d), "x", 8)
    return cut.select("vec_id", F.col("epoch_idx").cast("long").alias("epoch_idx"), r6(A.total(F.col("x"))).alias("total"))


_BOUNDS = (
    "bounds AS (SELECT user_id, count(*) AS n, min(CASE WHEN stage <> 0 THEN pos END) AS f, max(CASE WHEN stage <> 0 THEN pos END) AS l FROM kept GROUP BY user_id), "
    f"crop AS (SELECT user_id, n, CASE WHEN f IS NULL THEN 0 ELSE greatest(f - {EDGE}, 0) END AS lo, CASE WHEN f IS NULL THEN n ELSE least(n, l + {EDGE} + 1) END AS hi FROM bounds) "
)


@query(EPOCHS_SQL + ", " + _BOUNDS + "SELECT user_id, n, lo, hi FROM crop")
def crop_bounds(spark, d):
    return structure.crop_bounds(kept(spark, d), KEYS, EDGE)


@query(
    EPOCHS_SQL + ", " + _BOUNDS + "SELECT user_id, epoch_idx, pos, pos < lo AS warm FROM kept JOIN crop USING (user_id) "
    f"WHERE pos >= greatest(lo - {WARM_UP}, 0) AND pos < hi"
)
def crop_warmup_slice(spark, d):
    return structure.crop(kept(spark, d), KEYS, EDGE, WARM_UP).select("user_id", "epoch_idx", "pos", "warm")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def first_recordings(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(10).select("o_orderkey", "o_custkey")


# Windows

_NORM = "CASE WHEN q[3] - q[1] > 1e-12 THEN (value - q[2]) / (q[3] - q[1]) END"


@query(
    EPOCHS_SQL + ", w AS (SELECT *, quantile_cont(value, [0.05, 0.5, 0.95]) OVER w AS q, count(value) OVER w AS n FROM kept "
    "WINDOW w AS (PARTITION BY user_id ORDER BY epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    f"SELECT user_id, epoch_idx, {R(f'CASE WHEN n >= 20 THEN {_NORM} END', 'z')} FROM w"
)
def expanding_norm(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", r6(X.expanding_norm(F.col("value"), KEYS, "epoch_idx")).alias("z"))


@query(SQL["expanding_norm"])
def expanding_norm_wide(spark, d):
    wide = X.normalise_wide(kept(spark, d).select("user_id", "epoch_idx", "value"), KEYS, "epoch_idx", ["value"])
    return wide.select("user_id", "epoch_idx", r6(F.col("value_norm")).alias("z"))


@query(
    EPOCHS_SQL + ", w AS (SELECT *, quantile_cont(value, [0.05, 0.5, 0.95]) OVER (PARTITION BY user_id) AS q FROM kept) "
    f"SELECT user_id, epoch_idx, {R(_NORM, 'z')} FROM w"
)
def posthoc_norm(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", r6(X.posthoc_norm(F.col("value"), KEYS)).alias("z"))


@query(
    EPOCHS_SQL + "SELECT a.user_id, a.epoch_idx, "
    "round(sum(b.value * (1 - abs(b.pos - a.pos) / 8.0)) / sum(1 - abs(b.pos - a.pos) / 8.0), 9) AS m FROM kept a JOIN kept b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos - 7 AND a.pos + 7 GROUP BY 1, 2"
)
def centered_triangular_mean(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", F.round(X.triangular_mean(F.col("value"), KEYS, "pos"), 9).alias("m"))


@query(
    EPOCHS_SQL + "SELECT user_id, epoch_idx, "
    + R("avg(value) OVER (PARTITION BY user_id ORDER BY epoch_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "m") + " FROM kept"
)
def trailing_mean(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", r6(X.trailing_mean(F.col("value"), KEYS, "epoch_idx")).alias("m"))


_SHIFTS = (-2, -1, 1, 2)
_NAMES = {-2: "back_2", -1: "back_1", 1: "ahead_1", 2: "ahead_2"}


@query(
    EPOCHS_SQL + "SELECT user_id, epoch_idx, "
    + ", ".join(
        f"CASE WHEN lead(epoch_idx, {k}) OVER w = epoch_idx + ({k}) THEN round(lead(value, {k}) OVER w, 6) + 0.0 END AS {_NAMES[k]}" for k in _SHIFTS
    )
    + " FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY epoch_idx)"
)
def gap_aware_shift(spark, d):
    shifted = [r6(X.gap_shift(F.col("value"), KEYS, "epoch_idx", k)).alias(_NAMES[k]) for k in _SHIFTS]
    return kept(spark, d).select("user_id", "epoch_idx", *shifted)


@query(
    EPOCHS_SQL + "SELECT user_id, epoch_idx, "
    + R("(epoch_idx - min(epoch_idx) OVER (PARTITION BY user_id)) * 30.0 / 3600", "hours") + " FROM kept"
)
def elapsed_hours(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", r6(X.elapsed_hours(KEYS, "epoch_idx")).alias("hours"))


@query(
    EPOCHS_SQL + ", s AS (SELECT pos, CASE WHEN lead(epoch_idx) OVER w = epoch_idx + 1 THEN lead(value) OVER w END AS a, "
    "CASE WHEN lag(epoch_idx, 2) OVER w = epoch_idx - 2 THEN lag(value, 2) OVER w END AS b FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY epoch_idx)) "
    "SELECT CAST(sum((a IS NULL OR b IS NULL)::INT) AS BIGINT) AS rows_missing, "
    "CAST(sum((a IS NULL OR b IS NULL)::INT * (pos >= 20)::INT) AS BIGINT) AS rows_missing_kept, "
    + R("sum((a IS NULL OR b IS NULL)::INT * (pos >= 20)::INT) / CAST(sum((pos >= 20)::INT) AS DOUBLE)", "ratio") + " FROM s"
)
def missing_report(spark, d):
    s = kept(spark, d).select(
        "pos", X.gap_shift(F.col("value"), KEYS, "epoch_idx", 1).alias("a"), X.gap_shift(F.col("value"), KEYS, "epoch_idx", -2).alias("b")
    )
    return structure.missing_report(s, ["a", "b"], F.col("pos") >= 20).withColumn("ratio", r6(F.col("ratio")))


@query(
    EPOCHS_SQL + ", c AS (SELECT user_id, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) >= 15), "
    "s AS (SELECT DISTINCT user_id, n, unnest(list_append(range(0, n - 15 + 1, 5), n - 15)) AS start FROM c), "
    "o AS (SELECT *, lag(start) OVER (PARTITION BY user_id ORDER BY start) AS prev FROM s), "
    "m AS (SELECT *, unnest(range(start, start + 15)) AS pos FROM o) "
    "SELECT user_id, start, pos, pos >= (CASE WHEN prev IS NULL THEN 0 ELSE prev + 10 END) AND pos < (CASE WHEN start = n - 15 THEN n ELSE start + 10 END) AS scored FROM m"
)
def sequence_windows_scored_once(spark, d):
    return structure.sequence_windows(kept(spark, d), KEYS, 15, 5)


@query(
    EPOCHS_SQL + "SELECT user_id, epoch_idx, "
    + R("quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "m") + " FROM kept"
)
def expanding_median(spark, d):
    return kept(spark, d).select("user_id", "epoch_idx", r6(X.expanding_median(F.col("value"), KEYS, "epoch_idx")).alias("m"))


# Signals: x is the embedding; lists in SQL.

_X = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), " \
     "c AS (SELECT vec_id, x, list_avg(x) AS m, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS d FROM s), " \
     "e AS (SELECT *, list_transform(range(1, len(d)), lambda i: d[i + 1] - d[i]) AS dd FROM c) "
_VAR = lambda a: f"list_avg(list_transform({a}, lambda v: (v - list_avg({a})) ^ 2))"
_M = lambda k: f"list_avg(list_transform(x, lambda v: (v - m) ^ {k}))"


@query(
    _X + "SELECT vec_id, "
    + ", ".join([
        R(f"sqrt({_M(2)})", "std"),
        R("list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25)", "iqr"),
        R(f"{_M(3)} / {_M(2)} ^ 1.5", "skew"),
        R(f"{_M(4)} / {_M(2)} ^ 2 - 3", "kurt"),
        "CAST(list_sum(list_transform(range(1, len(x)), lambda i: ((x[i] < 0) <> (x[i + 1] < 0))::INT)) AS INTEGER) AS nzc",
    ]) + " FROM e"
)
def signal_stats(spark, d):
    found = signals(spark, d).select("vec_id", A.statistics(F.col("x")).alias("s")).select("vec_id", "s.*")
    return _rounded(found)


@query(
    _X + f"SELECT vec_id, {R(f'sqrt({_VAR("d")} / {_VAR("x")})', 'mobility')}, "
    + R(f"sqrt({_VAR('dd')} / {_VAR('d')}) / sqrt({_VAR('d')} / {_VAR('x')})", "complexity") + " FROM e"
)
def hjorth(spark, d):
    return _rounded(signals(spark, d).select("vec_id", A.hjorth(F.col("x")).alias("h")).select("vec_id", "h.*"))


@query(
    _X + ", w AS (SELECT vec_id, x, d, list_transform(range(8), lambda i: x[i * 8 + 1 : i * 8 + 8]) AS ws FROM e) SELECT vec_id, "
    + R("list_sum(list_transform(ws, lambda w: sqrt((list_max(w) - list_min(w)) ^ 2 + (list_position(w, list_max(w)) - list_position(w, list_min(w))) ^ 2)))", "mmd")
    + ", " + R("list_sum(list_transform(x, lambda v: v * v)) * list_sum(list_transform(d, lambda v: v * v))", "esis") + " FROM w"
)
def distance_energy(spark, d):
    x = F.col("x")
    return signals(spark, d).select("vec_id", r6(A.max_min_distance(x, 8)).alias("mmd"), r6(A.energy_product(x)).alias("esis"))


@query(
    _X + ", n AS (SELECT vec_id, CAST(len(x) AS DOUBLE) AS n, list_sum(list_transform(range(1, len(d)), lambda i: ((d[i] < 0) <> (d[i + 1] < 0))::INT)) AS c FROM e) SELECT vec_id, "
    + R("log10(n) / (log10(n) + log10(n / (n + c * 0.4)))", "petrosian") + " FROM n"
)
def petrosian_dimension(spark, d):
    return signals(spark, d).select("vec_id", r6(A.petrosian(F.col("x"))).alias("petrosian"))


@query(
    _X + f"SELECT vec_id, {R('list_max(x) - list_min(x)', 'ptp')}, {R(f'sqrt({_VAR("x")})', 'std')}, "
    + R("list_avg(list_transform(d, lambda v: (v = 0)::INT::DOUBLE))", "flat_ratio") + " FROM e"
)
def epoch_quality(spark, d):
    return _rounded(signals(spark, d).select("vec_id", A.quality(F.col("x")).alias("q")).select("vec_id", "q.*"))


_FREQS = "list_transform(range(64), lambda i: i * 0.5)"
_BAND = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (i - 1) * 0.5 >= {a} AND (i - 1) * 0.5 < {b} THEN x[i] * x[i] ELSE 0 END)) * 0.5"
# Fixed bands in Hz.
BANDS_HZ = {"sdelta": (0.4, 1.0), "fdelta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0)}


@query(
    _X + "SELECT vec_id, " + R(_BAND(0.4, 30.0), "abspow") + ", "
    + ", ".join(R(f"({_BAND(a, b)}) / ({_BAND(0.4, 30.0)})", n) for n, (a, b) in BANDS_HZ.items()) + " FROM e"
)
def band_power_from_psd(spark, d):
    x = signals(spark, d).select("vec_id", F.transform("x", lambda v: v * v).alias("psd"))
    freqs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(0.5).cast("double"))
    whole = A.band_power(freqs, F.col("psd"), 0.4, 30.0)
    parts = [r6(F.try_divide(A.band_power(freqs, F.col("psd"), a, b), whole)).alias(n) for n, (a, b) in BANDS_HZ.items()]
    return x.select("vec_id", r6(whole).alias("abspow"), *parts)


@query(
    "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b FROM embeddings) "
    f"SELECT vec_id, {R('corr(a, b)', 'r')} FROM u GROUP BY vec_id"
)
def channel_correlation(spark, d):
    return signals(spark, d).select("vec_id", r6(A.correlation(F.col("x"), F.reverse("x"))).alias("r"))


_ISLANDS = (
    "i AS (SELECT user_id, above, pos - row_number() OVER (PARTITION BY user_id, above ORDER BY pos) AS g FROM f), "
    "r AS (SELECT user_id, count(*) AS n FROM i WHERE above GROUP BY user_id, g), "
    "c AS (SELECT user_id, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS run_rows FROM r WHERE n BETWEEN 2 AND 6 GROUP BY user_id) "
    "SELECT u.user_id, coalesce(n_runs, 0) AS n_runs, coalesce(run_rows, 0) AS run_rows FROM (SELECT DISTINCT user_id FROM f) u LEFT JOIN c USING (user_id)"
)


@query(EPOCHS_SQL + ", f AS (SELECT user_id, pos, value > 50 AS above FROM kept), " + _ISLANDS)
def run_islands(spark, d):
    return structure.count_runs(kept(spark, d), KEYS, "pos", F.col("value") > 50, 2, 6)


@query(
    EPOCHS_SQL + ", b AS (SELECT user_id, b, (SELECT quantile_cont(value, 0.92) FROM kept k WHERE k.user_id = p.user_id AND k.pos <= greatest(20 * p.b - 1, 0)) AS t "
    "FROM (SELECT DISTINCT user_id, (pos + 1) // 20 AS b FROM kept) p), "
    "f AS (SELECT k.user_id, k.pos, k.value > b.t AS above FROM kept k JOIN b ON k.user_id = b.user_id AND (k.pos + 1) // 20 = b.b), "
    + _ISLANDS.replace("BETWEEN 2 AND 6", "BETWEEN 1 AND 6")
)
def adaptive_threshold_runs(spark, d):
    from pyspark.sql import Window as W

    rows = kept(spark, d).withColumn("block", F.floor((F.col("pos") + 1) / 20))
    so_far = W.partitionBy(*KEYS).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.when((F.col("pos") == 0) | ((F.col("pos") + 1) % 20 == 0), F.percentile("value", F.lit(0.92)).over(so_far))
    held = F.last(at, ignorenulls=True).over(so_far)
    return structure.count_runs(rows.withColumn("t", held), KEYS, "pos", F.col("value") > F.col("t"), 1, 6)


# Quality, joins, sets

_FLAT = "f AS (SELECT user_id, event_type, count(*) AS n_epochs, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) AS flat_fraction FROM kept GROUP BY 1, 2)"
_VERDICT = (
    ", v AS (SELECT user_id, bool_or(flat_fraction > 0.4) AS excluded, coalesce(string_agg(CASE WHEN flat_fraction > 0.4 THEN event_type END, ',' ORDER BY event_type), '') AS bad_channels, "
    "max(flat_fraction) AS worst FROM f GROUP BY user_id) "
)


def _fractions(spark, d):
    return quality.flat_fraction(kept(spark, d), KEYS, "event_type", "value")


def _verdicts(spark, d):
    return quality.verdict(_fractions(spark, d), KEYS, "event_type", 0.4)


@query(EPOCHS_SQL + ", " + _FLAT + f" SELECT user_id, event_type, n_epochs, {R('flat_fraction', 'flat_fraction')} FROM f")
def flat_fraction(spark, d):
    return _fractions(spark, d).withColumn("flat_fraction", r6(F.col("flat_fraction")))


@query(EPOCHS_SQL + ", " + _FLAT + _VERDICT + f"SELECT user_id, excluded, bad_channels, {R('worst', 'worst')} FROM v")
def recording_verdict(spark, d):
    return _verdicts(spark, d).withColumn("worst", r6(F.col("worst")))


@query(EPOCHS_SQL + ", " + _FLAT + _VERDICT + f"SELECT user_id, {R('worst', 'worst')} FROM v ORDER BY v.worst DESC, user_id LIMIT 12")
def worst_recordings(spark, d):
    return quality.worst(_verdicts(spark, d), KEYS).select("user_id", r6(F.col("worst")).alias("worst"))


@query(EPOCHS_SQL + ", " + _FLAT + _VERDICT + "SELECT user_id, epoch_idx, stage FROM kept WHERE user_id NOT IN (SELECT user_id FROM v WHERE excluded)")
def exclude_anti(spark, d):
    bad = _verdicts(spark, d).filter("excluded")
    return tables.exclude(kept(spark, d), bad, KEYS).select("user_id", "epoch_idx", "stage")


@query(EPOCHS_SQL + ", " + _FLAT + _VERDICT + "SELECT user_id, epoch_idx, stage FROM kept WHERE user_id IN (SELECT user_id FROM v WHERE excluded)")
def excluded_semi(spark, d):
    bad = _verdicts(spark, d).filter("excluded")
    return tables.only(kept(spark, d), bad, KEYS).select("user_id", "epoch_idx", "stage")


@query(
    EPOCHS_SQL + "SELECT user_id, epoch_idx, c_nationkey, " + R("c_acctbal", "c_acctbal") + " FROM kept LEFT JOIN customer ON c_custkey = user_id"
)
def subject_join(spark, d):
    info = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_acctbal")
    found = tables.attach(kept(spark, d).select("user_id", "epoch_idx"), info, KEYS, ["c_nationkey", "c_acctbal"])
    return found.withColumn("c_acctbal", r6(F.col("c_acctbal")))


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 3000 THEN 1 WHEN c_acctbal < 6000 THEN 2 ELSE 3 END AS band FROM customer"
)
def subject_bands(spark, d):
    return table(spark, d, "customer").select("c_custkey", evaluation.band(F.col("c_acctbal"), BANDS).alias("band"))


_FILES = "f AS (SELECT format('SC4{:09d}E0-PSG', o_orderkey) AS name FROM orders UNION ALL SELECT format('SC4{:09d}EC-Hypnogram', o_orderkey) FROM orders WHERE o_orderstatus <> 'P') "


@query(
    "WITH " + _FILES + ", h AS (SELECT substr(name, 1, 12) AS stem, count(*) AS n, min(name) AS label_name FROM f WHERE contains(name, '-Hypnogram') GROUP BY 1) "
    "SELECT regexp_replace(name, '^(S[CT][0-9]{3})([0-9]).*$', '\\1N\\2') AS key, name AS signal_name, label_name, coalesce(n, 0) AS n_labels, coalesce(n, 0) = 1 AS paired "
    "FROM f LEFT JOIN h ON substr(name, 1, 12) = stem WHERE contains(name, '-PSG')"
)
def pairing_check(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.format_string("SC4%09d", "o_orderkey").alias("stem"))
    names = o.select(F.concat("stem", F.lit("E0-PSG")).alias("name")).unionAll(
        o.filter("o_orderstatus <> 'P'").select(F.concat("stem", F.lit("EC-Hypnogram")).alias("name"))
    )
    return tables.pair_files(names, stem=12)


@query(EPOCHS_SQL + "SELECT DISTINCT user_id FROM kept WHERE stage = 3 INTERSECT SELECT DISTINCT user_id FROM kept WHERE value > 150")
def fold_overlap_check(spark, d):
    rows = kept(spark, d)
    return tables.overlap(rows.filter("stage = 3").select("user_id"), rows.filter("value > 150").select("user_id"))


@query("SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def subject_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "events").select("user_id"))


@query(
    EPOCHS_SQL + ", a AS (SELECT user_id, epoch_idx, value FROM epochs), o AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS epoch_idx, o_orderkey FROM orders) "
    "SELECT user_id, epoch_idx, o_orderkey FROM a JOIN o USING (user_id, epoch_idx)"
)
def length_alignment(spark, d):
    from pyspark.sql import Window as W

    number = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), number.alias("epoch_idx"), "o_orderkey")
    return structure.align_lengths(epochs(spark, d).select("user_id", "epoch_idx"), orders, KEYS)


@query(
    EPOCHS_SQL + ", s AS (SELECT user_id, epoch_idx, CASE WHEN lead(epoch_idx) OVER w = epoch_idx + 1 THEN lead(value) OVER w END AS a FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY epoch_idx)) "
    f"SELECT user_id, epoch_idx, {R('a', 'a')} FROM s WHERE a IS NOT NULL"
)
def complete_rows(spark, d):
    s = kept(spark, d).select("user_id", "epoch_idx", X.gap_shift(F.col("value"), KEYS, "epoch_idx", 1).alias("a"))
    return _rounded(structure.complete_rows(s, ["a"]))


# Evaluation

_FOLD = "f AS (SELECT *, user_id % 10 AS fold, lag(stage) OVER (PARTITION BY user_id ORDER BY epoch_idx) AS pred FROM kept)"


def _predicted(spark, d):
    from pyspark.sql import Window as W

    before = F.lag("stage").over(W.partitionBy(*KEYS).orderBy("epoch_idx"))
    return kept(spark, d).withColumn("fold", F.col("user_id") % 10).withColumn("pred", before).filter("pred is not null")


@query(
    EPOCHS_SQL + ", " + _FOLD + ", r AS (SELECT fold, stage, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fold) AS DOUBLE) AS ratio FROM f GROUP BY 1, 2) "
    f"SELECT stage, {R('min(ratio)', 'low')}, {R('max(ratio)', 'high')}, {R('max(ratio) - min(ratio)', 'spread')} FROM r GROUP BY stage"
)
def fold_class_balance(spark, d):
    ratios = evaluation.class_ratios(kept(spark, d).withColumn("fold", F.col("user_id") % 10), "fold", "stage")
    return evaluation.ratio_spread(ratios, "stage").select("stage", *[r6(F.col(c)).alias(c) for c in ("low", "high", "spread")])


@query(
    EPOCHS_SQL + ", p AS (SELECT stage AS source, lead(stage) OVER (PARTITION BY user_id ORDER BY epoch_idx) AS target FROM kept), "
    "g AS (SELECT a.s AS source, b.s AS target FROM (SELECT unnest(range(4)) AS s) a, (SELECT unnest(range(4)) AS s) b), "
    "c AS (SELECT CAST(g.source AS INTEGER) AS source, CAST(g.target AS INTEGER) AS target, count(p.source) AS n FROM g LEFT JOIN p ON p.source = g.source AND p.target = g.target GROUP BY 1, 2) "
    f"SELECT source, target, n, {R('ln((n + 0.1) / sum(n + 0.1) OVER (PARTITION BY source))', 'log_prob')} FROM c"
)
def transition_logprob(spark, d):
    found = evaluation.transitions(kept(spark, d), KEYS, "epoch_idx", "stage")
    return found.withColumn("log_prob", r6(F.col("log_prob")))


@query(
    EPOCHS_SQL + f"SELECT stage, count(*) AS n, {R('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))', 'weight')} FROM kept GROUP BY stage"
)
def balanced_weights(spark, d):
    return evaluation.balanced_weights(kept(spark, d), "stage").withColumn("weight", r6(F.col("weight")))


@query(
    "WITH b AS (SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 3000 THEN 1 WHEN c_acctbal < 6000 THEN 2 ELSE 3 END AS band FROM customer) "
    f"SELECT band, count(*) AS n, {R('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))', 'weight')} FROM b GROUP BY band"
)
def band_weights(spark, d):
    return evaluation.band_weights(subject_bands(spark, d), "band").withColumn("weight", r6(F.col("weight")))


def _scores_sql(source: str, group: str = "", select: str = "") -> str:
    hit = lambda k: f"sum((stage = {k} AND pred = {k})::INT)"
    t, p = (lambda k: f"sum((stage = {k})::INT)"), (lambda k: f"sum((pred = {k})::INT)")
    f1 = [f"CASE WHEN {t(k)} + {p(k)} = 0 THEN 0.0 ELSE 2.0 * {hit(k)} / ({t(k)} + {p(k)}) END" for k in range(4)]
    present = " + ".join(f"({t(k)} + {p(k)} > 0)::INT" for k in range(4))
    acc = "sum((stage = pred)::INT) / CAST(count(*) AS DOUBLE)"
    chance = "(" + " + ".join(f"CAST({t(k)} AS DOUBLE) * {p(k)}" for k in range(4)) + ") / (CAST(count(*) AS DOUBLE) * count(*))"
    columns = [
        "count(*) AS n", R(acc, "accuracy"), R(f"({' + '.join(f1)}) / ({present})", "macro_f1"),
        R(f"({acc} - {chance}) / (1 - {chance})", "kappa"), *(R(f, f"f1_{k}") for k, f in enumerate(f1)),
    ]
    return f"SELECT {select}{', '.join(columns)} FROM {source}{group}"


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(EPOCHS_SQL + ", " + _FOLD + _scores_sql("f", " WHERE pred IS NOT NULL GROUP BY GROUPING SETS ((fold), ())", "fold, "))
def metrics_pooled_and_fold(spark, d):
    return _rounded(evaluation.pooled_and_fold(_predicted(spark, d), "stage", "pred", "fold"))


@query(
    EPOCHS_SQL + ", " + _FOLD + ", b AS (" + _scores_sql("f", " WHERE pred IS NOT NULL GROUP BY fold", "fold, ").replace("round(", "(").replace(", 6) + 0.0", ")")
    + f") SELECT count(*) AS folds, {R('avg(macro_f1)', 'mean')}, {R('stddev_pop(macro_f1)', 'std')} FROM b"
)
def fold_summary(spark, d):
    return _rounded(evaluation.fold_summary(evaluation.scores(_predicted(spark, d), "stage", "pred", ["fold"])))


@query(EPOCHS_SQL + ", " + _FOLD + "SELECT user_id, kappa FROM (" + _scores_sql("f", " WHERE pred IS NOT NULL GROUP BY user_id", "user_id, ") + ")")
def kappa(spark, d):
    return _rounded(evaluation.scores(_predicted(spark, d), "stage", "pred", KEYS)).select("user_id", "kappa")


@query(
    EPOCHS_SQL + ", " + _FOLD + ", " + _FLAT.replace("f AS", "ff AS") + _VERDICT.replace("FROM f ", "FROM ff ")
    + ", b AS (" + _scores_sql("f", " WHERE pred IS NOT NULL GROUP BY fold", "fold, ").replace("round(", "(").replace(", 6) + 0.0", ")") + "), a AS ("
    + _scores_sql("f", " WHERE pred IS NOT NULL AND user_id NOT IN (SELECT user_id FROM v WHERE excluded) GROUP BY fold", "fold, ").replace("round(", "(").replace(", 6) + 0.0", ")")
    + f") SELECT fold, {R('b.macro_f1', 'before')}, {R('a.macro_f1', 'after')}, {R('(a.macro_f1 - b.macro_f1) * 100', 'gain_pp')} FROM b JOIN a USING (fold)"
)
def rescore_gain(spark, d):
    rows = _predicted(spark, d)
    bad = _verdicts(spark, d).filter("excluded")
    before = evaluation.scores(rows, "stage", "pred", ["fold"])
    after = evaluation.scores(tables.exclude(rows, bad, KEYS), "stage", "pred", ["fold"])
    return _rounded(evaluation.gain(before, after, "fold"))


_RESCORED = _scores_sql("p", " GROUP BY part", "part, ").replace("round(", "(").replace(", 6) + 0.0", ")")


@query(
    EPOCHS_SQL + ", " + _FOLD + ", " + _FLAT.replace("f AS", "ff AS") + _VERDICT.replace("FROM f ", "FROM ff ")
    + ", m AS (SELECT stage, pred, user_id IN (SELECT user_id FROM v WHERE excluded) AS gone FROM f WHERE pred IS NOT NULL), "
    "p AS (SELECT stage, pred, 'before' AS part FROM m UNION ALL SELECT stage, pred, CASE WHEN gone THEN 'excluded_only' ELSE 'after' END FROM m), "
    f"s AS ({_RESCORED}) SELECT 'pred' AS \"column\", part, n, {R('accuracy', 'accuracy')}, {R('macro_f1', 'macro_f1')}, "
    + R("CASE WHEN part = 'after' THEN (macro_f1 - (SELECT macro_f1 FROM s WHERE part = 'before')) * 100 END", "gain_pp") + " FROM s"
)
def rescore_parts(spark, d):
    """Scores before, after and on the excluded alone; the smoothed column isn't there and is left out."""
    bad = _verdicts(spark, d).filter("excluded")
    return _rounded(evaluation.rescore(_predicted(spark, d), bad, KEYS, "stage", ["pred", "smoothed"]))


@query(
    EPOCHS_SQL + ", b AS (SELECT user_id, event_type, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) > 0.4 AS bad FROM kept GROUP BY 1, 2) "
    "SELECT user_id, bool_or(bad) AS excluded, coalesce(string_agg(CASE WHEN bad THEN 'flat:' || event_type END, ',' ORDER BY event_type), '') AS reasons FROM b GROUP BY user_id"
)
def named_checks(spark, d):
    return quality.assess(kept(spark, d), KEYS, "event_type", "value", ["flat"], 20.0, 0.4)


_COLUMNS = {"a": 0, "a_p2min": 0, "a_c7min": 7, "a_ep+1": 1, "a_ep+2": 2, "a_norm": 0, "a_posthoc": 2**31 - 1}


@query(
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k})" for n, k in _COLUMNS.items()) + ") t(name, lookahead)), "
    "b AS (SELECT * FROM (VALUES (0.0), (0.5), (1.0), (3.5)) t(minutes)) SELECT CAST(minutes AS DOUBLE) AS minutes, name, lookahead FROM c, b WHERE lookahead * 0.5 <= minutes"
)
def lookahead_budget(spark, d):
    columns = spark.createDataFrame([(n, X.look_ahead(n)) for n in _COLUMNS], "name string, lookahead int")
    budgets = F.explode(F.array(*[F.lit(m) for m in (0.0, 0.5, 1.0, 3.5)]))
    every = columns.select(budgets.alias("minutes"), "name", "lookahead")
    return selection.budget_filter(every, F.col("minutes"))


# Decoding

_PROBA = "[0.1 + value / 100, 0.2 + k / 100, 0.3 + CASE stage WHEN 2 THEN 1.0 ELSE 0.0 END, 0.25 + CASE stage WHEN 3 THEN 1.0 ELSE 0.0 END]"


def _proba(spark, d):
    is_ = lambda s: F.when(F.col("stage") == s, 1.0).otherwise(0.0)
    raw = F.array(0.1 + F.col("value") / 100, 0.2 + F.col("k") / 100, 0.3 + is_(2), 0.25 + is_(3))
    return kept(spark, d).select("user_id", "pos", "stage", raw.alias("raw")).withColumn(
        "proba", F.transform("raw", lambda p: p / A.total(F.col("raw")))
    )


def _forward_sql(weight: str) -> str:
    lse = lambda j: "ln(" + " + ".join(f"exp(alpha[{i + 1}] + {weight} * ({STEPS[i][j]}) - list_max(alpha))" for i in range(4)) + ") + list_max(alpha)"
    return (
        EPOCHS_SQL.replace("WITH epochs", "WITH RECURSIVE epochs")
        + f", r AS (SELECT user_id, pos, {_PROBA} AS raw FROM kept), "
        "e AS (SELECT user_id, pos, list_transform(raw, lambda p: ln(greatest(p / list_sum(raw), 1e-12))) AS e FROM r), "
        "a AS (SELECT user_id, pos, e AS alpha FROM e WHERE pos = 0 UNION ALL SELECT e.user_id, e.pos, "
        "[" + ", ".join(f"e.e[{j + 1}] + {lse(j)}" for j in range(4)) + "] FROM a JOIN e ON e.user_id = a.user_id AND e.pos = a.pos + 1) "
    )


@query(_forward_sql(str(WEIGHT)) + "SELECT user_id, pos, CAST(list_position(alpha, list_max(alpha)) - 1 AS INTEGER) AS stage FROM a")
def forward_decode(spark, d):
    return decoding.forward(_proba(spark, d), KEYS, "pos", "proba", STEPS, WEIGHT)


@query(SQL["forward_decode"])
def forward_decode_kernel(spark, d):
    return decoding.decode(_proba(spark, d), KEYS, "pos", "proba", STEPS, WEIGHT, 0)


_GRID = (0.0, 0.1, 0.3, 1.0)


@query(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"(SELECT CAST({w} AS DOUBLE) AS weight, n, accuracy, macro_f1 FROM (" + _forward_sql(str(w))
        + ", f AS (SELECT k.stage, CAST(list_position(alpha, list_max(alpha)) - 1 AS INTEGER) AS pred FROM a JOIN kept k USING (user_id, pos)) "
        + _scores_sql("f") + "))" for w in _GRID
    ) + ")"
)
def decode_weight_grid(spark, d):
    rows = _proba(spark, d)
    found = decoding.decode_grid(rows, KEYS, "pos", "proba", STEPS, _GRID).withColumnRenamed("stage", "pred")
    rated = evaluation.scores(found.join(rows.select("user_id", "pos", "stage"), ["user_id", "pos"]), "stage", "pred", ["weight"])
    return _rounded(rated.select("weight", "n", "accuracy", "macro_f1"))


@query()
def fixed_lag_decode(spark, d):
    return decoding.decode(_proba(spark, d), KEYS, "pos", "proba", STEPS, WEIGHT, 7)


@query()
def smoothed_decode(spark, d):
    return decoding.decode(_proba(spark, d), KEYS, "pos", "proba", STEPS, WEIGHT, None)


# Batch against stream, sinks


@query(
    EPOCHS_SQL + ", s AS (SELECT user_id, pos, CASE WHEN k < 10 THEN 0 ELSE stage END AS other FROM kept WHERE value < 150) "
    "SELECT CAST(sum((stage = other)::INT) AS BIGINT) AS matched, CAST(count(*) - sum((stage = other)::INT) AS BIGINT) AS mismatched, "
    + R("sum((stage = other)::INT) / CAST(count(*) AS DOUBLE)", "agreement") + " FROM kept JOIN s USING (user_id, pos)"
)
def batch_stream_agreement(spark, d):
    rows = kept(spark, d)
    stream = rows.filter("value < 150").select("user_id", "pos", F.when(F.col("k") < 10, 0).otherwise(F.col("stage")).alias("stage"))
    return _rounded(tables.agreement(rows.select("user_id", "pos", "stage"), stream, KEYS, "pos", "stage"))


@query(
    "SELECT user_id, event_type, event_id, " + R("value", "value")
    + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
)
def prediction_upsert(spark, d):
    last = tables.keep_last(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return last.select("user_id", "event_type", "event_id", r6(F.col("value")).alias("value"))


@query("SELECT round(avg(value), 2) AS mean, round(quantile_cont(value, 0.95), 2) AS p95, round(max(value), 2) AS max FROM events")
def latency_stats(spark, d):
    return tables.latency(table(spark, d, "events"), "value")


# Selection

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS idx, stddev_pop({c}) / avg({c}) AS gain FROM lineitem" for i, c in enumerate(_NUMBERS))
    + f"), r AS (SELECT *, row_number() OVER (ORDER BY gain DESC, idx) AS rank FROM v) SELECT name, idx, {R('gain', 'gain')}, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"
)
def feature_rank_topk(spark, d):
    gains = table(spark, d, "lineitem").agg(*[(F.stddev_pop(c) / F.avg(c)).alias(c) for c in _NUMBERS])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("idx"), F.col(c).alias("gain")) for i, c in enumerate(_NUMBERS)])
    rows = gains.select(F.explode(rows).alias("_g")).select("_g.*")
    return _rounded(selection.top_by(rows, "gain", "idx", 3))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {R(f'abs(corr({a}, {b}))', 'r')} FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]
    )
)
def corr_pairs(spark, d):
    return _rounded(selection.correlations(table(spark, d, "lineitem"), _NUMBERS))


@query(
    "WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
    f"SELECT 'x' || a.i AS a, 'x' || b.i AS b, {R('abs(corr(a.x, b.x))', 'r')} FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i"
)
def corr_wide(spark, d):
    """All pairs of the embeddings' 64 columns."""
    wide = signals(spark, d).select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(64)])
    return _rounded(selection.correlations(wide, wide.columns))


@query(
    "WITH f AS (SELECT DISTINCT user_id % 10 AS fold FROM events), t AS (SELECT DISTINCT event_type FROM events), "
    "g AS (SELECT user_id % 10 AS fold, event_type, avg(value) AS gain FROM events WHERE value > 60 GROUP BY 1, 2) "
    f"SELECT t.event_type, {R('avg(coalesce(gain, 0))', 'gain')} FROM f CROSS JOIN t LEFT JOIN g USING (fold, event_type) GROUP BY t.event_type"
)
def importance_mean(spark, d):
    """The mean over the folds; a fold that lacks a column counts as zero."""
    e = table(spark, d, "events").withColumn("fold", F.col("user_id") % 10)
    gains = e.filter("value > 60").groupBy("fold", "event_type").agg(F.avg("value").alias("gain"))
    n_folds = e.select("fold").distinct().count()
    names = e.select("event_type").distinct()
    total = names.join(gains.groupBy("event_type").agg(F.sum("gain").alias("gain")), "event_type", "left")
    return total.select("event_type", r6(F.coalesce("gain", F.lit(0.0)) / n_folds).alias("gain"))


@query(
    EPOCHS_SQL + ", c AS (SELECT user_id % 10 AS fold, stage, count(*) AS n FROM kept GROUP BY 1, 2), "
    "m AS (SELECT f.fold, o.stage, sum(o.n) AS n FROM (SELECT DISTINCT fold FROM c) f JOIN c o ON o.fold <> f.fold GROUP BY 1, 2), "
    "p AS (SELECT fold, stage AS pred FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, stage) AS r FROM m) WHERE r = 1), "
    "f AS (SELECT k.user_id % 10 AS fold, k.stage, p.pred FROM kept k JOIN p ON p.fold = k.user_id % 10) "
    + _scores_sql("f", " GROUP BY GROUPING SETS ((fold), ())", "fold, ")
)
def model_majority(spark, d):
    """Each fold is given the most frequent stage of the others."""
    from tidewave.operators.models import majority

    rows = kept(spark, d).withColumn("fold", F.col("user_id") % 10)
    return _rounded(evaluation.pooled_and_fold(majority(rows, "fold", "stage"), "stage", "pred", "fold"))


# The flagship: normalised, shifted and smoothed epochs, summed up per recording.


@query(
    EPOCHS_SQL + ", w AS (SELECT *, quantile_cont(value, [0.05, 0.5, 0.95]) OVER w AS q, count(value) OVER w AS n, "
    "CASE WHEN lag(epoch_idx) OVER o = epoch_idx - 1 THEN lag(value) OVER o END AS back, "
    "avg(value) OVER (PARTITION BY user_id ORDER BY epoch_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS t FROM kept "
    "WINDOW w AS (PARTITION BY user_id ORDER BY epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY user_id ORDER BY epoch_idx)), "
    f"z AS (SELECT *, CASE WHEN n >= 20 THEN {_NORM} END AS z FROM w) "
    f"SELECT user_id, count(*) AS n, count(z) AS n_norm, count(back) AS n_back, {R('avg(z)', 'z')}, {R('avg(back)', 'back')}, {R('avg(t)', 'trail')} FROM z GROUP BY user_id"
)
def recording_summary(spark, d):
    x = F.col("value")
    rows = kept(spark, d).select(
        "user_id",
        X.expanding_norm(x, KEYS, "epoch_idx").alias("z"),
        X.gap_shift(x, KEYS, "epoch_idx", -1).alias("back"),
        X.trailing_mean(x, KEYS, "epoch_idx").alias("t"),
    )
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count("z").alias("n_norm"), F.count("back").alias("n_back"),
        r6(F.avg("z")).alias("z"), r6(F.avg("back")).alias("back"), r6(F.avg("t")).alias("trail"),
    )


# Kernels, models and staging: no SQL; tests hold them against formulas and against each other.

RATE = 100.0


def _recordings(spark, d):
    """Embeddings as epochs of two channels; a label is a recording."""
    return signals(spark, d).select("label", "vec_id", F.array("x", F.reverse("x")).alias("signal"))


@query()
def bandpass(spark, d):
    from tidewave.operators.spectra import filter_recordings

    return filter_recordings(_recordings(spark, d), ["label"], "vec_id", "signal", RATE, "zerophase")


@query()
def epoch_features(spark, d):
    """Welch spectra, band powers, moments, complexity and correlations of each epoch."""
    from tidewave.operators.spectra import epoch_features as kernel

    return kernel(_recordings(spark, d), ["label", "vec_id"], "signal", RATE, ["front", "back"], 64)


@query()
def spindle_features(spark, d):
    from tidewave.operators.spectra import spindle_features as kernel

    return kernel(_recordings(spark, d), ["label"], "vec_id", "signal", RATE)


@query(
    "WITH new AS (SELECT o_custkey AS key, min(o_orderpriority) AS config, count(*) AS n, bool_and(o_orderstatus <> 'F') AS skipped "
    "FROM orders GROUP BY 1), old AS (SELECT o_custkey AS key, max(o_orderpriority) AS config, min(o_orderkey) AS n FROM orders GROUP BY 1) "
    "SELECT new.key, new.config, CASE WHEN NOT skipped THEN new.n WHEN old.config = new.config THEN old.n END AS n, skipped "
    "FROM new LEFT JOIN old ON old.key = new.key"
)
def manifest_merge(spark, d):
    """Customers whose orders are none finished count as skipped and keep their earlier record if its config is the same."""
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"))
    new = by.agg(F.min("o_orderpriority").alias("config"), F.count("*").alias("n"), F.bool_and(F.col("o_orderstatus") != "F").alias("skipped"))
    old = by.agg(F.max("o_orderpriority").alias("config"), F.min("o_orderkey").alias("n"))
    return tables.merge_manifest(new, old, ["key"], "config", "skipped", ["n"])


@query(
    "WITH b AS (SELECT l_orderkey AS k, CASE WHEN min(l_linestatus) < max(l_linestatus) THEN 'P' ELSE min(l_linestatus) END AS status, "
    "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1) "
    "SELECT coalesce(o_orderkey, k) AS k, o_orderkey IS NOT NULL AND b.k IS NOT NULL AS in_both, coalesce(o_orderstatus = status, false) AS exact, "
    "coalesce(abs(o_totalprice - total) <= 1000, false) AS near FROM orders FULL JOIN b ON o_orderkey = b.k"
)
def order_cross_check(spark, d):
    """Orders against what their lines say: status exactly, price up to 1,000."""
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("total")
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(low < high, "P").otherwise(low).alias("status"), total)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return tables.cross_check(orders, lines, ["k"], ["status"], ["total"], 1000)


@query(
    "WITH f AS (SELECT o_orderpriority, o_custkey % 10 AS fold, count(*) AS n FROM orders GROUP BY 1, 2) "
    "SELECT o_orderpriority, " + R("avg(n)", "mean") + ", string_agg(CAST(n AS VARCHAR), ',' ORDER BY fold) AS scores FROM f GROUP BY 1 HAVING count(*) = 10"
)
def fold_score_lists(spark, d):
    per_fold = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 10).alias("fold")).agg(F.count("*").alias("n"))
    found = evaluation.fold_lists(per_fold, ["o_orderpriority"], "fold", "n")
    return found.select("o_orderpriority", r6(F.col("mean")).alias("mean"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))


@query(
    "WITH r AS (SELECT l_linenumber, l_returnflag, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2) "
    "SELECT r.l_linenumber, r.l_returnflag, " + R("r.score", "score") + ", " + R("r.score - b.score", "gain") + " "
    "FROM r LEFT JOIN r AS b ON b.l_returnflag = r.l_returnflag AND b.l_linenumber = 1"
)
def gain_over_baseline(spark, d):
    runs = table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_quantity").alias("score"))
    found = evaluation.versus(runs, "l_linenumber", "l_returnflag", "score", 1)
    return found.select("l_linenumber", "l_returnflag", r6(F.col("score")).alias("score"), r6(F.col("gain")).alias("gain"))


@query()
def group_folds(spark, d):
    """Whole users dealt to three folds of even stages."""
    from tidewave.operators.models import group_folds as deal

    return deal(kept(spark, d), "user_id", "stage", 3)


@query(
    EPOCHS_SQL + "SELECT count(DISTINCT user_id) AS subjects, CAST(0 AS BIGINT) AS split, CAST(3 AS BIGINT) AS folds, true AS even FROM kept"
)
def group_folds_check(spark, d):
    """How many users are dealt, how many lie in several folds, and whether of each stage no two folds differ by more than twice what one
    user has at most."""
    from tidewave.operators.models import group_folds as deal

    rows = kept(spark, d)
    dealt = deal(rows, "user_id", "stage", 3)
    whole = dealt.groupBy("user_id").agg(F.count_distinct("fold").alias("n")).agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("n") > 1).alias("split"))
    held = rows.join(dealt, "user_id").groupBy("stage", "fold").agg(F.count(F.lit(1)).alias("n"))
    one = rows.groupBy("stage", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("stage").agg(F.max("n").alias("one"))
    apart = held.groupBy("stage").agg((F.max("n") - F.min("n")).alias("apart"))
    even = apart.join(one, "stage").agg(F.bool_and(F.col("apart") <= 2 * F.col("one")).alias("even"))
    return whole.crossJoin(held.agg(F.count_distinct("fold").alias("folds"))).crossJoin(even).select("subjects", "split", "folds", "even")


@query()
def model_cv_ridge(spark, d):
    """Each third of the users scored by a linear model of the others."""
    from tidewave.operators.models import cross_validate

    rows = kept(spark, d).select(
        "user_id", "epoch_idx", "stage", (F.col("user_id") % 3).alias("fold"),
        X.expanding_norm(F.col("value"), KEYS, "epoch_idx").alias("value_norm"),
        X.trailing_mean(F.col("value"), KEYS, "epoch_idx").alias("value_p2min"), "k",
    )
    return cross_validate(rows, ["value_norm", "value_p2min", "k"], "fold", [0, 1, 2])


@query()
def stage_sessions(spark, d):
    """The stream's decisions for whole sessions, computed as a batch."""
    from tidewave.streaming.stager import LinearStager, stage_batch

    rows = kept(spark, d).select(
        F.col("user_id").cast("string").alias("session"), F.col("pos").alias("seq"), F.array("value", "k").alias("features"), F.lit(False).alias("ended")
    )
    coef = tuple(tuple(0.3 * ((i + 2 * j) % 5 - 2) for j in range(6)) for i in range(4))
    return stage_batch(rows, LinearStager(coef, (0.1, 0.0, 0.2, -0.1), tuple(map(tuple, STEPS)), WEIGHT), 2)


@query()
def model_boosted(spark, d):
    """Each user's epochs scored by boosted trees of their own values so far; a few small trees."""
    from tidewave.operators import boosting
    from tidewave.operators.models import predict

    rows = kept(spark, d).select(
        "user_id", "epoch_idx", "stage", X.expanding_norm(F.col("value"), KEYS, "epoch_idx").alias("value_norm"),
        X.trailing_mean(F.col("k"), KEYS, "epoch_idx", 4).alias("k_p2min"),
    )
    fitted = boosting.fit(rows, ["value_norm", "k_p2min"], "stage", 4, rounds=4, depth=2, bins=32)
    return predict(fitted, rows, ["value_norm", "k_p2min"]).select("user_id", "epoch_idx", "stage", "pred")
