"""Evaluation: precision-recall and ROC measures, thresholds, scenarios, noise.

Curves need rows in score order. Scores are grouped first, so what is ordered
has a row for each different score, and the sums before a score come from
``running_sums``: no window spans a table or a narrow range of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import saved
from .joins import lookup, threshold_grid
from .ordering import quantiles, ranks, running_sums, stable_hash


def by_score(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    """``keys, score, p, n``: rows of either label by distinct score."""
    y = F.col(label)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))


def curve(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, score, p, n, tp, fp, pos, neg``: by descending distinct score (``by_score``), counts and their running sums."""
    r = running_sums(counts, list(keys), [F.desc("score")], ["p", "n"])
    return r.select(*keys, "score", "p", "n", (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp"), F.col("p_all").alias("pos"), F.col("n_all").alias("neg"))


def curve_measures(counts: DataFrame, *keys: str) -> DataFrame:
    """``average_precision`` (sum over distinct scores, descending, of the gain in recall times the precision) and ``roc_auc`` (share of pairs of both labels in the right order, ties one half)."""
    c = curve(counts, *keys)
    precision = F.sum(F.col("p") / F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    below = F.col("neg") - F.col("fp") + F.col("n") / F.lit(2)
    return c.groupBy(*keys).agg(F.round(precision, 6).alias("average_precision"), F.round(F.sum(F.col("p") * below) / (F.first("pos") * F.first("neg")), 6).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    return curve_measures(by_score(df, score, label, *keys), *keys).select(*keys, "average_precision")


def roc_auc(df: DataFrame, score: str, label: str, *keys: str) -> DataFrame:
    return curve_measures(by_score(df, score, label, *keys), *keys).select(*keys, "roc_auc")


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    return c.select("tp", "fp", "fn", "tn", *(F.round(v, 6).alias(k) for k, v in rates().items()))


def rates() -> dict[str, Column]:
    tp, fp, fn, tn, e = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), F.lit(1e-9)
    p, r = tp / (tp + fp + e), tp / (tp + fn + e)
    f = lambda b: (1 + b * b) * p * r / (b * b * p + r + e)
    return {"precision": p, "recall": r, "f1": f(1), "f2": f(2), "accuracy": (tp + tn) / (tp + fp + fn + tn + e), "fpr": fp / (fp + tn + e), "fnr": fn / (fn + tp + e)}


def at_recall(df: DataFrame, score: str, label: str, least: float = 0.90) -> DataFrame:
    """The highest threshold whose recall reaches ``least``, and its precision."""
    c = curve(by_score(df, score, label)).where(F.col("tp") >= least * F.col("pos"))
    best = c.agg(F.max_by(F.struct("score", "tp", "fp", "pos"), "score").alias("x"))
    return best.select(F.round("x.score", 6).alias("threshold"), F.round(F.col("x.tp") / (F.col("x.tp") + F.col("x.fp")), 6).alias("precision"), F.round(F.col("x.tp") / F.col("x.pos"), 6).alias("recall"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold of the largest F2 on the grid .05 to .94, ties to the smallest.

    Rows are first counted by their grid cell (91 cells at most), so the grid meets counts, not rows.
    """
    cell = F.least(F.greatest(F.floor(F.col(score) * 100 + 1e-9), F.lit(4)), F.lit(94)).cast("int")
    cells = df.groupBy(cell.alias("cell")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = threshold_grid(df.sparkSession).select("threshold", F.round(F.col("threshold") * 100).cast("int").alias("at"))
    both = cells.join(F.broadcast(grid), F.lit(True))
    hit = F.col("cell") >= F.col("at")
    c = both.groupBy("threshold").agg(F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("tn"))
    f2 = F.round(rates()["f2"], 6)
    return c.agg(F.min_by("threshold", F.struct(-f2, "threshold")).alias("threshold"), F.max(f2).alias("f2"))


def by_step(df: DataFrame, score: str, label: str, step: str, least: int = 5, early: int = 25) -> DataFrame:
    """Average precision and ROC area of each step with enough rows of both classes."""
    enough = df.groupBy(step).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).where((F.col("p") >= least) & (F.col("n") >= least)).select(step)
    some = df.join(lookup(enough), step)
    return curve_measures(by_score(some, score, label, step), step).withColumn("period", F.when(F.col(step) <= early, "early").otherwise("late"))


def step_drift(steps: DataFrame) -> DataFrame:
    """Early against late mean precision, best and worst step, verdict."""
    of = lambda p: F.avg(F.when(F.col("period") == p, F.col("average_precision")))
    g = steps.agg(of("early").alias("e"), of("late").alias("l"), F.min_by("step", F.struct(-F.col("average_precision"), "step")).alias("best_step"), F.min_by("step", F.struct("average_precision", "step")).alias("worst_step"))
    d = F.col("e") - F.col("l")
    return g.select(F.round("e", 4).alias("early"), F.round("l", 4).alias("late"), "best_step", "worst_step", F.when(d > 0.05, "strong").when(d > 0.02, "mild").otherwise("none").alias("drift"))


def flag_summary(df: DataFrame, score: str) -> DataFrame:
    """Unlabelled scoring: rows at each level, and flagged ones next to illicit nodes."""
    s = F.col(score)
    at = {f"at_{int(100 * t)}": F.count_if(s >= t) for t in (0.9, 0.8, 0.7, 0.5)}
    return df.agg(*(v.alias(k) for k, v in at.items()), F.count_if(s >= 0.85).alias("high"), F.count_if((s >= 0.70) & (F.col("has_illicit_neighbour") == 1)).alias("flagged_adjacent"))


def flag_rate_by_step(df: DataFrame, score: str, step: str, top: int = 10) -> DataFrame:
    g = df.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(score) >= 0.70).cast("int")), 6).alias("flag_rate"))
    return g.orderBy(F.desc("flag_rate"), step).limit(top)


# What an adversary sets in each strategy; LEGIT is the median of legitimate rows.
LEGIT = "legit"
STRATEGIES = {
    "baseline": {},
    "known_payee": {"is_first_time_receiver": 0.0},
    "low_velocity": {"count_1h": 1.0, "count_6h": 1.0, "velocity_ratio": 1.0},
    "amount_blending": {"amount_ratio": 1.0, "balance_drain_ratio": LEGIT},
    "combined": {"is_first_time_receiver": 0.0, "count_1h": 1.0, "count_6h": 1.0, "velocity_ratio": 1.0, "amount_ratio": 1.0, "balance_drain_ratio": LEGIT},
}
# New patterns of fraud on legitimate rows. Two numbers are bounds of a uniform draw (whole numbers below the upper one where both are int), one is the value.
DRIFTS = {
    "micro_structuring": {"amount_usd": (100.0, 999.0), "count_1h": (8, 20), "count_6h": (15, 40), "velocity_ratio": (5.0, 12.0)},
    "dormant_reactivation": {"sender_account_age_days": (1000, 3000), "sender_lifetime_txn_count": (1, 5), "count_6h": (10, 25), "velocity_ratio": (20.0, 50.0), "is_first_time_receiver": 1.0},
    "synthetic_identity": {"sender_account_age_days": (90, 180), "balance_drain_ratio": (0.6, 0.95), "is_first_time_receiver": 1.0, "sender_lifetime_txn_count": (15, 40)},
    "carousel": {"fan_in_ratio": (0.8, 1.2), "receiver_in_degree": (3, 8), "sender_out_degree": (3, 8), "count_24h": (6, 15), "velocity_ratio": (3.0, 8.0), "is_first_time_receiver": 0.0},
}
# The noise that a column takes.
NOISE = {
    "amount_usd": "gaussian_pct",
    "amount_ratio": "gaussian_pct",
    "balance_drain_ratio": "gaussian_pct",
    "velocity_ratio": "gaussian_pct",
    "velocity_baseline_daily": "gaussian_pct",
    "count_1h": "gaussian_pct",
    "count_6h": "gaussian_pct",
    "count_24h": "gaussian_pct",
    "sum_amount_1h": "gaussian_pct",
    "sum_amount_7d": "gaussian_pct",
    "hour_of_day": "gaussian_abs",
    "day_of_week": "gaussian_abs",
    "sender_account_age_days": "gaussian_pct",
    "receiver_wallet_age_days": "gaussian_pct",
}
# Scale and bounds of absolute noise, transfer types, sources of real rows.
ABS_SCALES = {"hour_of_day": 3.0, "day_of_week": 1.0}
ABS_BOUNDS = {"hour_of_day": (0.0, 23.0), "day_of_week": (0.0, 6.0)}
TRANSFER_TYPES = ["ach", "wire", "p2p", "rtp"]
REAL_SOURCES = ["elliptic_real", "alchemy_real"]


def linear_score(weights: dict[str, float], bias: float) -> Column:
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + F.col(name) * F.lit(w)
    return 1 / (1 + F.exp(-z))


def red_team(df: DataFrame, weights: dict[str, float], bias: float, label: str = "is_fraud", threshold: float = 0.5, residual: tuple[str, ...] = ("sender_out_degree", "fan_in_ratio", "sender_account_age_days")) -> DataFrame:
    """Fraud rows scored under each strategy's overrides in one pass: share below the threshold, mean score and its drop, and means of the residual columns of caught and evaded rows."""
    from .aggregates import counted

    legit = quantiles(counted(df.where(F.col(label) == 0), "balance_drain_ratio"), "balance_drain_ratio", "_c", {"_legit": 0.5})
    d = df.where(F.col(label) == 1).join(F.broadcast(legit), how="left").withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES))))
    changed = {}
    for c in weights:
        value = F.col(c).cast("double")
        for name, sets in STRATEGIES.items():
            if c in sets:
                value = F.when(F.col("strategy") == name, F.col("_legit") if sets[c] == LEGIT else F.lit(sets[c])).otherwise(value)
        changed[c] = value
    # Residual means are of the rows as they are, so they are kept apart from the overrides.
    d = d.withColumns({f"_{c}": F.col(c).cast("double") for c in residual}).withColumns(changed).withColumn("p", linear_score(weights, bias))
    evades = F.col("p") < threshold
    means = [F.round(F.avg(F.when(which, F.col(f"_{c}"))), 4).alias(f"{name}_{c}") for c in residual for name, which in (("caught", ~evades), ("evaded", evades))]
    g = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(evades.cast("int")), 6).alias("evasion_rate"), F.avg("p").alias("_m"), *means)
    base = g.where("strategy = 'baseline'").select(F.col("_m").alias("_base"))
    return g.join(F.broadcast(base)).withColumns({"mean_score": F.round("_m", 6), "score_drop": F.round(F.col("_base") - F.col("_m"), 6)}).drop("_m", "_base")


FRACTIONS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)


def uniform(*parts: Column) -> Column:
    """Between 0 and 1, fixed by the parts."""
    return stable_hash(*parts) / F.lit(2.0**32)


def drift_mix(df: DataFrame, key: str, label: str, weights: dict[str, float], bias: float) -> DataFrame:
    """``scenario, fraction, average_precision, drop_percent`` as a growing share of the positives is replaced by drifted rows.

    A drifted row is a legitimate one with the scenario's overrides, scored
    anew. Positives and legitimate rows are in a fixed pseudo-random order of
    their keys: the first ``floor(n * fraction)`` positives are replaced, each
    by the legitimate row of its own position (again from the first beyond the
    last), so what is replaced at one share is so at every larger one. Rows are
    grouped by score before they meet the 28 cells of scenario and share.
    """
    columns = list(weights)
    d = df.select(F.col(key).alias("_key"), F.col(label).alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)).where("_y IN (0, 1)")
    score = F.round(linear_score(weights, bias), 9)
    order = [stable_hash(F.col("_key")), F.col("_key")]
    ranked = ranks(d, ["_y"], order)
    legit = ranked.where("_y = 0").withColumnRenamed("_rank", "_at")
    bad = ranked.where("_y = 1").select("_key", score.alias("_own"), "_rank", "_n")
    size = legit.agg(F.max("_n").alias("_legit"))
    bad = bad.join(F.broadcast(size)).withColumn("_at", F.col("_rank") % F.col("_legit"))
    both = bad.hint("merge").join(legit.select("_at", *columns), "_at", "left").withColumn("scenario", F.explode(F.array(*map(F.lit, DRIFTS))))
    changed = {}
    for c in columns:
        value = F.col(c)
        for name, sets in DRIFTS.items():
            if c in sets:
                low, high = sets[c] if isinstance(sets[c], tuple) else (sets[c], sets[c])
                u = uniform(F.col("_key"), F.lit(name), F.lit(c))
                new = F.floor(u * (high - low)) + low if isinstance(high, int) else u * (high - low) + low
                value = F.when(F.col("scenario") == name, new.cast("double")).otherwise(value)
        changed[c] = value
    both = both.withColumns(changed).withColumn("_new", score).withColumn("fraction", F.explode(F.array(*map(F.lit, FRACTIONS))))
    taken = F.when(F.col("_rank") < F.floor(F.col("_n") * F.col("fraction") + 1e-9), F.col("_new")).otherwise(F.col("_own"))
    ones = both.groupBy("scenario", "fraction", taken.alias("score")).agg(F.count(F.lit(1)).alias("p"))
    # All cells share their legitimate rows, so these are summed once, at the scores that positives have anywhere.
    ones = saved(ones.select("scenario", "fraction", "score", "p"), "cells")
    zeros = legit.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("_asked"))
    asked = ones.select("score").distinct().select("score", F.lit(0).cast("long").alias("n"), F.lit(1).alias("_asked"))
    line = running_sums(zeros.unionByName(asked).groupBy("score").agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked")), [], [F.desc("score")], ["n"])
    line = line.where("_asked = 1").select("score", (F.col("n_before") + F.col("n")).alias("fp"))
    tp, pos = F.col("p_before") + F.col("p"), F.col("p_all")
    c = running_sums(ones.hint("merge").join(line, "score"), ["scenario", "fraction"], [F.desc("score")], ["p"])
    ap = saved(c.groupBy("scenario", "fraction").agg(F.round(F.sum(F.col("p") / pos * (tp / (tp + F.col("fp")))), 6).alias("average_precision")), "precision")
    base = ap.where("fraction = 0").select("scenario", F.col("average_precision").alias("_base"))  # a row a scenario
    return ap.join(F.broadcast(base), "scenario").select("scenario", "fraction", "average_precision", F.round(100 * (F.col("_base") - F.col("average_precision")) / F.col("_base"), 4).alias("drop_percent"))


def drift_alerts(mix: DataFrame, drop: float = 5.0) -> DataFrame:
    """By scenario the smallest share at which precision falls by ``drop`` percent (null: none), and the alert lines 5 and 10 % below the start."""
    base = F.max(F.when(F.col("fraction") == 0, F.col("average_precision")))
    return mix.groupBy("scenario").agg(F.min(F.when(F.col("drop_percent") >= drop, F.col("fraction"))).alias("first_fraction"), F.round(base * 0.95, 4).alias("alert_at"), F.round(base * 0.90, 4).alias("critical_at"))


def drop_pivot(df: DataFrame) -> DataFrame:
    """A row for each scenario, a column for each share."""
    p = df.groupBy("scenario").pivot("fraction", list(FRACTIONS)).agg(F.first("drop_percent"))
    return p.toDF("scenario", *(f"f_{round(100 * f)}" for f in FRACTIONS))


def with_noise(df: DataFrame, key: str, label: str = "is_fraud", level: float = 0.2, seed: int = 42) -> DataFrame:
    """Noise on the fraud rows of synthetic sources, by the rules of ``NOISE``; other rows stay as they are.

    Relative noise is Gaussian with ``level`` times the chosen rows' population
    deviation (none where that is below 1e-6) and never goes below 0; absolute
    noise has a scale of its own and bounds. ``floor(n * level / 2)`` of the
    chosen rows get another transfer type. All draws are fixed by ``key``
    (unique), so partitions don't matter; whole-number columns are cut to whole.
    """
    chosen = (F.col(label).cast("int") == 1) & (~F.coalesce(F.col("source").isin(*REAL_SOURCES), F.lit(False)) if "source" in df.columns else F.lit(True))
    here = {c: kind for c, kind in NOISE.items() if c in df.columns}
    spread = {c: F.stddev_pop(F.col(c).cast("double")).alias(f"_{c}") for c, kind in here.items() if kind == "gaussian_pct"}
    d = df.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    d = d.join(F.broadcast(d.where("_chosen").agg(F.lit(1).alias("_"), *spread.values())))
    made = {}
    for c, kind in here.items():
        draw = lambda n: stable_hash(F.col(key), F.lit(c), F.lit(seed), F.lit(n))  # noqa: B023, E731
        z = F.sqrt(-2 * F.log((draw(1) + 1) / F.lit(2.0**32 + 1))) * F.cos(F.lit(6.283185307179586) * draw(2) / F.lit(2.0**32))
        value = F.col(c).cast("double")
        if kind == "gaussian_pct":
            some = F.coalesce(F.col(f"_{c}"), F.lit(0.0)) >= 1e-6
            new = F.greatest(value + z * F.lit(level) * F.col(f"_{c}"), F.lit(0.0))
        else:
            low, high = ABS_BOUNDS[c]
            some, new = F.lit(True), F.least(F.greatest(value + z * F.lit(ABS_SCALES[c] * level / 0.2), F.lit(low)), F.lit(high))
        made[c] = F.when(F.col("_chosen") & some & F.col(c).isNotNull(), new).otherwise(value).cast(df.schema[c].dataType)
    out = d.withColumns(made)
    if "transfer_type" in df.columns:
        ranked = running_sums(d.where("_chosen").select(F.col(key), F.lit(1).cast("long").alias("_n")), [], [stable_hash(F.col(key), F.lit(seed)), F.col(key)], ["_n"])
        flips = ranked.where(F.col("_n_before") < F.floor(F.col("_n_all") * F.lit(level * 0.5) + 1e-9)).select(key, F.lit(True).alias("_flip"))
        pick = F.element_at(F.array(*map(F.lit, TRANSFER_TYPES)), (stable_hash(F.col(key), F.lit("transfer_type")) % len(TRANSFER_TYPES) + 1).cast("int"))
        out = out.hint("merge").join(flips, key, "left").withColumn("transfer_type", F.when(F.col("_flip"), pick).otherwise(F.col("transfer_type")))
    return out.select(*df.columns)
