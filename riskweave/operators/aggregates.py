"""Grouped statistics: degrees, snapshots, drift, distributions, weights, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles

MICROS_DAY = 86_400_000_000


def money(column: str | Column) -> Column:
    """Exact sums whatever the order of rows."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(18,4)")).cast("double")


def unpivoted(df: DataFrame, columns: Iterable[str], *keys: str) -> DataFrame:
    """``keys, feature, value``: one scan for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.value")


def sender_stats(df: DataFrame) -> DataFrame:
    """Distinct receivers (nulls are one receiver) and volume by sender."""
    return df.groupBy("src").agg(F.countDistinct(F.coalesce(F.col("dst").cast("string"), F.lit(""))).alias("out_degree"), F.round(money("amount"), 2).alias("total_sent"))


def receiver_stats(df: DataFrame) -> DataFrame:
    """Distinct senders and mean incoming amount by receiver."""
    return df.where("dst IS NOT NULL").groupBy("dst").agg(F.countDistinct("src").alias("in_degree"), F.round(money("amount") / F.count("amount"), 4).alias("mean_received"))


def with_degrees(df: DataFrame) -> DataFrame:
    """The four statistics mapped back to the rows (0 where absent) and the fan-in ratio. Degree tables grow with the nodes, so the joins shuffle."""
    out = df.hint("merge").join(sender_stats(df), "src", "left").hint("merge").join(receiver_stats(df), "dst", "left")
    out = out.fillna(0, ["out_degree", "in_degree"]).fillna(0.0, ["total_sent", "mean_received"])
    return out.withColumn("fan_in_ratio", F.round(F.col("in_degree") / (F.col("out_degree") + 1), 6))


def node_stats(edges: DataFrame) -> DataFrame:
    """Edge counts and amounts by node, each direction aggregated by itself, so neither multiplies the other; volume by ``out_degree + 1``."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), money("amount").alias("s"), F.max("is_fraud").alias("label"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"), money("amount").alias("r"))
    both = out.join(into, "id", "full").fillna(0, ["out_degree", "in_degree", "label"]).fillna(0.0, ["s", "r"])
    return both.select(
        "id", "out_degree", "in_degree", F.round(F.when(F.col("out_degree") > 0, F.col("s") / F.col("out_degree")).otherwise(0.0), 4).alias("avg_out"), F.round("s", 2).alias("sum_out"),
        F.round(F.when(F.col("in_degree") > 0, F.col("r") / F.col("in_degree")).otherwise(0.0), 4).alias("avg_in"), F.round(F.col("in_degree") / (F.col("out_degree") + 1), 6).alias("fan_in"),
        F.round(F.col("s") / (F.col("out_degree") + 1), 4).alias("volume_per_txn"), "label",
    )


def live_snapshot(scored: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Totals and per-client rows: counts by decision, rates, mean score and latency, volume; the total has a null client."""
    n, of = F.count(F.lit(1)), lambda d: F.count_if(F.col("decision") == d)
    return scored.rollup("client_id").agg(
        n.alias("n"), of("approve").alias("approved"), of("review").alias("reviewed"), of("block").alias("blocked"), F.round(of("block") / n, 4).alias("block_rate"), F.round(of("review") / n, 4).alias("review_rate"),
        F.round(F.avg("risk_score"), 4).alias("mean_score"), F.round(F.avg(latency), 2).alias("mean_latency_ms"), F.round(money("amount_usd"), 2).alias("volume"),
    )


def hourly(scored: DataFrame, since: Column | None = None) -> DataFrame:
    """Per hour and client: counts, blocks, reviews, mean score, volume; of rows from ``since`` on, a literal that reaches the files as a filter."""
    if since is not None:
        scored = scored.where(F.col("ts") >= since)
    hour = F.floor(F.col("ts_us") / F.lit(3_600_000_000)).cast("long")
    return scored.groupBy(hour.alias("hour"), "client_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "block").alias("blocked"), F.count_if(F.col("decision") == "review").alias("reviewed"),
        F.round(F.avg("risk_score"), 4).alias("mean_score"), F.round(money("amount_usd"), 2).alias("volume"),
    )


def newest_us(df: DataFrame, column: str = "ts_us") -> int:
    """The largest time, one number, so that later filters hold a literal. 0 without rows."""
    return df.agg(F.max(column)).first()[0] or 0


def newest(df: DataFrame, column: str = "ts_us") -> DataFrame:
    """One row ``now``."""
    return df.agg(F.max(column).alias("now"))


def block_rate_drift(scored: DataFrame, now: DataFrame) -> DataFrame:
    """Block rate of the last 7 days against the 30 before; a null or zero rate counts as 0.005."""
    d = scored.join(F.broadcast(now))
    age = F.col("now") - F.col("ts_us")
    current, base = age <= 7 * MICROS_DAY, (age > 7 * MICROS_DAY) & (age <= 37 * MICROS_DAY)
    rate = lambda period: F.coalesce(F.nullif(F.count_if(period & (F.col("decision") == "block")) / F.nullif(F.count_if(period), F.lit(0)), F.lit(0.0)), F.lit(0.005))
    out = d.agg(rate(current).alias("c"), rate(base).alias("b"))
    ratio = F.col("c") / F.greatest("b", F.lit(0.001))
    return out.select(F.round("c", 6).alias("current_rate"), F.round("b", 6).alias("baseline_rate"), F.round(ratio, 4).alias("ratio"), F.when(ratio >= 3, "critical").when(ratio >= 2, "high").otherwise("none").alias("severity"))


def mean_shift_drift(df: DataFrame, now: DataFrame, features: Iterable[str]) -> DataFrame:
    """Per feature: shift of the mean in reference deviations over 3, at most 1 (1 without deviation)."""
    d = unpivoted(df.join(F.broadcast(now)).withColumn("age", F.col("now") - F.col("ts_us")), features, "age")
    cur, ref = F.col("age") <= 7 * MICROS_DAY, (F.col("age") > 7 * MICROS_DAY) & (F.col("age") <= 37 * MICROS_DAY)
    at = lambda p: F.when(p, F.col("value"))
    out = d.groupBy("feature").agg(F.avg(at(cur)).alias("mc"), F.avg(at(ref)).alias("mr"), F.stddev_samp(at(ref)).alias("sr"))
    shift = F.when(F.col("sr").isNull() | (F.col("sr") == 0), 1.0).otherwise(F.least(F.abs(F.col("mc") - F.col("mr")) / F.greatest("sr", F.lit(1e-9)) / 3, F.lit(1.0)))
    return out.select("feature", F.round(shift, 4).alias("drift"), F.when(shift > 0.25, "high").when(shift > 0.10, "medium").otherwise("none").alias("severity"))


def binned_psi(df: DataFrame, column: str, current: Column, bins: int = 10) -> DataFrame:
    """Population stability index over equal-width bins: sum of (p - q) ln(p / q), empty bins 1e-6."""
    lo_hi = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.floor((F.col(column) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins), F.lit(bins - 1)).cast("int")
    h = df.join(F.broadcast(lo_hi)).groupBy(b.alias("bin")).agg(F.count_if(current).alias("c"), F.count_if(~current).alias("r"))
    total = h.agg(F.sum("c").alias("tc"), F.sum("r").alias("tr"))
    p, q = F.greatest(F.col("c") / F.col("tc"), F.lit(1e-6)), F.greatest(F.col("r") / F.col("tr"), F.lit(1e-6))
    return h.join(F.broadcast(total)).agg(F.round(F.sum((p - q) * F.log(p / q)), 4).alias("psi"))


def cohens_d(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    """Effect size between labels 0 and 1 for each column, with its verdict."""
    d = unpivoted(df, columns, label)
    of = lambda y: F.when(F.col(label) == y, F.col("value"))
    g = d.groupBy("feature").agg(F.avg(of(1)).alias("m1"), F.avg(of(0)).alias("m0"), F.stddev_samp(of(1)).alias("s1"), F.stddev_samp(of(0)).alias("s0"), F.count(of(1)).alias("n1"), F.count(of(0)).alias("n0"))
    d_ = F.abs(F.col("m1") - F.col("m0")) / (F.sqrt((F.col("s1") ** 2 + F.col("s0") ** 2) / 2) + 1e-9)
    g = g.where("n1 >= 10 AND n0 >= 10")
    return g.select("feature", F.round(d_, 4).alias("effect"), F.when(d_ > 1, "artefact").when(d_ > 0.5, "moderate").otherwise("ok").alias("verdict"))


def bhattacharyya(df: DataFrame, column: str, label: str, bins: int = 10) -> DataFrame:
    """Overlap of the column's two label distributions over equal-width bins, the last closed."""
    lo_hi = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-10)) * bins), F.lit(bins - 1)).cast("int")
    h = df.join(F.broadcast(lo_hi)).groupBy(b.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    total = h.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    c = F.sum(F.sqrt(F.col("p") / F.col("tp") * (F.col("q") / F.col("tq"))))
    out = h.join(F.broadcast(total)).agg(c.alias("c"))
    return out.select(F.round("c", 4).alias("overlap"), F.when(F.col("c") < 0.25, "separable").when(F.col("c") < 0.40, "partial").otherwise("overlapping").alias("band"))


def log_normal_fit(df: DataFrame, column: str, *keys: str) -> DataFrame:
    x = F.log(F.greatest(F.col(column), F.lit(1.0)))
    return df.groupBy(*keys).agg(F.round(F.avg(x), 6).alias("mu"), F.round(F.stddev_samp(x), 6).alias("sigma"))


def counted(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Distinct values with their counts ``_c``, combined before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))


def median_ratio(df: DataFrame, column: str, label: str) -> DataFrame:
    """Median of label 1 over that of label 0, and median and first decile of label 1 (exact)."""
    q = quantiles(counted(df.where(F.col(label).isin(0, 1)), column, label), column, "_c", {"m": 0.5, "p": 0.1}, label)
    of = lambda y, c: F.max(F.when(F.col(label) == y, F.col(c)))
    g = q.agg(of(1, "m").alias("m1"), of(0, "m").alias("m0"), of(1, "p").alias("p10"))
    return g.select(F.round(F.col("m1") / F.col("m0"), 6).alias("ratio"), F.round("m1", 6).alias("median_1"), F.round("p10", 6).alias("p10_1"))


def burst_stats(df: DataFrame) -> DataFrame:
    """Rows a sender and span in hours, then their deciles."""
    per = df.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(3_600_000_000).cast("double")).alias("span"))
    q = quantiles(counted(per, "n"), "n", "_c", {"n_p10": 0.1, "n_p90": 0.9})
    mean = per.agg(F.round(F.avg("span"), 4).alias("mean_span_hours"))
    return mean.join(F.broadcast(q.select(F.round("n_p10", 4).alias("n_p10"), F.round("n_p90", 4).alias("n_p90")))).select("n_p10", "n_p90", "mean_span_hours")


def hour_distribution(df: DataFrame, top: int = 3) -> DataFrame:
    """Share of each hour of the day and whether it is among the ``top`` (24 rows)."""
    from pyspark.sql import Window

    hour = F.pmod(F.floor(F.col("ts_us") / F.lit(3_600_000_000)), F.lit(24)).cast("int")
    h = df.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n").alias("t"))
    order = Window.orderBy(F.desc("n"), "hour")  # over 24 aggregated rows
    return h.join(F.broadcast(total)).select("hour", F.round(F.col("n") / F.col("t"), 6).alias("share"), (F.row_number().over(order) <= top).alias("is_top"))


def archetypes(fit: DataFrame, offsets: dict[str, tuple[float, float]]) -> DataFrame:
    """Parameters of each archetype: shifted mean, scaled deviation, median."""
    rows = F.array(*(F.struct(F.lit(k).alias("archetype"), F.lit(float(o)).alias("o"), F.lit(float(s)).alias("s")) for k, (o, s) in offsets.items()))
    a = fit.select("mu", "sigma", F.explode(rows).alias("a"))
    return a.select("a.archetype", F.round(F.col("mu") + F.col("a.o"), 4).alias("mu"), F.round(F.col("sigma") * F.col("a.s"), 4).alias("sigma"), F.round(F.exp(F.col("mu") + F.col("a.o")), 2).alias("median"))


def data_summary(df: DataFrame) -> DataFrame:
    """Rows, fraud and upper quantiles by client and kind, with their totals (null kind, null client)."""
    levels = F.array(*(F.struct(F.lit(i).alias("level"), (F.coalesce("client_id", F.lit("")) if i < 2 else F.lit("")).alias("c"), (F.coalesce("event_type", F.lit("")) if i < 1 else F.lit("")).alias("e")) for i in range(3)))
    g = df.groupBy("client_id", "event_type", "amount_usd").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"))
    g = g.select(F.explode(levels).alias("l"), "amount_usd", "n", "fraud").select("l.*", "amount_usd", "n", "fraud").groupBy("level", "c", "e", "amount_usd").agg(F.sum("n").alias("n"), F.sum("fraud").alias("fraud"))
    q = quantiles(g, "amount_usd", "n", {"p75": 0.75, "p95": 0.95}, "level", "c", "e")
    sums = g.groupBy("level", "c", "e").agg(F.sum("n").alias("n"), F.sum("fraud").alias("fraud"))
    return sums.hint("merge").join(q, ["level", "c", "e"], "left").select(
        F.when(F.col("level") < 2, F.col("c")).alias("client_id"), F.when(F.col("level") < 1, F.col("e")).alias("event_type"), "n", "fraud",
        F.round(F.col("fraud") / F.col("n"), 6).alias("fraud_rate"), F.round("p75", 4).alias("p75"), F.round("p95", 4).alias("p95"),
    )


def cross_modal_totals(df: DataFrame, key: str) -> DataFrame:
    """Rows that belong to a cross-modal sequence, and how many sequences there are."""
    return df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("transactions"), F.countDistinct(key).alias("sequences"))


def split_report(df: DataFrame, embedding: str | None = None) -> DataFrame:
    """Rows, fraud and first time of each split; share of rows with an ``embedding`` (1 or 0); whether training and test differ by over 5 points of fraud."""
    hit = [F.round(100 * F.avg(embedding), 4).alias("embedding_percent")] if embedding else []
    g = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("is_fraud").alias("_f"), F.min("ts_us").alias("first_us"), *hit)
    of = lambda s: F.max(F.when(F.col("split") == s, F.col("_f")))
    note = g.agg(F.coalesce(F.abs(of("train") - of("test")) * 100 > 5.0, F.lit(False)).alias("fraud_shift"))
    return g.join(F.broadcast(note)).select("split", "n", F.round(100 * F.col("_f"), 4).alias("fraud_percent"), "first_us", *(["embedding_percent"] if embedding else []), "fraud_shift")


def source_mix(df: DataFrame, source: str) -> DataFrame:
    """Rows and share of each source within each split."""
    g = df.groupBy("split", source).agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy("split").agg(F.sum("n").alias("_t"))  # a row for each split
    return g.join(F.broadcast(total), "split").select("split", source, "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("percent"))


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: rows of each class and their ratio."""
    one, zero = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(one.alias("n_pos"), zero.alias("n_neg"), F.round(zero / F.nullif(one, F.lit(0)), 6).alias("weight"))


def rate_corrected(df: DataFrame, target: float = 0.005, mode: str = "reference") -> DataFrame:
    """Weights that correct the fraud rate, only if it exceeds the target; a one-row aggregate joins every row.

    "reference": weight of legitimate rows times t/(1-t) * (1-a)/a, which raises
    the weighted fraud share; "exact": a/(1-a) * (1-t)/t, which meets the target.
    """
    a = df.agg(F.avg("is_fraud").alias("a"))
    factor = F.lit(target / (1 - target)) * (1 - F.col("a")) / F.col("a") if mode == "reference" else F.col("a") / (1 - F.col("a")) * F.lit((1 - target) / target)
    return df.join(F.broadcast(a)).withColumn("sample_weight", F.round(F.when((F.col("is_fraud") == 0) & (F.col("a") > target), factor).otherwise(1.0), 6)).drop("a")


def mean_one_weights(df: DataFrame, weight: str) -> DataFrame:
    """Weights over their mean; null counts as 0.001."""
    w = F.coalesce(F.col(weight), F.lit(0.001))
    return df.join(F.broadcast(df.agg(F.avg(w).alias("_mean")))).withColumn("weight", F.round(w / F.col("_mean"), 6)).drop("_mean")


def embedding_diagnostics(nodes: DataFrame, a: str, b: str) -> DataFrame:
    """Distance of the centroids of two classes and mean variance by dimension of each."""
    d = nodes.where(F.col("class").isin(a, b)).select("class", F.posexplode("features").alias("dim", "x"))
    of = lambda c: F.when(F.col("class") == c, F.col("x"))
    g = d.groupBy("dim").agg(F.avg(of(a)).alias("ma"), F.avg(of(b)).alias("mb"), F.var_pop(of(a)).alias("va"), F.var_pop(of(b)).alias("vb"))
    return g.agg(F.round(F.sqrt(F.sum((F.col("ma") - F.col("mb")) ** 2)), 4).alias("distance"), F.round(F.avg("va"), 4).alias("variance_a"), F.round(F.avg("vb"), 4).alias("variance_b"))


def quality_rules(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rule, value, passed``: each rule an aggregate and a condition on ``value``; all in one pass."""
    one = df.agg(*(value.cast("double").alias(name) for name, (value, _) in rules.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.round(F.col(n), 6).alias("value")) for n in rules))
    out = one.select(F.explode(rows).alias("r")).select("r.rule", "r.value")
    passed = F.lit(None).cast("boolean")
    for name, (_, check) in rules.items():
        passed = F.when(F.col("rule") == name, check).otherwise(passed)
    return out.withColumn("passed", passed)


def latency_report(df: DataFrame, kind: str, value: str, failed: Column, least: int = 5) -> DataFrame:
    """Count, exact percentiles and failure share by request kind, of kinds with at least ``least`` rows."""
    shares = {"p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    g = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(failed.cast("int")), 4).alias("failed_percent")).where(F.col("n") >= least)
    q = quantiles(counted(df, value, kind), value, "_c", shares, kind)
    return g.join(q, kind).select(kind, "n", *(F.round(c, 4).alias(c) for c in shares), "failed_percent")


def slow_requests(df: DataFrame, value: str, failed: Column, over: float = 200.0) -> DataFrame:
    """Requests that did not fail and took longer than ``over``."""
    return df.where((F.col(value) > over) & ~F.coalesce(failed, F.lit(False)))
