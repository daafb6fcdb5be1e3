"""Per-identity features over time ranges.

All windows run on integer microseconds and partition by identity, so they
share one exchange. ``rangeBetween`` ends at the event (later rows never
count). Two rows at the same time are each other's peers: windows that end at
the current row count both, windows over prior rows neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import saved
from .joins import lookup
from .ordering import running_sums

SECOND = 1_000_000
HOUR = 3600 * SECOND
WEEK = 168 * HOUR


def _over(first: int, last: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(first, last)


def in_slots(df: DataFrame, features: Callable[..., DataFrame], width: int = WEEK) -> DataFrame:
    """``features`` (windows that look back ``width`` at most) with each identity cut into time slots of ``width``.

    A row is in its own slot and, as history only, in the next one. So the
    largest window task holds two slots of an identity, whatever its lifetime;
    the price is that rows are sorted twice.
    """
    slot = F.floor(F.col("ts_us") / F.lit(width)).cast("long")
    both = df.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slot", slot + F.col("_copy"))
    return features(both, keys=("identity", "_slot")).where("_copy = 0").drop("_copy", "_slot")


def velocity(df: DataFrame, keys: tuple[str, ...] = ("identity",)) -> DataFrame:
    """Counts and sums over 1, 6 and 24 hours (lower bound within) and 7 days (lower bound out), the current row counted."""
    made: dict[str, Column] = {}
    for name, width in (("1h", HOUR), ("6h", 6 * HOUR), ("24h", 24 * HOUR), ("7d", WEEK - 1)):
        over = _over(-width, 0, *keys)
        made[f"count_{name}"] = F.count(F.lit(1)).over(over)
        made[f"sum_{name}"] = F.round(F.sum("amount_usd").over(over), 2)
    return df.withColumns(made)


def baseline(df: DataFrame, keys: tuple[str, ...] = ("identity",)) -> DataFrame:
    """Rows a day over the last 7 days, mean amount (halves round up), and the ratios of the current values to them."""
    week = _over(-(WEEK - 1), 0, *keys)
    days = F.greatest((F.col("ts_us") - F.min("ts_us").over(week)) / F.lit(24 * HOUR).cast("double"), F.lit(1.0))
    df = df.withColumns({
        "baseline_rate": F.round(F.count(F.lit(1)).over(week) / days, 4), "baseline_amount": F.round(F.sum(F.col("amount_usd").cast("decimal(18,4)")).over(week).cast("double") / F.count("amount_usd").over(week) + 1e-9, 2),
        "_day": F.count(F.lit(1)).over(_over(-24 * HOUR, 0, *keys)),
    })
    return df.withColumns({
        "velocity_ratio": F.round(F.col("_day") / F.greatest("baseline_rate", F.lit(0.1)), 3),
        "amount_ratio": F.round(F.col("amount_usd") / F.greatest("baseline_amount", F.lit(1.0)), 3),
    }).drop("_day")


def cross_client(df: DataFrame, include_current: bool = False, keys: tuple[str, ...] = ("identity",)) -> DataFrame:
    """Institutions, activity and amounts at other clients, and modalities, over prior rows of 7 days.

    What happened at other clients is everything of the identity less the own
    client's, from windows that share the exchange by identity. The set of
    clients is bounded by their number.
    """
    prior = -1
    week, own = _over(-WEEK, prior, *keys), _over(-WEEK, prior, *keys, "client_id")
    hour, own_hour = _over(-HOUR, prior, *keys), _over(-HOUR, prior, *keys, "client_id")
    modal = _over(-WEEK, 0 if include_current else prior, *keys)
    n = F.count(F.lit(1))
    df = df.withColumns({
        "institution_count": F.size(F.collect_set("client_id").over(week)),
        "cross_client_velocity": n.over(hour) - n.over(own_hour),
        "_n": n.over(week) - n.over(own),
        "_sum": F.coalesce(F.sum(F.col("amount_usd").cast("decimal(18,4)")).over(week), F.lit(0)) - F.coalesce(F.sum(F.col("amount_usd").cast("decimal(18,4)")).over(own), F.lit(0)),
        "has_fiat_history": F.coalesce(F.max((F.col("modality") == "fiat").cast("int")).over(modal), F.lit(0)),
        "has_crypto_history": F.coalesce(F.max((F.col("modality") == "crypto").cast("int")).over(modal), F.lit(0)),
    })
    mean = F.col("_sum").cast("double") / F.col("_n")
    close = F.least(F.greatest(1 - F.abs(F.col("amount_usd") - mean) / F.greatest(mean, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({
        "amount_correlation": F.round(F.when(F.col("_n") > 0, close).otherwise(0.0), 4),
        "cross_modal_pattern_detected": F.col("has_fiat_history") * F.col("has_crypto_history"),
    }).drop("_n", "_sum")


def time_since_other_client(df: DataFrame) -> DataFrame:
    """Seconds since the identity's last row at another client, null if none within 7 days.

    Rows are cut into islands of one client; the row before an island is the
    last one elsewhere for all its rows. Ties in time follow ``event_id``.
    """
    order = Window.partitionBy("identity").orderBy("ts_us", "event_id")
    df = df.withColumns({"_client": F.lag("client_id").over(order), "_ts": F.lag("ts_us").over(order)})
    fresh = F.col("_client").isNull() | (F.col("_client") != F.col("client_id"))
    df = df.withColumn("_island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_other", F.first("_ts").over(Window.partitionBy("identity", "_island").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("ts_us") - F.col("_other")
    return df.withColumn("time_since_other_institution_sec", F.round(F.when(gap <= WEEK, gap / F.lit(SECOND).cast("double")), 1)).drop("_client", "_ts", "_island", "_other")


def time_since_other_client_ranges(df: DataFrame) -> DataFrame:
    """``time_since_other_client`` for identities too hot for one task, whatever their lifetime.

    Rows are dealt by sampled ranges of identity and time. What a range leaves to
    the next is no sum but merges like one: the client and time of its last row, and
    the last time at any other client. These, a row for each range and identity, are
    folded in order; a range's rows look into it and then at what comes in.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(n, "identity", "ts_us", "event_id").withColumn("_range", F.spark_partition_id()), "ranges")
    keys = ["identity", "_range"]
    order = Window.partitionBy(*keys).orderBy("ts_us", "event_id")
    d = dealt.withColumns({"_client": F.lag("client_id").over(order), "_ts": F.lag("ts_us").over(order)})
    fresh = F.col("_client").isNull() | (F.col("_client") != F.col("client_id"))
    d = d.withColumn("_island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_other", F.first("_ts").over(Window.partitionBy(*keys, "_island").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct(F.col("client_id").alias("client"), F.col("ts_us").alias("ts"), F.col("_other").alias("other")), F.struct("ts_us", "event_id"))
    left = d.groupBy(*keys).agg(last.alias("s"))
    earlier = Window.partitionBy("identity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast(left.schema["s"].dataType)

    def merge(a: Column, b: Column) -> Column:
        """Of two ranges in order as one."""
        other = F.when(b["other"].isNotNull(), b["other"]).when(a["client"] != b["client"], a["ts"]).otherwise(a["other"])
        return F.struct(b["client"].alias("client"), b["ts"].alias("ts"), other.alias("other"))

    comes = left.select(*keys, F.aggregate(F.collect_list("s").over(earlier), none, merge).alias("_in"))
    both = d.join(lookup(comes), keys)
    before = F.when(F.col("_in.client") != F.col("client_id"), F.col("_in.ts")).otherwise(F.col("_in.other"))
    gap = F.col("ts_us") - F.coalesce("_other", before)
    return both.withColumn("time_since_other_institution_sec", F.round(F.when(gap <= WEEK, gap / F.lit(SECOND).cast("double")), 1)).drop("_client", "_ts", "_island", "_other", "_range", "_in")


def prior_high_risk(df: DataFrame, risk: float = 0.70, keys: tuple[str, ...] = ("identity",)) -> DataFrame:
    """Whether another client scored the identity at ``risk`` or more in the prior 7 days."""
    hit = F.sum((F.col("risk_score") >= risk).cast("int"))
    week, own = _over(-WEEK, -1, *keys), _over(-WEEK, -1, *keys, "client_id")
    return df.withColumn("prior_high_risk", (F.coalesce(hit.over(week), F.lit(0)) - F.coalesce(hit.over(own), F.lit(0)) > 0).cast("int"))


def lifetime(df: DataFrame) -> DataFrame:
    """Running count and volume with the current row, and the amount against their mean."""
    order = Window.partitionBy("identity").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"lifetime_count": F.count(F.lit(1)).over(order), "_v": F.sum(F.col("amount_usd").cast("decimal(18,4)")).over(order)})
    mean = F.col("_v").cast("double") / F.col("lifetime_count")
    return df.withColumns({"lifetime_volume": F.round(F.col("_v").cast("double"), 2), "lifetime_amount_ratio": F.round(F.col("amount_usd") / F.greatest(mean, F.lit(1.0)), 3)}).drop("_v")


def lifetime_ranges(df: DataFrame) -> DataFrame:
    """``lifetime`` for identities too hot for one task: sums before a row by ``running_sums``."""
    d = df.withColumns({"_one": F.lit(1).cast("long"), "_v": F.coalesce(F.col("amount_usd").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))})
    d = running_sums(d, ["identity"], [F.col("ts_us"), F.col("event_id")], ["_one", "_v"])
    d = d.withColumns({"lifetime_count": F.col("_one_before") + 1, "_sum": (F.col("_v_before") + F.col("_v")).cast("double")})
    made = {"lifetime_volume": F.round("_sum", 2), "lifetime_amount_ratio": F.round(F.col("amount_usd") / F.greatest(F.col("_sum") / F.col("lifetime_count"), F.lit(1.0)), 3)}
    return d.withColumns(made).drop("_one", "_v", "_sum", *(f"{c}_{k}" for c in ("_one", "_v") for k in ("before", "all")))


def first_time_receiver(df: DataFrame) -> DataFrame:
    """Whether a row is the identity's first to its receiver: a grouped minimum, joined back on the pair and the row's place."""
    place = F.struct("ts_us", "event_id")
    firsts = df.groupBy("identity", "receiver").agg(F.min(place).alias("_first")).select("identity", "_first.*").withColumn("is_first_time_receiver", F.lit(1))
    marked = df.hint("merge").join(firsts, ["identity", "ts_us", "event_id"], "left")
    return marked.withColumn("is_first_time_receiver", F.coalesce("is_first_time_receiver", F.lit(0)))


def balance_drain(amount: str, before: str) -> dict[str, Column]:
    a, b = F.col(amount), F.col(before)
    return {"balance_drain_ratio": F.round(F.when(b > 0, a / b).otherwise(0.0), 4), "balance_after": F.greatest(b - a, F.lit(0.0))}


def latest_snapshot(df: DataFrame, now_us: Column, days: int = 90) -> DataFrame:
    """The last row of each identity within ``days``, by a grouped maximum (no window, no sort)."""
    recent = df.where(F.col("ts_us") >= now_us - days * 24 * HOUR)
    last = F.max_by(F.struct("event_id", "client_id", "amount_usd", "risk_score"), F.struct("ts_us", "event_id"))
    return recent.groupBy("identity").agg(last.alias("last"), F.max("ts_us").alias("ts_us")).select("identity", "ts_us", "last.*")


def hour_buckets(df: DataFrame, hours: int = 24) -> DataFrame:
    """Velocity for identities too hot for one window task: counts by identity and hour first, windows over these.

    Bounds are whole hours (the current and the ``hours - 1`` before it), so it
    stands in for ``velocity`` where its exact bounds aren't needed.
    """
    hour = F.floor(F.col("ts_us") / F.lit(HOUR)).cast("long")
    small = df.groupBy("identity", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount_usd").cast("decimal(18,4)")).alias("v"))
    over = Window.partitionBy("identity").orderBy("hour").rangeBetween(-(hours - 1), 0)
    return small.select("identity", "hour", F.sum("n").over(over).alias("count_hours"), F.round(F.sum("v").over(over).cast("double"), 2).alias("sum_hours"))
