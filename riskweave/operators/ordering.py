"""Splits, samples, reports by rank, unions and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import saved
from .joins import lookup


def stable_hash(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 of the parts' texts, the same in every engine and whatever the partitions."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], names: list[str]) -> DataFrame:
    """``df`` with ``<name>_before``, the sum of the earlier rows in ``order`` within ``keys``, and ``<name>_all``.

    No window spans a key: rows are dealt by sampled ranges of keys and order,
    summed within a range, and the ranges' totals, a row or two a range and key,
    are summed apart. ``order`` should be unique within a key. The ranges are a
    written table, as their numbers must stay.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(*(F.sum(c).alias(c) for c in names))
    earlier, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    before = sums.select(*keys, "_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_ranges") for c in names), *(F.sum(c).over(whole).alias(f"{c}_all") for c in names))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in names}).join(lookup(before), [*keys, "_range"])
    return both.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_ranges") for c in names}).drop("_range", *(f"{c}_ranges" for c in names))


def ranks(df: DataFrame, keys: list[str], order: list[Column], rank: str = "_rank", total: str = "_n") -> DataFrame:
    """``df`` with each row's number from 0 in ``order`` within ``keys``, and the number of rows of its keys.

    Rows are sorted by sampled ranges and written with a running number; what is
    summed is a row for each range and key. No window and no second shuffle of rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    table = saved(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    table = table.withColumn("_range", F.shiftrightunsigned("_at", 33))  # the number's upper bits are the partition
    sums = table.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    earlier, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    before = sums.select(*keys, "_range", (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")).alias("_before"), F.sum("_c").over(whole).alias(total))
    # Without keys there is a row for each range.
    both = table.join(F.broadcast(before) if not keys else lookup(before), [*keys, "_range"])
    return both.withColumn(rank, F.col("_at") + F.col("_before")).drop("_at", "_range", "_before")


def quantiles(counts: DataFrame, value: str, count: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Exact, interpolated quantiles by ``keys`` from a table of distinct values and their counts; no key's values meet in one task."""
    r = running_sums(counts.where(F.col(value).isNotNull()), list(keys), [F.col(value)], [count])
    low, high, top = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count), F.col(f"{count}_all") - 1
    out = []
    for name, share in shares.items():
        at = top * F.lit(float(share))
        pick = lambda rank: F.max(F.when((low <= rank) & (rank < high), F.col(value)))
        first, second, rest = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        out.append((first + (second - first) * rest).alias(name))
    return r.groupBy(*keys).agg(*out)


def temporal_split(df: DataFrame, ts: str, key: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """80/10/10 by position in time order (null times last, ties by key, which is unique).

    Only times and keys are ranked; the two rows at the cuts become constants, with
    which every row is compared where it stands, so the table isn't shuffled.
    """
    narrow = ranks(df.select(F.col(ts).alias("_ts"), F.col(key).alias("_key")), [], [F.asc_nulls_last("_ts"), F.col("_key")])
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val) + 1e-9)
    cuts = narrow.where((F.col("_rank") == first) | (F.col("_rank") == second)).orderBy("_rank").select("_ts", "_key", (F.col("_rank") == first).alias("_first"), (F.col("_rank") == second).alias("_second")).collect()
    out = F.lit("train")
    for name, at in (("val", "_first"), ("test", "_second")):
        row = next((r for r in cuts if r[at]), None)
        if row is None:  # the part is empty
            continue
        tie = F.col(key) >= F.lit(row["_key"])
        since = F.col(ts).isNull() & tie if row["_ts"] is None else F.col(ts).isNull() | (F.col(ts) > F.lit(row["_ts"])) | ((F.col(ts) == F.lit(row["_ts"])) & tie)
        out = F.when(since, name).otherwise(out)
    return df.withColumn("split", out)


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.70, val: float = 0.15, buckets: int = 10_000) -> DataFrame:
    """70/15/15 within each label by a fixed pseudo-random order of the key.

    Ranks come from buckets of the order whose sizes are prefix-summed, so no
    label is ranked in one task.
    """
    h = F.pmod(F.col(key) * 7919 + 104_729, F.lit(1_000_003))
    d = df.withColumns({"_h": h, "_b": F.floor(h / (1_000_003 / buckets)).cast("int")})
    sizes = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.select(label, "_b", (F.sum("_c").over(Window.partitionBy(label).orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1).join(F.broadcast(before), [label, "_b"])
    share = (F.col("_r") + F.col("_before")) / F.col("_n")
    return d.withColumn("split", F.when(share < train, "train").when(share < train + val, "val").otherwise("test")).drop("_h", "_b", "_r", "_before", "_n")


def step_split(df: DataFrame, step: str) -> DataFrame:
    """By time step against the largest: to 70 %, to 85 %, beyond."""
    top = df.agg(F.max(step).alias("_top"))
    share = F.col(step) / F.col("_top")
    return df.join(F.broadcast(top)).withColumn("split", F.when(share <= 0.70, "train").when(share <= 0.85, "val").otherwise("test")).drop("_top")


def hash_split(key: Column, train: int = 70, val: int = 15) -> Column:
    h = stable_hash(key) % 100
    return F.when(h < train, "train").when(h < train + val, "val").otherwise("test")


def subsample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same n rows every time (a sampling operator)."""
    return df.orderBy(stable_hash(F.col(key)), key).limit(n)


def recent(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(limit)


def label_candidates(labels: DataFrame, used: DataFrame | None = None, least: float = 0.40) -> DataFrame:
    """Labels not used yet, of enough weight, in order: chargeback, human, others; the heavier first.

    ``label`` is the first there is of ``chargeback_label``, ``human_label`` and
    ``llm_label``; rows without any are left out. Used are the rows of ``used``
    or those marked ``included_in_training``.
    """
    kinds = [c for c in ("chargeback_label", "human_label", "llm_label") if c in labels.columns]
    rows = labels.withColumn("label", F.coalesce(*kinds)).where(F.col("label").isNotNull() & (F.col("weight") >= least))
    if "included_in_training" in labels.columns:
        rows = rows.where(~F.coalesce("included_in_training", F.lit(False)))
    if used is not None:
        rows = rows.hint("merge").join(used.select("transaction_id"), "transaction_id", "left_anti")
    rank = F.when(F.col("source") == "chargeback", 1).when(F.col("source") == "human", 2).otherwise(3)
    return rows.withColumn("priority", rank).orderBy("priority", F.desc("weight"), "transaction_id")


def merge_last(training: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name in which the later batch wins for each transaction."""
    both = training.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy("transaction_id").orderBy(F.desc("_batch"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_batch")


def ingest_labels(training: DataFrame, labels: DataFrame, least: int = 100, weight: float = 0.40) -> tuple[DataFrame, DataFrame]:
    """Training rows with the new labels merged in, and the labels with those that were used marked.

    A candidate's ``features_json`` is read in the training table's types (a
    text that is no JSON object leaves it out), with ``is_fraud`` from its label
    and its ``sample_weight`` and ``label_source``. With fewer than ``least``
    candidates nothing changes: labels go on gathering.
    """
    some = label_candidates(labels, None, weight)
    enough = some.agg((F.count(F.lit(1)) >= least).alias("_enough"))
    some = some.join(F.broadcast(enough)).where("_enough").drop("_enough")
    own = {"is_fraud", "sample_weight", "label_source", "transaction_id"}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in training.schema if f.name not in own)
    read = F.from_json("features_json", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}) if fields else F.struct(F.lit(0).alias("_none"))
    valid = F.get_json_object("features_json", "$").startswith("{")
    new = some.where(valid).select("transaction_id", read.alias("_f"), F.col("label").cast("int").alias("is_fraud"), F.col("weight").cast("double").alias("sample_weight"), F.col("source").alias("label_source"))
    new = new.select("transaction_id", "is_fraud", "sample_weight", "label_source", *([f"_f.`{f.name}`" for f in training.schema if f.name not in own]))
    used = some.select("transaction_id", F.lit(True).alias("_used"))
    marked = labels.hint("merge").join(used, "transaction_id", "left").withColumn("included_in_training", F.coalesce("_used", "included_in_training", F.lit(False))).drop("_used")
    return merge_last(training, new), marked


def aligned_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by ``order``; amounts above 0 only."""
    return df.where("amount_usd > 0").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def champion(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the best metric, ties to the smaller name."""
    return runs.agg(F.max(F.struct(F.col(metric).alias("m"), F.col("run").alias("r"))).alias("x"), F.min_by("run", F.struct(-F.col(metric), F.col("run"))).alias("champion")).select("champion", F.round("x.m", 6).alias(metric))
