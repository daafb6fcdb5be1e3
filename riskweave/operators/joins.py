"""Lookups, label upserts, semi and anti joins, interval pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, MapType, StringType, StructType

from ..functions.records import embedding_or_zero

#: Bounds of a side that is broadcast; both are counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def width(kind: DataType, value: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType, MapType)):
            return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 16
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, (StructType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 16
    return F.lit(16 if isinstance(kind, DecimalType) else 8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within both bounds; reads no more rows than the first of them and one."""
    total = sum((width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0))
    n, most = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(total.cast("long"))).first()
    return n <= rows and (most or 0) <= size


def lookup(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if counted small in rows and bytes, else for a shuffle."""
    return F.broadcast(small) if is_small(small) else small.hint("merge")


def with_embedding(df: DataFrame, embeddings: DataFrame, key: str, size: int) -> DataFrame:
    """Embedding by key, zeros on a miss or a wrong length, and whether it was a hit."""
    e = embeddings.select(F.col("id").alias(key), F.col("features").alias("_e"))
    out = df.join(lookup(e), key, "left")
    hit = F.col("_e").isNotNull() & (F.size("_e") == size)
    return out.withColumns({"embedding_hit": hit.cast("int"), "embedding": F.coalesce(embedding_or_zero(F.col("_e"), size), F.array_repeat(F.lit(0.0), size))}).drop("_e")


def coverage(df: DataFrame, hit: str = "embedding_hit", least: float = 0.10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("hit_rate"), (F.avg(hit) < least).alias("warning"))


def features_with_classes(features: DataFrame, classes: DataFrame) -> DataFrame:
    return features.hint("merge").join(classes, "id", "left")


def review_candidates(scored: DataFrame, labels: DataFrame, since: Column, below: float = 50_000.0, limit: int = 500) -> DataFrame:
    """Unlabelled reviews from ``since`` on (a literal, so the filter reaches the files) below an amount, highest scores first (``limit`` is the report's length)."""
    recent = scored.where((F.col("decision") == "review") & (F.col("ts") >= since) & (F.col("amount_usd") < below))
    return recent.hint("merge").join(labels.select("transaction_id"), "transaction_id", "left_anti").orderBy(F.desc("risk_score"), "transaction_id").limit(limit)


def insert_absent(store: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The store with the batch rows whose ids it lacks; of several in the batch the first by ``order``."""
    first = Window.partitionBy("transaction_id").orderBy(order)
    one = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return store.unionByName(one.hint("merge").join(store.select("transaction_id"), "transaction_id", "left_anti"))


def apply_chargebacks(labels: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """Labels that have no chargeback yet take the reported one, with its source and full weight."""
    c = chargebacks.groupBy("transaction_id").agg(F.max("is_fraud").alias("_new"))
    both = labels.hint("merge").join(c, "transaction_id", "left")
    take = F.col("chargeback_label").isNull() & F.col("_new").isNotNull()
    return both.withColumns({"source": F.when(take, "chargeback").otherwise(F.col("source")), "weight": F.when(take, 1.0).otherwise(F.col("weight")), "chargeback_label": F.coalesce("chargeback_label", "_new")}).drop("_new")


def evaluation_rows(scored: DataFrame, labels: DataFrame, confident: float = 0.80, least: int = 50) -> DataFrame:
    """Scores with trusted labels: a chargeback, or a confident reviewer; none at all if they are fewer than ``least``."""
    both = scored.select("transaction_id", "risk_score").hint("merge").join(labels, "transaction_id")
    rows = both.where(F.col("chargeback_label").isNotNull() | (F.col("confidence") >= confident)).withColumn("label", F.coalesce("chargeback_label", "llm_label"))
    return rows.join(F.broadcast(rows.agg((F.count(F.lit(1)) >= least).alias("_enough")))).where("_enough").drop("_enough")


def recycled_receiver(df: DataFrame, among: Column) -> DataFrame:
    """Flag of rows whose receiver both sends and receives among the rows of a source."""
    some = df.where(among)
    both = some.select(F.col("src").alias("dst")).intersect(some.select("dst")).withColumn("recycled", F.lit(1))
    return df.join(lookup(both), "dst", "left").fillna(0, ["recycled"])


def illicit_neighbours(nodes: DataFrame, edges: DataFrame, illicit: str = "1") -> DataFrame:
    """How many distinct edges link a node, in either direction, with illicit nodes."""
    from .graph import undirected

    bad = nodes.where(F.col("class") == illicit).select(F.col("id").alias("dst"))
    n = undirected(edges).join(lookup(bad), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("illicit_neighbours"))
    out = nodes.hint("merge").join(n, "id", "left").fillna(0, ["illicit_neighbours"])
    return out.withColumn("has_illicit_neighbour", (F.col("illicit_neighbours") > 0).cast("int"))


def expand_frontier(edges: DataFrame, seeds: DataFrame, most: int, fraud_share: float = 0.7) -> DataFrame:
    """Receivers one step beyond the seeds (``id, near_fraud``): near fraud if any sender is.

    At most ``most`` of them, of which at most ``fraud_share`` near fraud, smallest ids first.
    """
    step = edges.select("src", F.col("dst").alias("id")).join(lookup(seeds.select(F.col("id").alias("src"), "near_fraud")), "src")
    new = step.join(lookup(seeds.select("id")), "id", "left_anti").groupBy("id").agg(F.max("near_fraud").alias("near_fraud"))
    bad = new.where("near_fraud = 1").orderBy("id").limit(int(most * fraud_share))
    good = new.where("near_fraud = 0").orderBy("id").limit(most - int(most * fraud_share))
    return bad.unionByName(good)


def active_subgraph(edges: DataFrame, active: DataFrame) -> DataFrame:
    """Edges with an active end: two semi joins, the second for edges the first left out (an OR would be a nested loop)."""
    src = edges.join(lookup(active.select(F.col("id").alias("src"))), "src", "left_semi")
    rest = edges.join(lookup(active.select(F.col("id").alias("src"))), "src", "left_anti")
    return src.unionByName(rest.join(lookup(active.select(F.col("id").alias("dst"))), "dst", "left_semi"))


def resolve_wallets(legit: DataFrame, fraud: DataFrame, most: int = 2000) -> DataFrame:
    """Distinct legitimate wallets that are no fraud seeds, at most ``most`` by id."""
    return legit.select("id").distinct().join(lookup(fraud.select("id").distinct()), "id", "left_anti").orderBy("id").limit(most)


def fiat_crypto_pairs(df: DataFrame, minutes: int = 15) -> DataFrame:
    """Fiat rows followed by crypto rows of the identity within ``minutes``.

    An equi-join on identity and time slot: the crypto row's slot is the fiat
    row's or the next, so no identity is joined with itself as a whole.
    """
    width = minutes * 60_000_000
    slot = F.floor(F.col("ts_us") / F.lit(width)).cast("long")
    fiat = df.where("modality = 'fiat'").select("identity", F.col("transaction_id").alias("fiat_id"), F.col("ts_us").alias("f_us"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    crypto = df.where("modality = 'crypto'").select("identity", F.col("transaction_id").alias("crypto_id"), F.col("ts_us").alias("c_us"), slot.alias("slot"))
    both = fiat.hint("merge").join(crypto, ["identity", "slot"]).where((F.col("c_us") >= F.col("f_us")) & (F.col("c_us") <= F.col("f_us") + width))
    return both.select("identity", "fiat_id", "crypto_id", F.round((F.col("c_us") - F.col("f_us")) / F.lit(1_000_000).cast("double"), 3).alias("seconds"))


def threshold_grid(spark, first: float = 0.05, steps: int = 90, width: float = 0.01) -> DataFrame:
    """90 thresholds, a table of fixed size."""
    return spark.range(steps).select(F.round(F.lit(first) + F.col("id") * width, 2).alias("threshold"))
