"""Streaming forms without keyed state of their own: windows, joins, sinks; those with it are in ``processors``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .processors import LATE


def with_embeddings(stream: DataFrame, embeddings: DataFrame, size: int) -> DataFrame:
    """Each row with its identity's embedding of the store (zeros on a miss): a join of the stream with a table."""
    from ..operators.joins import with_embedding

    return with_embedding(stream, embeddings, "identity", size)


def alert_limit_tumbling(alerts: DataFrame, most: int = 30) -> DataFrame:
    """The simple cap: the first ``most`` alerts of a channel in each minute."""
    from pyspark.sql import Window

    minute = F.floor(F.col("ts_us") / F.lit(60_000_000)).cast("long")
    rank = F.row_number().over(Window.partitionBy("channel", minute).orderBy("ts_us", "alert_id"))
    return alerts.withColumn("accepted", rank <= most)


def live_windows(scored: DataFrame, width: str = "5 minutes", step: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Counts, blocks, mean score by sliding window; streams need their watermark set first."""
    return scored.groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "block").alias("blocked"), F.round(F.avg("risk_score"), 4).alias("mean_score"))


def hourly_windows(scored: DataFrame, ts: str = "ts") -> DataFrame:
    return scored.groupBy(F.window(ts, "1 hour").alias("w"), "client_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "block").alias("blocked"))


def session_bursts(df: DataFrame, gap: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Rows and volume of each session of an identity."""
    return df.groupBy("identity", F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("amount_usd").cast("decimal(18,4)")).cast("double"), 2).alias("volume"))


def duplicate_guard(stream: DataFrame, key: str = "transaction_id", within: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """The first row of each key within the watermark; ``answered`` gives repeats the first row's answer instead."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def interval_join(fiat: DataFrame, crypto: DataFrame, minutes: int = 15) -> DataFrame:
    """Fiat rows with crypto rows of the identity in the next minutes; both sides watermarked, so state is dropped."""
    f, c = fiat.withWatermark("ts", LATE).alias("f"), crypto.withWatermark("ts", LATE).alias("c")
    when = (F.col("c.ts") >= F.col("f.ts")) & (F.col("c.ts") <= F.col("f.ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return f.join(c, (F.col("f.identity") == F.col("c.identity")) & when).select("f.identity", F.col("f.transaction_id").alias("fiat_id"), F.col("c.transaction_id").alias("crypto_id"))


def fan_out(out: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: results, alerts (block and review only) and analytics from one kept batch.

    Folders are by batch and overwritten, so a repeated batch changes nothing.
    The results are written first; the other sinks read them back, so the batch
    is worked out once and a lost executor loses nothing that is kept in memory.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        done = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/results/batch={number}")
        done.where("decision IN ('block', 'review')").write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        done.write.mode("overwrite").parquet(f"{out}/analytics/batch={number}")

    return write


def node_store(out: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over edges: each micro-batch's node totals are added to a stored table of totals.

    The store is cut into ``buckets`` by a hash of the id; a batch reads and writes
    those that its nodes fall into, each as a new folder ``batch=<number>``. Which
    bucket was written by which batch stands in ``marks``, written last: a batch
    that is repeated starts from the batches before it, so it changes nothing, and
    one that broke off isn't read. ``stored_nodes`` reads the newest of each bucket.
    """
    from ..operators.graph import node_totals, upsert_nodes

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        delta = node_totals(batch.select("src", "dst", "amount", "ts_us"), exact=True)
        placed = delta.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        placed.write.mode("overwrite").parquet(f"{out}/delta/batch={number}")
        placed = spark.read.schema(placed.schema).parquet(f"{out}/delta/batch={number}")
        met = placed.select("bucket").distinct()
        before = stored_nodes(spark, out, placed.schema, number)
        if before is None:
            after = placed
        else:
            after = upsert_nodes(before.join(F.broadcast(met), "bucket", "left_semi"), placed)  # at most ``buckets`` rows
            after = after.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        after.withColumn("of", F.col("bucket")).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("of").parquet(f"{out}/store/batch={number}")
        met.write.mode("overwrite").parquet(f"{out}/marks/batch={number}")

    return write


def stored_nodes(spark: SparkSession, out: str, schema: StructType, before: int | None = None) -> DataFrame | None:
    """The totals of a ``node_store``: of every bucket what its newest batch (before ``before``) wrote; None if there is none."""
    if before == 0:
        return None
    marks = spark.read.schema("bucket int, batch int").parquet(f"{out}/marks")
    newest = (marks if before is None else marks.where(F.col("batch") < before)).groupBy("bucket").agg(F.max("batch").alias("batch"))
    folders = StructType([*schema.fields]).add("batch", IntegerType()).add("of", IntegerType())
    read = spark.read.schema(folders).parquet(f"{out}/store")
    return read.join(F.broadcast(newest), ["bucket", "batch"], "left_semi").drop("of", "batch")


def parsed_stream(lines: DataFrame, schema: str) -> DataFrame:
    """``json`` lines as ``row`` (null: no record of the schema), for ``dead_letters``."""
    return lines.withColumn("row", F.from_json("json", schema))


def dead_letters(out: str, good: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``parsed_stream``: records for which the SQL condition ``good`` holds to ``out/rows``, other lines to ``out/dead``."""

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(F.expr(good), F.lit(False))
        batch.where(ok).select("row.*").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        batch.where(~ok).select("json").write.mode("overwrite").parquet(f"{out}/dead/batch={number}")

    return write


def refresh_embeddings(out: str, nodes: DataFrame, edges: DataFrame, projections: str, hops: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over rows with a node ``id``: the embeddings of the neighbourhood of the nodes that were active in the batch, written anew.

    The projection is the newest of the folder ``projections``; nothing is fitted.
    Run with a trigger of 60 s, or ``availableNow`` on a schedule. Each batch has
    a folder of its own, overwritten if it is repeated; readers take each node's
    newest row.
    """
    from ..operators.graph import hop_features_of, load_projection, neighbourhood, projected

    def write(batch: DataFrame, number: int) -> None:
        near = neighbourhood(edges, batch.select("id").distinct(), hops)
        fresh = projected(load_projection(batch.sparkSession, projections), hop_features_of(edges, nodes, near))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def run_to_end(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run ``stream`` over all there is, into Parquet files or through a ``foreachBatch`` function; returns the folder of the rows."""
    where = f"{folder}/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{where}/rows")
    writer.start().awaitTermination()
    return f"{where}/rows"
