"""Readers, writers and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a temporary one; a cluster must set it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there."""
    folder = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Folders of this process's ``saved`` tables.
_FOLDERS: list[str] = []


def clear_saved(spark: SparkSession) -> int:
    """Remove all tables that ``saved`` has written in this process, once no DataFrame reads them any more; returns how many."""
    make, conf, n = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), len(_FOLDERS)
    while _FOLDERS:
        where = make(_FOLDERS.pop())
        where.getFileSystem(conf).delete(where, True)
    return n


def newest_version(spark: SparkSession, folder: str, part: str = "") -> int:
    """The largest number among the folders ``version=<number>`` that hold a finished ``part``; an error if there is none. Lists names only."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    files = make(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(make(folder))]
    done = [n for n in found if n.startswith("version=") and (not part or files.exists(make(f"{folder}/{n}/{part}/_SUCCESS")))]
    return max(int(n.partition("=")[2]) for n in done)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, escape='"')


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Quotes within a text are doubled, which ``read_csv`` undoes."""
    df.write.mode("overwrite").csv(path, header=header, escape='"')


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Bulk-load node rows: key, archetype (the least of a node's roles) and label."""
    # Roles as numbers: a minimum of texts would sort all edges.
    ends = edges.select(F.col("src").cast("string").alias("id"), F.lit(0).alias("role")).unionByName(edges.select(F.col("dst").cast("string"), F.lit(1)).toDF("id", "role"))
    return ends.groupBy("id").agg(F.min("role").alias("role")).select(F.col("id").alias("hash:ID"), F.when(F.col("role") == 0, "sender").otherwise("receiver").alias("archetype"), F.lit("Identity").alias(":LABEL"))


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("string").alias(":START_ID"), F.col("dst").cast("string").alias(":END_ID"), F.lit("SENT_TO").alias(":TYPE"), F.col("amount").alias("amount_usd:double"), (F.col("is_fraud") == 1).alias("is_fraud:boolean"))


TRANSFER = "`from` string, `to` string, value double, asset string, hash string, metadata struct<blockTimestamp: string>"


def parsed_transfers(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``json`` lines as transfers and the lines that are none (dead letters)."""
    d = lines.withColumn("t", F.from_json("json", TRANSFER))
    good = F.col("t.hash").isNotNull() & F.col("t.from").isNotNull() & F.col("t.to").isNotNull()
    return d.where(good).select("t.*"), d.where(~good | good.isNull()).select("json")


def transfer_rows(transfers: DataFrame, label: str, usd: float = 2800.0) -> DataFrame:
    """Flat transaction rows: lower-case addresses hashed to identities, value in USD, label from the seed's kind."""
    sender, receiver = F.lower("from"), F.lower("to")
    return transfers.select(
        F.col("hash").alias("transaction_id"), F.to_timestamp("metadata.blockTimestamp").alias("timestamp"), F.sha2(sender, 256).alias("sender_wallet_hash"), F.sha2(receiver, 256).alias("receiver_wallet_hash"),
        (F.col("value") * usd).alias("amount_usd"), F.col("asset").alias("cryptocurrency"), F.lit("crypto").alias("modality"), F.lit(int(label != "legit")).alias("is_fraud"), F.lit(f"alchemy_{label}").alias("source"),
    )


def transfer_edges(transfers: DataFrame, depth: int, near_fraud: bool, usd: float = 2800.0) -> DataFrame:
    """Edge rows with depth and proximity to fraud, and no label column."""
    out = transfers.select(F.sha2(F.lower("from"), 256).alias("src"), F.sha2(F.lower("to"), 256).alias("dst"), (F.col("value") * usd).alias("amount"), F.col("hash").alias("transaction_id"), F.lit(depth).alias("depth"), F.lit(near_fraud).alias("fraud_proximity"))
    assert not {"is_fraud", "label"} & set(out.columns)
    return out
