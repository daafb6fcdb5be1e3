"""Views of the domain over the test tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; Spark fails at once if it is absent."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def at(us: int) -> Column:
    """The zoneless timestamp of so many microseconds since 1970, as a constant."""
    return F.expr(f"timestampadd(MICROSECOND, {us}L, {EPOCH})")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_of(table(spark, sf_dir, "events"))


def txn_of(e: DataFrame) -> DataFrame:
    """Transactions from rows of ``events``, of a table or a stream."""
    client = F.when(F.col("event_type").isin("signup", "purchase"), "neobank").when(F.col("event_type").isin("click", "view"), "cryptoex").otherwise("finbridge")
    k = F.get_json_object("props", "$.k").cast("long")
    fraud = (F.col("event_id") % 37 == 0).cast("int")
    return e.select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("transaction_id"), "event_id", F.col("user_id").alias("identity"), client.alias("client_id"),
        F.when(F.col("event_type").isin("signup", "purchase", "error"), "fiat").otherwise("crypto").alias("modality"),
        F.col("value").alias("amount_usd"), "ts", micros("ts").alias("ts_us"), k.alias("k"), fraud.alias("is_fraud"),
        ((F.col("event_id") * 7919 % 1000 + 300 * fraud) / F.lit(1300).cast("double")).alias("risk_score"),
        ((F.col("user_id") * 7 + k) % 150).alias("receiver"), "props", "event_type",
    )


TXN = """txn AS (
  SELECT 'evt_' || event_id AS transaction_id, event_id, user_id AS identity,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'neobank' WHEN event_type IN ('click', 'view') THEN 'cryptoex' ELSE 'finbridge' END AS client_id,
    CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'fiat' ELSE 'crypto' END AS modality,
    value AS amount_usd, ts, epoch_us(ts) AS ts_us, (props::JSON ->> '$.k')::BIGINT AS k, (event_id % 37 = 0)::INTEGER AS is_fraud,
    (event_id * 7919 % 1000 + 300 * (event_id % 37 = 0)::INTEGER) / 1300::DOUBLE AS risk_score,
    (user_id * 7 + (props::JSON ->> '$.k')::BIGINT) % 150 AS receiver, props, event_type
  FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.decisions import decide

    return txn(spark, sf_dir).withColumn("decision", decide(F.col("risk_score"), 0.30, 0.80))


SCORED = (
    TXN
    + """, scored AS (
  SELECT *, CASE WHEN risk_score < 0.30 THEN 'approve' WHEN risk_score > 0.80 THEN 'block' ELSE 'review' END AS decision FROM txn),
latest AS (SELECT max(ts_us) AS now FROM txn)"""
)


def labels_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth transaction has a label; the source goes by the id, confidence between 0 and 0.98."""
    t = txn(spark, sf_dir).where("event_id % 5 = 0")
    source = F.when(F.col("event_id") % 3 == 0, "chargeback").when(F.col("event_id") % 3 == 1, "human").otherwise("llm")
    return t.select("transaction_id", "event_id", source.alias("source"), (F.col("event_id") % 50 / F.lit(50).cast("double")).alias("confidence"), F.col("is_fraud").alias("llm_label"), F.when(source == "chargeback", F.col("is_fraud")).alias("chargeback_label"))


LABELS = """labels_tbl AS (
  SELECT transaction_id, event_id, CASE event_id % 3 WHEN 0 THEN 'chargeback' WHEN 1 THEN 'human' ELSE 'llm' END AS source,
    event_id % 50 / 50::DOUBLE AS confidence, is_fraud AS llm_label, CASE WHEN event_id % 3 = 0 THEN is_fraud END AS chargeback_label
  FROM txn WHERE event_id % 5 = 0)"""


def edges_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select(F.col("event_id").alias("edge_id"), F.col("identity").alias("src"), F.col("receiver").alias("dst"), F.col("amount_usd").alias("amount"), "is_fraud", "modality", "ts_us", "client_id")


EDGES_TXN = TXN + ", edges AS (SELECT event_id AS edge_id, identity AS src, receiver AS dst, amount_usd AS amount, is_fraud, modality, ts_us, client_id FROM txn)"


def edges_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # A given number of partitions: keys compress so well that Spark would merge those of ten million rows into a task, which sorts them.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = li.repartition(n, "l_orderkey").hint("merge").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_extendedprice").alias("amount"), micros("o_orderdate").alias("ts_us"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        F.when(F.col("l_linestatus") == "O", "fiat").otherwise("crypto").alias("modality"), (F.col("l_partkey") % 50).alias("network"),
    )


EDGES_ORDER = """edges AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_extendedprice AS amount, epoch_us(o_orderdate) AS ts_us,
    (l_returnflag = 'R')::INTEGER AS is_fraud, CASE WHEN l_linestatus = 'O' THEN 'fiat' ELSE 'crypto' END AS modality, l_partkey % 50 AS network
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def nodes_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") == 0, "1").when(F.col("label") <= 5, "2").otherwise("unknown")
    return n.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), kind.alias("class"), (F.col("vec_id") % 49 + 1).alias("step"))


NODES_VEC = """nodes AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS features, CASE WHEN label = 0 THEN '1' WHEN label <= 5 THEN '2' ELSE 'unknown' END AS class, vec_id % 49 + 1 AS step
  FROM embeddings)"""


def edges_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    return n.select("src", F.explode(F.array((F.col("src") * 13 + 7) % 500, (F.col("src") + 1) % 500)).alias("dst"))


EDGES_VEC = "edges AS (SELECT vec_id AS src, unnest([(vec_id * 13 + 7) % 500, (vec_id + 1) % 500]) AS dst FROM embeddings)"
