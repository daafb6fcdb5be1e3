"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast (longs and short structs: a few MB). Sides are counted first.
BROADCAST_ROWS = 200_000
#: Bytes of text that a task turns into Python objects at once.
TEXT_BYTES = 1 << 21

#: Spark's setting for removing shuffle files at the end of an execution.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts lineage: a lost executor costs its running tasks, not
    the work before the table. Where it is unset, a local master (tests) gets a
    temporary folder; on a cluster that is an error, as executors couldn't see it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="riskweave-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.base = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the same columns.

        Nothing reads the write's shuffle files once the table is there, so they
        are removed at its end: the disk holds those of one write at a time.
        """
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
        """Like ``write``, with the rows dealt to ``buckets`` files by ``key``: joins on it shuffle the other side alone.

        Spark knows buckets from its catalog only. The entry is needed to read the
        table once and removed then; the files stay.
        """
        table = f"riskweave_{uuid.uuid4().hex}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            dealt = df.repartition(buckets, key).sortWithinPartitions(key)
            dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", self.path(name)).saveAsTable(table)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(conf).delete(where, True)


def bounded(batches: Iterator[pa.RecordBatch], text: int, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes in column ``text`` (a longer value comes alone)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def text_of(docs: DataFrame) -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")


def id_of(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long").alias("doc_id")


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``rid, doc_id, text`` with a ``rid`` that no two rows share, and whether rows had to be numbered.

    ``doc_id`` serves where it is unique and not null (a count over that one
    column decides). Else rows get numbers, kept stable by a written table.
    """
    ids = docs.select(id_of(docs))
    repeated = ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    rows = docs.select(id_of(docs), text_of(docs))
    if not repeated:
        return rows.select(F.col("doc_id").alias("rid"), "doc_id", "text"), False
    return scratch.write(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "keyed"), True


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that many."""
    return df.limit(limit + 1).count() <= limit


def light(df: DataFrame, column: str, size: int = 32 << 20) -> bool:
    """``small``, and the texts of one column within ``size`` bytes together."""
    return small(df) and (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) <= size


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, scratch: Scratch, name: str = "_rid") -> DataFrame:
    """``docs`` with a column ``name`` that no two rows share; like ``keyed``, but with all columns kept."""
    repeated = docs.select(id_of(docs)).groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not repeated:
        return docs.withColumn(name, docs["doc_id"].cast("long"))
    return scratch.write(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame, name: str = "_rid") -> DataFrame:
    """``rows`` whose ``name`` isn't in ``gone`` (one column); broadcast only if counted small."""
    return rows.join(F.broadcast(gone) if small(gone) else gone.hint("merge"), name, "left_anti")
