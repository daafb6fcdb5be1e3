"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents long, so resemblance says little; containment of the
item's five-word shingles in the document's does. Items fall into partitions by
size (powers of two); each partition has its own sketch length, and an item
keeps that many of its smallest shingle hashes (a bottom-k MinHash sketch). The
length is the number of shingles that may be missing at the largest size of the
partition, plus one: a document with ``share`` of an item holds at least one
sketch value, so the candidate search loses nothing. Candidates are verified by
exact containment of shingle texts. DataFrame functions only.

Defined cases: null, empty and blank texts hold nothing; an item of fewer than
five words is one shingle of all its words, looked for at that width; equal
items are reported each; repeated document rows are reported each; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keyed, small

WORDS = 5
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BLANKS), "")


def _each(words: str, width: int | Column, make) -> Column:
    """``make`` of every run of ``width`` words."""
    width = F.lit(width) if isinstance(width, int) else width
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: make(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, some).otherwise(F.slice(some, 1, 0))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, width, n_shingles, hashes, texts``: a row for each benchmark row with words."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words_of(F.coalesce(benchmark["text"].cast("string"), F.lit(""))).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()).withColumn("width", F.least(F.size("w"), F.lit(WORDS)))
    rows = rows.withColumn("texts", F.array_distinct(_each("w", F.col("width"), lambda s: F.array_join(s, " "))))
    hashes = F.array_sort(F.array_distinct(_each("w", F.col("width"), F.xxhash64)))
    return rows.select("item_id", "item", "width", F.size("texts").alias("n_shingles"), hashes.alias("hashes"), "texts")


def sketches(items: DataFrame, share: float) -> DataFrame:
    """``width, hash, item``: the bottom-k sketch of every item, k by its size partition."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    length = largest - F.ceil(largest * share - 1e-9) + 1
    return items.select("width", "item", F.explode(F.slice("hashes", 1, F.least(length.cast("int"), F.size("hashes")))).alias("hash"))


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` for pairs of at least ``share``, and ``rid``."""
    scratch = Scratch(docs.sparkSession)
    rows, _ = keyed(docs, scratch)
    items = scratch.write(item_shingles(benchmark), "items")
    sketch = scratch.write(sketches(items, share), "sketches")
    bounded = small(sketch)  # a benchmark beyond this size is joined by a shuffle
    words = rows.select("rid", words_of(F.col("text")).alias("w"))
    probes = None
    for width in sorted(r["width"] for r in items.select("width").distinct().collect()):  # one, or up to five with very short items
        here = sketch.where(F.col("width") == width).select("hash", "item")
        grams = words.select("rid", F.explode(_each("w", width, F.xxhash64)).alias("hash"))
        found = grams.join(F.broadcast(here) if bounded else here.hint("shuffle_hash"), "hash").select("rid", "item")
        probes = found if probes is None else probes.unionByName(found)
    if probes is None:
        probes = rows.where(F.lit(False)).select("rid", F.lit(0).cast("long").alias("item"))
    pairs = scratch.write(probes.distinct(), "candidates")

    some = F.broadcast(pairs) if small(pairs) else pairs.hint("merge")
    both = rows.join(some, "rid").select("rid", "doc_id", "item", words_of(F.col("text")).alias("w"))
    about = items.select("item", "item_id", "width", "n_shingles", "texts")
    both = both.join(F.broadcast(about) if bounded else about.hint("merge"), "item")
    held = F.size(F.array_intersect("texts", _each("w", F.col("width"), lambda s: F.array_join(s, " "))))
    both = both.select("doc_id", "item_id", "n_shingles", held.alias("n_found"), "rid")
    both = both.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return both.where(F.col("n_found") >= F.ceil(F.col("n_shingles") * share - 1e-9)).select("doc_id", "item_id", "n_shingles", "n_found", "containment", "rid")
