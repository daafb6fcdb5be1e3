"""Corpus preparation: quality, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes the rows that its predecessor kept and returns rows with the
columns of ``documents`` (the last: the token results). Rows keep their other
columns, whatever their names; rows with null or repeated ids are told apart
by a number where rows must be singled out.

Defined cases, in every stage: a null text counts as empty; an empty table gives
an empty table; texts of any length are taken whole, the longest by themselves.
What becomes of null and empty texts stands with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.byte_bpe import encode_decode
from riskweave.llm.common import Scratch, numbered, without
from riskweave.llm.decontamination import contained_items
from riskweave.llm.near_dup import near_duplicates
from riskweave.llm.quality import fit, score_column
from riskweave.llm.substring_dedup import substring_dedup

def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _as_documents(rows: DataFrame, key: str) -> DataFrame:
    """What an operator needs of the rows, the row's number for its id."""
    return rows.select(F.col(key).alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 and more). Null and empty texts are scored like any; without labels of both classes all rows have one score."""
    model, score = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _free(docs, "_quality")
    return score_column(docs, model, score).where(F.col(score) >= 0.3).select(*_columns(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of the smallest id. Texts without words are linked with nothing and stay."""
    scratch, key = Scratch(spark), _free(docs, "_rid")
    rows = numbered(docs, scratch, key)
    gone = near_duplicates(_as_documents(rows, key), shingle_words=5, percent=80).where("NOT first").select(F.col("rid").alias(key))
    return without(rows, scratch.write(gone, "gone"), key).select(*_columns(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur again; ``n_chars`` follows the text. A text that loses nothing stays as it is, null included; one that loses all becomes empty and stays."""
    scratch, key, kept = Scratch(spark), _free(docs, "_rid"), _free(docs, "_kept")
    rows = numbered(docs, scratch, key)
    found = substring_dedup(_as_documents(rows, key), with_text=True).where("n_removed > 0")
    changed = scratch.write(found.select(F.col("doc_id").alias(key), F.col("kept_text").alias(kept)), "changed")
    both = rows.hint("merge").join(changed, key, "left")
    new = {"text": F.coalesce(F.col(kept), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.char_length(F.col(kept))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.withColumns(new).select(*_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't contain a benchmark item. Texts without words contain none; items without words are in none."""
    scratch, key = Scratch(spark), _free(docs, "_rid")
    rows = numbered(docs, scratch, key)
    found = contained_items(_as_documents(rows, key), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = scratch.write(found.select(F.col("doc_id").alias(key)).distinct(), "gone")
    return without(rows, gone, key).select(*_columns(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their hash and that of the decoded text. Null and empty texts have no ids."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: The classifier and the tokenizer have no SQL form; tests compare the rows and texts of each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, which cuts lineage."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs
