"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import ngram_join, packing, quality_classifier, rule_ledger, substring_dedup
from voxloom.support import materialize, shared_dir

#: Version of the rule policy that filters, and the tokenizer that packs.
POLICY, TOKENIZER = "v1", "word_bpe_49k.json"


def free_name(docs: DataFrame, wish: str) -> str:
    """A column name that the documents do not have."""
    while wish.lower() in {c.lower() for c in docs.columns}:
        wish = f"_{wish}"
    return wish


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model learns from the labelled rows among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose failure bits hold none of the policy's."""
    prefix = "rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    measured = rule_ledger.measure(docs, prefix=prefix)
    bits = rule_ledger.failure_bits(prefix).bitwiseAND(F.lit(rule_ledger.POLICIES[POLICY]).cast("long"))
    return measured.where(bits == 0).select(*docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, one of those if several have it.

    A null doc_id counts as the smallest.
    """
    row = free_name(docs, "row")
    # numbers of rows are written down: they must be the same in the join and here
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = (ngram_join.join(numbered, row=row).where("uid <> class_uid")
            .select(F.col("uid").alias(row)).hint("merge"))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that start earlier, in another document or the same; n_chars follows, if any."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # in a struct, no column of the documents meets one that the operator adds
    kept = substring_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("other")))
    columns = {c: F.col(f"other.`{c}`") for c in others} | {c: F.col(c) for c in ("doc_id", "text")}
    if "n_chars" in others:
        length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("other.n_chars"))
        columns["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens along the space-filling curve."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_filter),
    ("quality rules", rule_filter),
    ("n-gram join", near_duplicate_filter),
    ("substring dedup", repeat_filter),
    ("packing", packed),
]

#: Compression, trained here, and tokenization have no SQL form; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
