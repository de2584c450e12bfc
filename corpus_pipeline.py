"""A corpus pipeline of five stages over documents: (name, function) pairs, each function from (spark, docs, sf_dir) to a DataFrame.

run() applies them to documents; each stage's rows are written as Parquet in the shared folder and reread as the next
one's docs. All but the last return the columns of documents; doc_id says which documents are left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm.decontamination import decontaminated
from motifold.llm.language_id import UNKNOWN, identified, learn
from motifold.llm.near_dedup import near_duplicate_heads, row_key
from motifold.llm.pii_crf import learned_field, redact
from motifold.llm.queries import MODEL_PATH
from motifold.llm.sentencepiece_lattice import encoded, load_model
from motifold.llm.shared import free_name, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: profiles are learned from all labelled rows; null texts, and those without a
    letter, go. lang is the predicted language, however low its score; ties go to the first by name. Repeated rows get
    equal answers, and all stay; other columns, whatever their names, are unchanged. Without a labelled row, all texts go."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    kept = identified(docs, learn(docs), lang, score).where(F.col(lang) != UNKNOWN)
    return kept.withColumn("lang", F.col(lang)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, nulls last, then by a hash of its text;
    of rows that repeat both, one. Texts without a word are no duplicates: those with an id are kept once for each id,
    those without one all stay. Columns of any name are carried along."""
    told = near_duplicate_heads(docs)
    key = free_name(docs, "row_key")
    kept = told.where("key = head.key").select(F.col("key").alias(key)).distinct()
    free = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(~free).withColumn(key, row_key()).join(kept, key, "left_semi").dropDuplicates([key])
    return rows.select(docs.columns).union(docs.where(free))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items share; documents that are mostly such spans go. Null and empty texts,
    and all others without such a span, are unchanged; every row is judged by itself, repeated ones alike."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; every row stays. Null, empty and clean texts are unchanged, repeated
    rows get equal texts; n_chars is counted anew, other columns are as they were."""
    return redact(docs, learned_field(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of the text's pieces, for every row: null for a null text, none for an empty one."""
    return encoded(docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text")), load_model(MODEL_PATH)).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", encoding),
]

#: Profiles, the random field and the encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
