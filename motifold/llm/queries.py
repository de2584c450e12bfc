"""The thin queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm.centroid_clusters import clustered
from motifold.llm.decontamination import contamination_report
from motifold.llm.hilbert_ann import nearest
from motifold.llm.language_id import language_predictions
from motifold.llm.lm_scoring import cross_entropy_difference
from motifold.llm.near_dedup import near_duplicates
from motifold.llm.pii_crf import personal_data
from motifold.llm.quality_discriminant import quality_scores
from motifold.llm.sentencepiece_lattice import encoding_report, load_model
from motifold.llm.tool_calls import formatted_conversations
from motifold.llm.url_trust import judged_urls
from motifold.llm.vector_codes import coded
from motifold.llm.warc import archived_pages
from motifold.session import dealt


#: The model whose ids op3 and the pipeline give.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(_table(spark, sf_dir, "documents"))


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by how much better a model of documents of quality 1 tells it than one of all documents. Odd rows: see the operator."""
    targets = _table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(_documents(spark, sf_dir), targets)


def op2_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of the documents that are not held out. Odd rows: see the operator."""
    return language_predictions(_documents(spark, sf_dir))


def op3_suffix_array_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Every document encoded by the model, as a count and a digest of its ids, and whether they decode to it. Odd rows: see the operator."""
    return encoding_report(_documents(spark, sf_dir), load_model(model_path))


def op4_shifted_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth. Odd rows: see the operator."""
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_skip_chain_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of base spans, and all spans. Odd rows: see the operator."""
    return personal_data(_documents(spark, sf_dir))


def op6_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occur in windows of benchmark items. Odd rows: see the operator."""
    return contamination_report(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("longest")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, and what is read back. Odd rows: see the operator."""
    return archived_pages(_table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document. Odd rows: see the operator."""
    return near_duplicates(_documents(spark, sf_dir))


def op9_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url, by rule or by links. Odd rows: see the operator."""
    return judged_urls(_table(spark, sf_dir, "pages"))


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a linked, validated and serialised event. Odd rows: see the operator."""
    return formatted_conversations(_table(spark, sf_dir, "conversations"))


def op11_annular_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code by codebooks of parts, and its error. Odd rows: see the operator."""
    return coded(_table(spark, sf_dir, "embeddings"))


def op12_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labelled documents that are not held out. Odd rows: see the operator."""
    return quality_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op13_gemm_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster, and how far it and all are from their centroids. Odd rows: see the operator."""
    return clustered(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from motifold.llm.oracles import ORACLES

    return dict(ORACLES)
