"""The stages of the corpus pipeline, each judged on what it was given."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motifold.llm.queries import MODEL_PATH

from .test_llm_operators import brute_components, brute_report, brute_spans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.union(docs.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit("12 34 !").alias("text"), "lang", "source", F.lit(7).alias("n_chars")))
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept) and (docs.columns == columns or name == "sentencepiece")
        if name == "language_id":
            assert given.keys() - kept.keys() == {10**6} and all(kept[d].text == given[d].text for d in kept)
        elif name == "near_dedup":
            order = sorted(given)
            assert set(kept) == {order[i] for i, _, c, own in brute_components([given[d].text for d in order]) if own}
        elif name == "decontamination":
            before = dict(zip(given, brute_report([r.text for r in given.values()], items), strict=True))
            assert all(n_hit > 0.5 * n for d, (n, n_hit, *_) in before.items() if d not in kept)
            assert all(kept[d].text == given[d].text for d in kept if not before[d][4])
            assert not any(r[4] for r in brute_report([r.text for r in kept.values()], items))
        elif name == "pii":
            assert kept.keys() == given.keys() and not any(brute_spans(r.text) for r in kept.values())
            assert all(kept[d].text == given[d].text for d in kept if not brute_spans(given[d].text))
        else:
            library = SentencePieceProcessor(model_file=MODEL_PATH)
            assert kept.keys() == given.keys() and all(kept[d].ids == library.encode(given[d].text) for d in kept)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns that stages use inside."""
    prose = " ".join(f"the word{i} and of{i}" for i in range(60))
    rows = [(1, prose), (1, prose), (2, prose + " more"), (None, prose), (3, None), (4, ""), (5, "12 !"), (6, "x" * 100_000), (7, "mail a@b.cd to"), (7, "mail a@b.cd to"), (None, None), (8, "word " * 50_000), (9, "漢字")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row_key string, hits string, ids string, head string, v long"
    docs = spark.createDataFrame([(i, t, None if i in (2, None) else "en", None, None if t is None else len(t), 0.5, "own", "k", None, "z", "h", 3) for i, t in rows], schema)
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, None), (2, "the word3 and of3 the word4 and of4 the word5 and")], "item_id long, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
        if name != "sentencepiece":
            assert docs.columns == columns
            assert all((r.score, r.lang_pred, r.row_key, r.hits, r.ids, r["head"], r.v) == (0.5, "own", "k", None, "z", "h", 3) for r in kept[name])
    order = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    lettered = [(i, t) for i, t in rows if t not in (None, "", "12 !")]
    assert order(kept["language_id"]) == sorted(lettered, key=str) and {r.lang for r in kept["language_id"]} == {"en"}
    heads = [(1, prose), (6, "x" * 100_000), (7, "mail a@b.cd to"), (8, "word " * 50_000), (9, "漢字")]
    assert order(kept["near_dedup"]) == sorted(heads, key=str)
    cut = {r.doc_id: r for r in kept["decontamination"]}
    assert cut.keys() == {1, 6, 7, 8, 9} and "word4 " not in cut[1].text and cut[1].n_chars == len(cut[1].text)
    assert {r.doc_id: r.text for r in kept["pii"]} == {**{i: r.text for i, r in cut.items()}, 7: "mail <EMAIL> to"}
    assert {r.doc_id for r in kept["sentencepiece"]} == {1, 6, 7, 8, 9} and all(r.ids for r in kept["sentencepiece"])
