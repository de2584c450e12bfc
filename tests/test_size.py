"""What work costs as tables grow: precision, jobs, and rows that are made on the way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifold.functions.sequences import kmer_list, positional_places
from motifold.operators import encoder, finetune, krylov, ridge, sparse_gram, splits, training
from motifold.operators.features import placed
from motifold.plans import queries


def test_encoder_stays_in_its_precision():
    x, mask = encoder.one_hot_batch(["ACGTACGTAC", "ACGTAC"], 6)
    for kind in (np.float32, np.float64):
        weights = {n: w.astype(kind) for n, w in encoder.random_weights(1).items()}
        hidden, targets = encoder.forward(weights, x.astype(kind), mask)
        assert hidden.dtype == targets.dtype == kind


def test_folds_of_places_need_no_pairs_in_a_shuffle(spark):
    random = np.random.default_rng(5)
    rows = [(i, "fk"[i % 2], sorted(random.choice(24, random.integers(0, 6), replace=False).tolist()), float(random.random())) for i in range(300)]
    folded = splits.inner_folds(spark.createDataFrame(rows, "id int, file string, places array<int>, y double"), "id", 4, 3, within="file").cache()
    found = [sparse_gram.nested_folds(folded, ["file"], "outer", "inner", 24, most=most) for most in (1 << 22, 20)]
    plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [file" in plan and "j#" not in plan
    few, parts = ({r.file: r for r in df.collect()} for df in found)
    for file, r in few.items():
        assert r.status == parts[file].status == "ok" and (r.n, r.alpha) == (parts[file].n, parts[file].alpha)
        assert (r.r2, r.pearson, r.rmse) == pytest.approx((parts[file].r2, parts[file].pearson, parts[file].rmse), abs=1e-9)


def test_samples_of_places_match_dense_rows(spark):
    random = np.random.default_rng(6)
    rows = [("m", ("train", "val", "test")[min(i % 5, 2)], i % 2 if i % 5 == 0 else -1, random.choice(20, 4, replace=False).tolist(), float(random.random())) for i in range(400)]
    placed = spark.createDataFrame([(m, s, b, sorted(p), y) for m, s, b, p, y in rows], "model string, split string, band int, places array<int>, y double")
    dense = placed.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.array_contains("places", i).cast("double")))
    fit, schema = lambda cells: ridge.subset_scores(cells, [50, 100]), f"percent double, n_train long, {ridge.VALIDATED}"
    wanted = ridge.fitted(dense, ["model"], ["split", "band"], fit, schema, 20).orderBy("percent").collect()
    for most in (1 << 22, 90):
        found = sparse_gram.solved(placed, ["model"], ["split", "band"], 20, fit, schema, most=most).orderBy("percent").collect()
        assert len(found) == 2 and all(list(a)[1:-1] == pytest.approx(list(b)[1:-1], abs=1e-9) and a.status == "ok" for a, b in zip(found, wanted, strict=True))


def test_encoder_pools_twice_in_one_pass(spark):
    seqs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTAC"), (3, "ACG")], "id int, seq string")
    weights = encoder.random_weights(1)
    made = {p: {r.id: r.features for r in encoder.encoded(seqs, weights, kind="hidden_flex", pool=p).collect()} for p in ("mean", "max", "mean_max")}
    for i in (1, 2):
        assert made["mean_max"][i] == pytest.approx(made["mean"][i] + made["max"][i], abs=1e-5)
    assert made["mean_max"][3] is None


def test_rows_of_one_key_have_an_order(spark):
    rows = [("k" if i < 40 else f"k{i}", float(i % 40)) for i in range(80)]
    found = [{(r.id, r.y): r.fold for r in splits.folds(spark.createDataFrame(own, "id string, y double").repartition(n), "id", 7, ties=("y",)).collect()} for own, n in ((rows, 1), (rows[::-1], 3))]
    assert found[0] == found[1]


def test_sampled_windows_leave_chunks_where_they_are(spark):
    chunks = spark.createDataFrame([(f"c{i}", 0, "ACGT" * 20) for i in range(9)], "chrom string, start long, seq string")
    found = splits.sampled_windows(chunks, 20, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [chrom" in plan and "SortMergeJoin [chrom" not in plan
    assert [len(r.seq) for r in found.collect()] == [10] * 20


def test_one_hots_are_made_of_distinct_tokens(spark):
    plan = queries.onehot_profile(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [kmer" in plan


def test_training_stays_in_its_precision():
    x, mask = encoder.one_hot_batch(["ACGTACGTAC", "ACGTAC"], 6)
    weights = {n: w.astype(np.float32) for n, w in encoder.random_weights(1).items()}
    h, tapes = finetune.forward(weights, x.astype(np.float32), mask, encoder.Shape())
    slopes = finetune.backward(weights, x.astype(np.float32), tapes, h, encoder.Shape(), 1)
    assert h.dtype == np.float32 and {s.dtype for s in slopes.values()} == {np.dtype(np.float32)}


def test_frozen_encoder_is_no_part_of_the_steps(spark):
    rows = spark.createDataFrame([(i, "ACGT"[i % 4] * 3 + "ACGTTGCA"[i % 5 :], ("train", "val", "test")[i % 3], float(i % 7)) for i in range(30)], "key long, seq string, split string, y double")
    shape = encoder.Shape(k=2, width=4, heads=2, layers=1, hidden=6, positions=16, tokens=20)
    found = finetune.fine_tuned(rows, encoder.random_weights(2, shape), shape, hidden=(3,), encoder_rate=0.0, epochs=1, batches=1)
    assert found.done and found.scores["n"] == 30 and set(found.state.params) == {"w0", "b0", "w1", "b1"}


def test_krylov_reads_its_rows_once(spark):
    random, seen = np.random.default_rng(7), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(x.tolist(), float(x.sum() + random.random())) for x in random.standard_normal((50, 8))], "features array<double>, y double")

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    solved = krylov.fits(rows.mapInArrow(counted, rows.schema), 8, F.array(F.lit(0)), 1)
    assert solved[0].rounds > 3 and seen.value == 50


def test_words_of_a_document_are_no_rows_of_a_shuffle(spark):
    plan = queries.sql_kmers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "keys=[doc_id" in plan and ", kmer" not in "".join(line for line in plan.splitlines() if "keys=" in line)


def test_ranks_of_batches_carry_letters(spark):
    plan = queries.collated_batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("Window [row_number")], plan[plan.index("Window [row_number") :]
    assert "zip_with" in above and "zip_with" not in below


def test_words_are_listed_over_the_edges_of_chunks(spark):
    seqs = ["ACGTN" * n + "G" * m for n, m in ((0, 0), (0, 5), (0, 6), (51, 0), (51, 1), (52, 3), (120, 2))]
    rows = spark.createDataFrame([(s,) for s in seqs], "seq string").select("seq", kmer_list(F.col("seq"), 6, F.upper).alias("words"))
    assert {r.seq: r.words for r in rows.collect()} == {s: [s[i : i + 6] for i in range(len(s) - 5)] for s in seqs}


def folded_rows(spark, n=240):
    random = np.random.default_rng(12)
    rows = [(f"r{i}", "f" if i % 3 else "k", random.standard_normal(5).tolist(), float(random.random())) for i in range(n)]
    folded = splits.inner_folds(spark.createDataFrame(rows, "id string, file string, features array<double>, y double"), "id", 4, 3, within="file")
    return spark.createDataFrame(folded.collect(), folded.schema).repartition(3)  # its plan has no folds


def test_a_row_of_a_large_group_is_handed_on_once_for_all_folds(spark, monkeypatch):
    rows = folded_rows(spark)
    wanted = sorted(ridge.nested_folds(rows, ["file"], "outer", "inner", 5).collect())
    monkeypatch.setattr(ridge, "MOST_VALUES", 10)
    found = ridge.nested_folds(rows, ["file"], "outer", "inner", 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "place" not in plan
    for a, b in zip(sorted(found.collect()), wanted, strict=True):
        assert a.file == b.file and a.status == "ok" and a[1:6] == pytest.approx(b[1:6], rel=1e-9)


def test_groups_are_dealt_by_number_not_by_bytes(spark):
    plan = ridge.nested_folds(folded_rows(spark), ["file"], "outer", "inner", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [file" in plan


def test_sums_of_bands_are_handed_on_as_arrays(spark, monkeypatch):
    rows = folded_rows(spark).selectExpr("'m' model", "features", "y", "case outer when 0 then 'val' when 1 then 'test' else 'train' end split", "outer - 2 band")
    fit, schema = lambda cells: ridge.subset_scores(cells, [50, 100]), f"percent double, n_train long, {ridge.VALIDATED}"
    wanted = sorted(ridge.fitted(rows, ["model"], ["split", "band"], fit, schema, 5).collect())
    monkeypatch.setattr(ridge, "MOST_VALUES", 10)
    found = ridge.fitted(rows, ["model"], ["split", "band"], fit, schema, 5)
    assert "place" not in found._jdf.queryExecution().optimizedPlan().toString()
    for a, b in zip(sorted(found.collect()), wanted, strict=True):
        assert a.status == "ok" and a[1:-1] == pytest.approx(b[1:-1], rel=1e-9)


def test_equal_sequences_are_encoded_together(spark):
    seqs = ["ACGTACGTAC", "ACGTACGGG", "TTTTTTT", "AC", None, "ACGTACGTAC"] * 40
    rows = encoder.alike(spark.createDataFrame(list(enumerate(seqs)), "id int, seq string").repartition(7))
    for seqs_ in rows.rdd.glom().map(lambda own: [r.seq for r in own]).collect():
        assert sum(a != b for a, b in zip(seqs_, seqs_[1:], strict=False)) == max(0, len(set(seqs_)) - 1)
    assert len({r[0] for r in rows.select(F.spark_partition_id(), "seq").distinct().collect()}) <= 5 and rows.select(F.spark_partition_id(), "seq").distinct().count() == 5
    weights = encoder.random_weights(3)
    alone = {r.seq: r.features for r in encoder.encoded(spark.createDataFrame([(s,) for s in set(seqs)], "seq string"), weights).collect()}
    for r in encoder.encoded(rows, weights).collect():
        assert r.features == (alone[r.seq] and pytest.approx(alone[r.seq], abs=1e-5))


def test_the_last_layer_is_trained_for_all_epochs(spark, monkeypatch):
    asked, known = [], finetune.fine_tuned(spark.createDataFrame([(i, "ACGTACG", ("train", "val", "test")[i % 3], float(i)) for i in range(6)], "key long, seq string, split string, y double"), encoder.random_weights(1), epochs=1, batches=1)

    def told(rows, weights, **options):
        asked.append(options)
        return known

    monkeypatch.setattr(finetune, "fine_tuned", told)
    queries.unfrozen_layer_scores(spark, "/root/testdata/sf0.001")
    assert len(asked) == 2 and all(o["epochs"] == o["patience"] == 30 and o.get("batches", 4) >= 4 for o in asked)


def counted(rows, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(run, rows.schema)


def test_training_reads_its_rows_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]
    rows = spark.createDataFrame([(i, "ACGT"[i % 4] * 3 + "ACGTTGCA"[i % 5 :], ("train", "val", "test")[i % 3], float(i % 7)) for i in range(30)], "key long, seq string, split string, y double")
    shape = encoder.Shape(k=2, width=4, heads=2, layers=2, hidden=6, positions=16, tokens=20)
    finetune.fine_tuned(counted(rows, seen[0]), encoder.random_weights(2, shape), shape, hidden=(3,), encoder_rate=1e-3, epochs=3, batches=2)
    finetune.pretrained(counted(rows, seen[1]), encoder.random_weights(2, shape), shape, epochs=3, batches=2)
    heads = rows.selectExpr("0 group", "split", "key", "array(y, double(key)) x", "y")
    training.trained_heads(counted(heads, seen[2]), 1, (3,), epochs=3, batches=2)
    assert [s.value for s in seen] == [30, 30, 30]


def test_places_on_batches_are_places_of_columns(spark):
    seqs = ["ACGTNACGTA", "AC", "", None, "TTTTTTTTTT", "NNNN", "ACG"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string")
    for n in (1, 2, 3):
        wanted = {r.id: r.places for r in rows.select("id", positional_places(F.col("seq"), n).alias("places")).collect()}
        assert {r.id: r.places for r in placed(rows, n, 10).collect()} == wanted


def test_rows_of_a_block_have_like_numbers_of_places():
    lists = [list(range(i % 7)) for i in range(100)] + [list(range(40))]
    batch = pa.RecordBatch.from_pydict({"x": pa.array(lists, pa.list_(pa.int32())), "y": np.arange(101.0), "sets": pa.array([[0]] * 101, pa.list_(pa.int32()))})
    blocks = list(krylov._parts(batch, 40, 20))
    assert sum(len(b[1]) for b in blocks) == 101 and sum(b[0].size for b in blocks) < 2 * sum(map(len, lists)) + 20 * 40
    v, u = np.random.default_rng(1).standard_normal((40, 2)), np.random.default_rng(2).standard_normal((101, 2))
    full = np.array([[float(j in own) for j in range(40)] for own in lists])
    for parts in blocks:
        b = krylov._batch(parts, 40, 1)
        at = parts[1].astype(int)
        assert b.times(v) == pytest.approx(full[at] @ v) and b.back(u[at], 40) == pytest.approx(full[at].T @ u[at])
