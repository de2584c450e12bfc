"""Fits that all tasks share: Krylov ridge, sparse Gram sums, heads by gradients, checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifold.functions.sequences import positional_places
from motifold.operators import encoder, finetune, krylov, ridge, sparse_gram, splits, training
from motifold.operators.features import feature_matrix
from motifold.sources.checkpoints import Store


def table(spark, x, y, parts=3):
    rows = [(i, "g" if i % 3 else "h", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, g string, features array<double>, y double").repartition(parts)


def sample(seed, n=240, width=6):
    random = np.random.default_rng(seed)
    x = random.standard_normal((n, width)) * np.logspace(0, 1.5, width) + 4
    return x, x @ random.standard_normal(width) + 5 * random.standard_normal(n) + 11


@pytest.mark.parametrize(("scale", "refit"), [(False, True), (True, False)])
def test_krylov_equals_gram(spark, scale, refit):
    x, y = sample(1)
    rows = splits.split_by_share(table(spark, x, y), "id").cache()
    found = {r.g: r for r in krylov.validated(rows, ["g"], 6, refit=refit, scale=scale).collect()}
    sums = ridge.gram_sums(rows, ["g", "split"]).toPandas()
    for g, own in sums.groupby("g"):
        wanted = ridge.validated({s: ridge.matrix(c) for s, c in own.groupby("split")}, refit=refit, scale=scale)
        assert found[g].status == "ok" and {k: found[g][k] for k in wanted} == pytest.approx(wanted, rel=1e-6, abs=1e-6)
    lacking = krylov.validated(rows.where("g = 'g' or split <> 'test'"), ["g"], 6).collect()
    assert {r.g: r.status for r in lacking} == {"g": "ok", "h": "ValueError: no rows of test"}


def test_krylov_wider_than_rows(spark):
    """More features than rows, equal and constant ones, in blocks of training sets."""
    random = np.random.default_rng(2)
    x = random.standard_normal((40, 30))
    x = np.concatenate([x, x, np.ones((40, 3))], 1)
    y = x[:, :5].sum(1) + random.standard_normal(40)
    rows = table(spark, x, y).cache()
    solved = krylov.fits(rows, 63, F.array(F.lit(0), F.col("id") % 3 + 1), 4)
    for s, own in enumerate([range(40), *(range(k, 40, 3) for k in range(3))]):
        a = x[list(own)] - x[list(own)].mean(0)
        for alpha, fit in zip(ridge.ALPHAS, solved[s].fits, strict=True):
            w = np.linalg.solve(a.T @ a + alpha * np.eye(63), a.T @ (y[list(own)] - y[list(own)].mean()))
            assert fit.weights == pytest.approx(w, abs=1e-7)
    assert all(s.residual <= krylov.TOLERANCE and s.rounds <= 40 for s in solved)
    with pytest.raises(Exception, match="features"):
        krylov.fits(rows, 62, F.array(F.lit(0)), 1)


def test_krylov_of_places(spark):
    """Places of ones give what dense rows give."""
    random = np.random.default_rng(3)
    seqs = ["".join(random.choice(list("ACGTN"), 9)) for _ in range(120)]
    rows = spark.createDataFrame([(i, s, s.count("G") + float(random.random())) for i, s in enumerate(seqs)], "id int, seq string, y double")
    rows = splits.split_by_share(rows, "id").cache()
    sparse = krylov.validated(rows.withColumn("features", positional_places(F.col("seq"), 2)), [], 8 * 16).first()
    dense = krylov.validated(feature_matrix(rows, "2mer", 9), [], 8 * 16).first()
    assert sparse.alpha == dense.alpha and sparse.test_r2 == pytest.approx(dense.test_r2, abs=1e-9)


def test_krylov_nested(spark):
    x, y = sample(4, 90)
    rows = splits.inner_folds(table(spark, x, y).drop("g"), "id", 4, 3).withColumn("target", F.lit("t")).cache()
    wanted = ridge.nested_folds(rows, ["target"], "outer", "inner", 6).first()
    found = krylov.nested(rows, 6, 4, 3)
    assert {k: found[k] for k in ("n", "alpha", "r2", "pearson", "rmse")} == pytest.approx({k: wanted[k] for k in ("n", "alpha", "r2", "pearson", "rmse")}, rel=1e-6)


def test_sparse_sums_are_gram_sums(spark):
    random = np.random.default_rng(5)
    seqs = ["".join(random.choice(list("ACGTN"), random.integers(0, 9))) for _ in range(150)]
    rows = spark.createDataFrame([(i, "f" if i % 4 else "k", s, float(random.random()) if i else None) for i, s in enumerate(seqs)], "id int, file string, seq string, y double").repartition(3)
    for n in (1, 2, 3):
        width = (8 - n + 1) * 4**n
        placed = rows.withColumn("places", positional_places(F.col("seq"), n))
        dense = ridge.gram_sums(feature_matrix(rows, f"{n}mer", 8), ["file"]).toPandas()
        sparse = sparse_gram.sums(placed, ["file"], width).toPandas()
        for file, own in dense.groupby("file"):
            assert sparse_gram.matrix(sparse[sparse.file == file], width) == pytest.approx(ridge.matrix(own))
        folded = splits.inner_folds(placed, "id", 4, 3, within="file").cache()
        wanted = {r.file: r for r in ridge.nested_folds(feature_matrix(folded, f"{n}mer", 8), ["file"], "outer", "inner", width).collect()}
        for r in sparse_gram.nested_folds(folded, ["file"], "outer", "inner", width).collect():
            assert r.status == "ok" and r.n == wanted[r.file].n and r.alpha == wanted[r.file].alpha
            assert (r.r2, r.pearson, r.rmse) == pytest.approx((wanted[r.file].r2, wanted[r.file].pearson, wanted[r.file].rmse), abs=1e-6)
    broken = sparse_gram.nested_folds(folded, ["file"], "outer", "inner", 5).collect()
    assert len(broken) == 2 and all("places beyond 5" in r.status and r.r2 is None for r in broken)


# -- heads -----------------------------------------------------------------------------------------------------------


def head_rows(spark, n=300, parts=3):
    random = np.random.default_rng(6)
    x = random.standard_normal((n, 3)) * [1, 5, 0.2] + 3
    y = np.tanh(x[:, 0] - 3) * 2 + x[:, 1] - 4 * x[:, 2] + 0.1 * random.standard_normal(n)
    rows = spark.createDataFrame([(i, i % 2, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, group int, x array<double>, y double")
    return splits.split_by_share(rows, "id").withColumn("key", training.row_keys("x", "y")).repartition(parts, "id")


def test_head_slopes():
    random = np.random.default_rng(9)
    heads = training.Heads((3, 4, 5, 1), 0.3)
    params = {n: p + random.standard_normal(p.shape) / 9 for n, p in heads.start(1, np.array([0.5, 2.0])).items()}  # no kinks at 0
    x, y, keys = random.standard_normal((7, 3)), random.standard_normal(7), random.integers(0, 1 << 60, 7)
    loss = lambda: ((heads.forward(params, 1, x, keys, 5)[0][-1][:, 0] - y) ** 2).sum()
    values, kept = heads.forward(params, 1, x, keys, 5)
    assert any((k == 0).any() for k in kept[1:-1])
    for name, slope in heads.slopes(params, 1, values, kept, y).items():
        p = params[name][1]
        for at in np.ndindex(p.shape):
            p[at] += 1e-6
            up = loss()
            p[at] -= 2e-6
            assert slope[at] == pytest.approx((up - loss()) / 2e-6, rel=1e-4, abs=1e-4)
            p[at] += 1e-6


def test_dropout_is_of_key_and_step():
    keys = np.arange(4000)
    drawn = training.dropped(keys, 3, 1, 8, 0.25)
    assert set(np.unique(drawn)) == {0, 1 / 0.75} and (drawn == 0).mean() == pytest.approx(0.25, abs=0.01)
    assert np.array_equal(drawn[::-1], training.dropped(keys[::-1].copy(), 3, 1, 8, 0.25)) and (drawn != training.dropped(keys, 4, 1, 8, 0.25)).any()


def test_heads_are_the_same_for_any_partitioning(spark):
    options = {"hidden": (8,), "rate": 1e-2, "epochs": 3, "dropout": 0.2, "decay": 1e-3}
    one, many = (training.trained_heads(head_rows(spark, parts=n).cache(), 2, **options) for n in (1, 8))
    assert one.done and [s["epochs"] for s in one.scores] == [s["epochs"] for s in many.scores]
    for a, b in zip(one.scores, many.scores, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6)
    for name, x in one.state.params.items():
        assert x == pytest.approx(many.state.params[name], rel=1e-5, abs=1e-7)


def test_training_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = head_rows(spark).cache()
    options = {"hidden": (6,), "rate": 1e-2, "epochs": 4, "batches": 2, "dropout": 0.1}
    whole = training.trained_heads(rows, 2, **options)
    store = Store(spark, str(tmp_path / "store"))
    first = training.trained_heads(rows, 2, store=store, most_steps=5, **options)
    assert not first.done and store.load()[0] == 4  # the fifth step was lost
    # A killed run left a version without its row in the manifest.
    spark.range(3).write.parquet(str(tmp_path / "store" / "weights" / "version=6"))
    second = training.trained_heads(rows, 2, store=Store(spark, str(tmp_path / "store")), **options)
    assert second.done and second.scores == [pytest.approx(s, rel=1e-9) for s in whole.scores]
    assert all(x == pytest.approx(whole.state.second[n], rel=1e-9) for n, x in second.state.second.items())
    assert [r.version for r in store.manifest().orderBy("version").collect()] == [2, 4, 6, 8]
    third = training.trained_heads(rows, 2, store=store, **options)
    assert third.scores == second.scores


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load() is None
    arrays = {"a": np.arange(6.0).reshape(2, 3), "b": np.array([np.inf, -np.inf]), "c": np.array(3.0)}
    store.save(3, arrays, {"note": "x"})
    store.save(7, {"a": np.zeros(2)}, {})
    version, own, numbers = store.load(3)
    assert version == 3 and numbers == {"note": "x"} and all(np.array_equal(own[k], v) for k, v in arrays.items())
    assert store.load()[0] == 7 and store.load(5) is None
    with pytest.raises(ValueError, match="is there"):
        store.save(7, arrays, {})
    spark.read.parquet(str(tmp_path / "s/weights/version=3")).where("name = 'a'").write.parquet(str(tmp_path / "less"))
    (tmp_path / "s/weights/version=7").rename(tmp_path / "old")
    (tmp_path / "less").rename(tmp_path / "s/weights/version=7")
    with pytest.raises(ValueError, match="differs"):
        store.load()


# -- encoder ---------------------------------------------------------------------------------------------------------

SHAPE = encoder.Shape(k=2, width=8, heads=2, layers=2, hidden=10, positions=16, tokens=20, targets=12)
SEQS = ["ACGTACGTAA", "TGCATG", "GGGAAACCCCN", "AT", "ATATCGCGTACGT"]


def test_backward_is_slopes():
    """All weights of two layers, with padding, by finite differences; the forward pass is the encoder's."""
    random = np.random.default_rng(3)
    weights = {n: w + random.standard_normal(w.shape) / 5 for n, w in encoder.random_weights(1, SHAPE).items()}
    x, mask = encoder.one_hot_batch(SEQS, SHAPE.k)
    pull = random.standard_normal((*mask.shape, SHAPE.width)) * mask[..., None]
    h, tapes = finetune.forward(weights, x, mask, SHAPE)
    assert h * mask[..., None] == pytest.approx(encoder.forward(weights, x, mask, SHAPE)[0])
    slopes = finetune.backward(weights, x, tapes, pull, SHAPE)
    assert slopes.keys() == {n for n in weights if "head" not in n}
    last = finetune.backward(weights, x, tapes, pull, SHAPE, 1)
    assert last.keys() == {n for n in weights if n.startswith("layer1")} and all(np.array_equal(last[n], slopes[n]) for n in last)
    loss = lambda: (finetune.forward(weights, x, mask, SHAPE)[0] * pull).sum()
    for name, slope in slopes.items():
        flat = weights[name].ravel()
        for at in random.integers(0, flat.size, 6).tolist():
            flat[at] += 1e-5
            up = loss()
            flat[at] -= 2e-5
            assert slope.ravel()[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-5), name
            flat[at] += 1e-5


def scored(spark, n=160, parts=3):
    random = np.random.default_rng(8)
    seqs = ["".join(random.choice(list("ACGT"), random.integers(6, 14))) for _ in range(n)]
    rows = [(i, s, sum(s[j : j + 2] in ("AC", "GT", "CA") for j in range(len(s) - 1)) / len(s)) for i, s in enumerate(seqs)] + [(n, "A", 1.0), (n + 1, None, 2.0)]
    rows = splits.split_by_share(spark.createDataFrame(rows, "key long, seq string, y double"), "key", train=0.7, val=0.15)
    return rows.repartition(parts, "key").cache()


def test_unfrozen_layer_beats_the_frozen_one(spark, tmp_path):
    weights = encoder.random_weights(4, SHAPE)
    options = {"shape": SHAPE, "hidden": (), "rate": 2e-2, "kind": "hidden", "epochs": 6, "batches": 2, "patience": 9}
    rows = scored(spark)
    frozen = finetune.fine_tuned(rows, weights, encoder_rate=0.0, **options)
    store = Store(spark, str(tmp_path / "s"))
    assert not finetune.fine_tuned(rows, weights, encoder_rate=1e-2, store=store, most_steps=5, **options).done
    tuned = finetune.fine_tuned(rows, weights, encoder_rate=1e-2, store=store, **options)
    assert tuned.done and tuned.scores["n"] == 160 and tuned.scores["val_r2"] > frozen.scores["val_r2"] + 0.02
    assert all(np.array_equal(frozen.weights[n], w) for n, w in weights.items())
    moved = {n for n, w in weights.items() if not np.array_equal(tuned.weights[n], w)}
    assert moved and all(n.startswith("layer1.") for n in moved)
    again = finetune.fine_tuned(scored(spark, parts=7), weights, encoder_rate=1e-2, **options)
    assert again.scores == pytest.approx(tuned.scores, rel=1e-6)
    top = finetune.fine_tuned(rows, weights, SHAPE, kind="flex", pool="max", epochs=1, batches=1)
    assert top.done and np.isfinite(top.scores["test_r2"])


def test_training_lowers_the_loss(spark, tmp_path):
    rows, weights = scored(spark).drop("y"), encoder.random_weights(5, SHAPE)
    options = {"shape": SHAPE, "rate": 3e-2, "epochs": 4, "batches": 3}
    whole = finetune.pretrained(rows, weights, **options)
    assert whole.scores["val_loss"] < 0.85 * whole.scores["start_loss"] and whole.done
    store = Store(spark, str(tmp_path / "t"))
    assert not finetune.pretrained(rows, weights, store=store, most_steps=4, **options).done
    assert finetune.pretrained(rows, weights, store=store, **options).scores == pytest.approx(whole.scores, rel=1e-6)


def test_masks_are_of_key_and_step():
    keys, counts = np.arange(300), np.full(300, 20)
    found = finetune.masks(keys, counts, 3, 0.15)
    assert all(len(x) for x in found) and np.mean([len(x) for x in found]) / 20 == pytest.approx(0.155, abs=0.02)
    assert [x.tolist() for x in finetune.masks(keys[::-1].copy(), counts, 3, 0.15)][::-1] == [x.tolist() for x in found]
    assert any(len(a) != len(b) for a, b in zip(found, finetune.masks(keys, counts, 4, 0.15), strict=True))
