"""A small post-norm transformer over one-hot k-mers, forward, and regression heads on its features.

Weights are a table (name, shape, data); a forward pass runs in tasks, on Arrow batches that are padded by themselves.
Heads are trained from sums that tasks make of all rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from motifold.functions.flexibility import BASES, SPECIALS, words
from motifold.functions.hashing import unit
from motifold.operators import krylov, ridge, splits, training
from motifold.sources.checkpoints import array_rows, arrays_of


class Shape(NamedTuple):
    k: int = 6
    width: int = 64
    heads: int = 4
    layers: int = 2
    hidden: int = 2048
    positions: int = 512
    tokens: int = 4100
    targets: int = 12


Weights = dict[str, np.ndarray]


def expected(shape: Shape) -> dict[str, tuple[int, ...]]:
    """Every weight's name and dimensions."""
    w, h = shape.width, shape.hidden
    out: dict[str, tuple[int, ...]] = {"input.weight": (w, 4 * shape.k), "input.bias": (w,), "position": (shape.positions, w)}
    for i in range(shape.layers):
        out |= {f"layer{i}.{n}": d for n, d in {"qkv.weight": (3 * w, w), "qkv.bias": (3 * w,), "mix.weight": (w, w), "mix.bias": (w,), "norm1.weight": (w,), "norm1.bias": (w,), "up.weight": (h, w), "up.bias": (h,), "down.weight": (w, h), "down.bias": (w,), "norm2.weight": (w,), "norm2.bias": (w,)}.items()}
    return out | {"token_head.weight": (shape.tokens, w), "token_head.bias": (shape.tokens,), "target_head.weight": (shape.targets, w), "target_head.bias": (shape.targets,)}


def random_weights(seed: int, shape: Shape = Shape()) -> Weights:
    """An untrained encoder: the control that trained ones are compared with."""
    random = np.random.default_rng(seed)
    out = {}
    for name, size in expected(shape).items():
        if ".norm" in f".{name}":
            out[name] = np.full(size, float(name.endswith("weight")))
        elif len(size) == 2:
            out[name] = random.uniform(-1, 1, size) / np.sqrt(size[1])
        else:
            out[name] = np.zeros(size)
    return out


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    array_rows(spark, weights).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, shape: Shape = Shape(), strict: bool = True) -> Weights:
    return fitting(arrays_of(spark.read.parquet(path)), shape, strict)


def fitting(own: Weights, shape: Shape = Shape(), strict: bool = True) -> Weights:
    """own, if it is an encoder of the shape. ValueError if a weight is missing, unknown or of other dimensions; without strict,
    missing ones are zero."""
    wanted = expected(shape)
    wrong = [n for n in wanted if n in own and own[n].shape != wanted[n]]
    if wrong or strict and own.keys() != wanted.keys():
        raise ValueError(f"weights don't fit: {wrong or sorted(own.keys() ^ wanted.keys())}")
    return {n: own.get(n, np.zeros(d)) for n, d in wanted.items()}


def one_hot_batch(seqs: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequences x longest x 4 k, mask): k-mers of each sequence, padded at the end; another letter is four zeros."""
    table = np.zeros((256, 4))
    for i, b in enumerate(BASES):
        table[ord(b), i] = 1
    lengths = np.array([len(s) for s in seqs], np.int64)
    longest = int(max(lengths.max(initial=0), k - 1))
    raw = "".join(s.ljust(longest, "\0") for s in seqs).encode("latin-1", "replace")
    hot = table[np.frombuffer(raw, np.uint8).reshape(len(seqs), longest)]
    mask = np.arange(longest - k + 1) < (lengths - k + 1)[:, None]
    x = np.lib.stride_tricks.sliding_window_view(hot, k, 1).transpose(0, 1, 3, 2).reshape(len(seqs), longest - k + 1, 4 * k)
    return x * mask[..., None], mask


def _normed(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """x, which is overwritten, scaled along its last axis."""
    x -= x.mean(-1, keepdims=True)
    x /= np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / x.shape[-1] + 1e-5)
    x *= weight
    x += bias
    return x


#: Tokens whose hidden layer is held at once (2 MB in float32), so that it stays in a core's cache.
FED_TOKENS = 256


def _lined(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    out = x @ weights[f"{name}.weight"].T
    out += weights[f"{name}.bias"]
    return out


def _with_ones(x: np.ndarray) -> np.ndarray:
    """x with a last column of ones, which a bias as a last column of weights meets."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1], out[:, -1] = x, 1
    return out


def _raised(weights: Weights, layer: str) -> np.ndarray:
    """Weights and biases of the way up: (width + 1) x hidden."""
    return np.ascontiguousarray(np.concatenate([weights[f"{layer}.up.weight"], weights[f"{layer}.up.bias"][:, None]], 1).T)


def _fed(x: np.ndarray, weights: Weights, layer: str) -> np.ndarray:
    """down(max(0, up(x))) of rows, in blocks of FED_TOKENS."""
    up, down = _raised(weights, layer), np.ascontiguousarray(weights[f"{layer}.down.weight"].T)
    out = np.empty((len(x), down.shape[1]), np.result_type(x, up))
    held, x = np.empty((FED_TOKENS, up.shape[1]), out.dtype), _with_ones(x)
    for a in range(0, len(x), FED_TOKENS):
        own = x[a : a + FED_TOKENS]
        hidden = held[: len(own)]
        np.matmul(own, up, out=hidden)
        np.maximum(hidden, 0, out=hidden)
        np.matmul(hidden, down, out=out[a : a + FED_TOKENS])
    out += weights[f"{layer}.down.bias"]
    return out


def forward(weights: Weights, x: np.ndarray, mask: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray]:
    """(hidden, targets) at each position; padding has no say in other positions, and zeros itself. All is worked out in the
    precision of x and weights.

    ValueError if a sequence has more tokens than there are positions.
    """
    b, n, _ = x.shape
    if n > shape.positions:
        raise ValueError(f"{n} tokens; the encoder has {shape.positions} positions")
    h = _lined(x.reshape(b * n, -1), weights, "input")
    h.reshape(b, n, shape.width)[:] += weights["position"][:n]
    per = shape.width // shape.heads
    part = 1 / float(np.sqrt(per))  # a Python number, which leaves float32 as it is
    away = None if mask.all() else ~mask[:, None, None, :]
    for i in range(shape.layers):
        layer = f"layer{i}"
        q, k, v = _lined(h, weights, f"{layer}.qkv").reshape(b, n, 3, shape.heads, per).transpose(2, 0, 3, 1, 4)
        near = (q * part) @ k.transpose(0, 1, 3, 2)
        if away is not None:
            np.copyto(near, -1e30, where=away)
        near -= near.max(-1, keepdims=True)
        np.exp(near, out=near)
        near /= near.sum(-1, keepdims=True)
        mixed = (near @ v).transpose(0, 2, 1, 3).reshape(b * n, shape.width)
        mixed = _lined(mixed, weights, f"{layer}.mix")
        mixed += h
        h = _normed(mixed, weights[f"{layer}.norm1.weight"], weights[f"{layer}.norm1.bias"])
        fed = _fed(h, weights, layer)
        fed += h
        h = _normed(fed, weights[f"{layer}.norm2.weight"], weights[f"{layer}.norm2.bias"])
    targets = _lined(h, weights, "target_head").reshape(b, n, -1)
    h = h.reshape(b, n, shape.width)
    return (h, targets) if away is None else (h * mask[..., None], targets * mask[..., None])


def alike(seqs: DataFrame) -> DataFrame:
    """seqs, dealt so that equal sequences lie next to each other, for encoded(), which works each of a batch out once."""
    spark = seqs.sparkSession
    # The number is given, so that adaptive execution doesn't join tasks whose bytes are few and whose work is much.
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return seqs.repartition(parts, "seq").sortWithinPartitions("seq")


def encoded(seqs: DataFrame, weights: Weights, shape: Shape = Shape(), kind: str = "hidden", pool: str | None = "mean", tokens: int = 1 << 14, precision: type = np.float32, length: int | None = None) -> DataFrame:
    """seqs with an array column features: of hidden states (kind hidden), targets (kind flex), or both (kind hidden_flex).

    pool is mean, max, mean_max (both, one after the other) or None: None flattens positions; with length, shorter sequences have zeros for the positions that they
    lack, without it sequences of one length are needed. A sequence without a k-mer has null features. A forward pass takes about so many tokens at once, in float32 unless asked otherwise.
    Equal sequences of an Arrow batch are worked out once (see alike).
    """
    shared = seqs.sparkSession.sparkContext.broadcast({name: x.astype(precision) for name, x in weights.items()})
    place = seqs.columns.index("seq")

    def values_of(texts: list[str]) -> np.ndarray:
        x, mask = one_hot_batch(texts, shape.k)
        hidden, targets = forward(shared.value, x.astype(precision), mask, shape)
        values = {"hidden": [hidden], "flex": [targets], "hidden_flex": [hidden, targets]}[kind]
        values = np.concatenate(values, 2)
        if pool in ("mean", "max", "mean_max"):
            made = {"mean": lambda: values.sum(1) / mask.sum(1)[:, None], "max": lambda: np.where(mask[..., None], values, -1e9).max(1)}
            return np.concatenate([made[p]() for p in pool.split("_")], 1)
        if length is not None:
            values = np.pad(values, ((0, 0), (0, length - shape.k + 1 - values.shape[1]), (0, 0)))
        return values.reshape(len(values), -1)

    def run(batches):
        for own in batches:
            coded = own.column(place).fill_null("").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            lengths = np.array([len(x) for x in texts], np.int64)
            order = np.argsort(lengths, kind="stable")
            order = order[lengths[order] >= shape.k]
            parts, a = [], 0
            while a < len(order):
                # As many of one length as fit, so nothing is padded.
                longest = lengths[order[a]]
                b = min(int(np.searchsorted(lengths[order], longest, "right")), a + max(1, tokens // int(longest)))
                parts.append(values_of([texts[i] for i in order[a:b].tolist()]))
                a = b
            widths = np.zeros(len(texts), np.int64)
            widths[order] = [x.shape[1] for x in parts for _ in range(len(x))]
            flat = np.empty(int(widths.sum()))
            ends = np.cumsum(widths)
            at = 0
            for x in parts:
                rows = order[at : at + len(x)]
                flat[(ends[rows] - widths[rows])[:, None] + np.arange(x.shape[1])] = x
                at += len(x)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([lengths < shape.k, [False]]))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
            if len(texts) < own.num_rows:
                lists = lists.take(coded.indices)
            yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*own.schema.names, "features"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema.fields)
    return seqs.mapInArrow(run, f"{kinds}, features array<double>")


def token_losses(seqs: DataFrame, weights: Weights, shape: Shape = Shape(), share: float = 0.15, seed: int = 12345, tokens: int = 1 << 12) -> DataFrame:
    """seqs (with a key id) and n_masked, loss: the token head's mean cross-entropy at masked positions, whose k-mers the encoder
    doesn't see (zeros stand for them).

    Masks are splits.masked with the seed, so each evaluation has the same. A k-mer with another letter counts as [UNK].
    Sequences without a k-mer have null.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(weights)
    count = F.length("seq") - (shape.k - 1)
    chosen = F.filter(F.sequence(F.lit(0), count - 1), lambda i: unit(seed, F.col("id"), i) < share)
    forced = splits.forced_position("id", count, share, seed)
    rows = seqs.withColumn("_places", F.when(count > 0, F.when(F.size(chosen) > 0, chosen).otherwise(F.array(forced))))
    place, at = rows.columns.index("seq"), rows.columns.index("_places")
    known = {w: i + len(SPECIALS) for i, w in enumerate(words(shape.k))}

    def losses(texts: list[str], places: list[list[int]]) -> list[float]:
        x, mask = one_hot_batch(texts, shape.k)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        pos = np.concatenate([np.array(p, np.int64) for p in places])
        x[row, pos] = 0
        hidden, _ = forward(shared.value, x, mask, shape)
        logits = hidden[row, pos] @ shared.value["token_head.weight"].T + shared.value["token_head.bias"]
        top = logits.max(1)
        wanted = np.array([known.get(texts[r][p : p + shape.k], SPECIALS["[UNK]"]) for r, p in zip(row.tolist(), pos.tolist(), strict=True)])
        own = np.log(np.exp(logits - top[:, None]).sum(1)) + top - logits[np.arange(len(row)), wanted]
        return (np.bincount(row, own, len(texts)) / np.bincount(row, minlength=len(texts))).tolist()

    def run(batches):
        for batch in batches:
            texts, places = batch.column(place).to_pylist(), batch.column(at).to_pylist()
            fine = [i for i, p in enumerate(places) if p]
            found: list[float | None] = [None] * len(texts)
            step = max(1, tokens // max([len(texts[i]) for i in fine], default=1))
            for a in range(0, len(fine), step):
                some = fine[a : a + step]
                for i, loss in zip(some, losses([texts[i] for i in some], [places[i] for i in some]), strict=True):
                    found[i] = loss
            counts = [len(p) if p else None for p in places]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int32()), pa.array(found, pa.float64())], names=[*(n for n in batch.schema.names if n != "_places"), "n_masked", "loss"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, n_masked int, loss double")


def _scaled(gram: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Gram sums of [1, x, y] as those of [1, (x - mean) / std, y]."""
    step = np.diag(np.concatenate([[1.0], 1 / std, [1.0]]))
    step[1:-1, 0] = -mean / std
    return step @ gram @ step.T


def linear_head(cells: dict[str, np.ndarray], rate: float = 1e-2, epochs: int = 2000, patience: int = 50, margin: float = 1e-6, decay: float = 0.0) -> dict[str, float]:
    """A linear head by Adam on squared error, from Gram sums of train, val and test (see ridge.gram_sums).

    A step takes the gradient of all training rows, which the sums give, so rows are read once whatever the epochs are.
    Features are scaled by what train has; the epoch with the best R2 on val is kept.
    """
    n = cells["train"][0, 0]
    mean = cells["train"][0, 1:-1] / n
    std = np.sqrt(np.maximum(np.diag(cells["train"])[1:-1] / n - mean**2, 0))
    scaled = {k: _scaled(g, mean, np.where(std < 1e-8, 1.0, std)) for k, g in cells.items()}
    g = scaled["train"]
    weights = np.concatenate([[g[0, -1] / n], np.zeros(len(mean))])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    best, found, waited = -np.inf, weights, 0
    for step in range(1, epochs + 1):
        slope = 2 * (g[:-1, :-1] @ weights - g[:-1, -1]) / n + decay * np.concatenate([[0.0], weights[1:]])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        score = ridge.scores(scaled["val"], ridge.Fit(weights[1:], float(weights[0])))["r2"]
        if score > best + margin:
            best, found, waited = score, weights, 0
        else:
            waited += 1
            if waited >= patience:
                break
    test = ridge.scores(scaled["test"], ridge.Fit(found[1:], float(found[0])))
    return {"n": int(sum(c[0, 0] for c in cells.values())), "val_r2": float(best), "test_r2": float(test["r2"]), "test_rmse": test["rmse"]}


def head_scores(rows: DataFrame, by: list[str], hidden: tuple[int, ...] = (), **options) -> DataFrame:
    """(by, n, val_r2, test_r2, test_rmse, status): a head for each group of rows (by, split, features, y). Null features are left out.

    A linear head is trained on Gram sums. One with hidden layers by training.trained_heads, in all tasks, all groups of one
    width together; that also gives test_pearson and epochs. A group that fails has its error in status.
    """
    if not hidden:
        return ridge.solved(ridge.gram_sums(rows, [*by, "split"]), by, ["split"], lambda cells: linear_head(cells, **options), "n long, val_r2 double, test_r2 double, test_rmse double")
    spark = rows.sparkSession
    held = ridge.usable(rows, [*by, "split"], "features", "y").persist(StorageLevel.DISK_ONLY)
    has = lambda s: F.count_if(F.col("split") == s).alias(s)
    sizes = held.groupBy(*by).agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("width"), has("train"), has("val"), has("test"))
    kinds = [f for f in rows.schema.fields if f.name in by]
    names = [x.split()[0] for x in training.SCORES.split(", ")]
    out, widths = [], {}
    for r in sizes.collect():  # a row for each group, whose parameters the driver holds anyway
        wrong = f"ValueError: rows of {r['least']} to {r['width']} features" if r["least"] < r["width"] else next((f"ValueError: no rows of {s}" for s in ("train", "val", "test") if not r[s]), None)
        if wrong:
            out.append((*(r[k] for k in by), *[None] * len(names), wrong))
        else:
            widths.setdefault(r["width"], []).append(tuple(r[k] for k in by))
    for width, every in sorted(widths.items()):
        numbers = 4 * sum((a + 1) * b for a, b in zip((width, *hidden), (*hidden, 1), strict=True))
        most = max(1, training.MOST_NUMBERS // numbers)
        for a in range(0, len(every), most):
            own = every[a : a + most]
            numbered = spark.createDataFrame([(*g, i) for i, g in enumerate(own)], StructType([*kinds, StructField("group", IntegerType())]))
            key = lambda df: F.struct(*(df[k] for k in by))  # noqa: E731  nulls are equal within
            mine = held.withColumn("_key", key(held)).join(F.broadcast(numbered.select(key(numbered).alias("_key"), "group")), "_key")
            told = training.trained_heads(mine.withColumn("key", training.row_keys("x", "y")), len(own), hidden, **options)
            out += [(*g, *(x[k] for k in names), "ok") for g, x in zip(own, told.scores, strict=True)]
    held.unpersist()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return spark.createDataFrame(out, f"{fields}, {training.SCORES}, status string")


def compared(seqs: DataFrame, checkpoints: dict[str, Weights], shape: Shape = Shape(), seed: int = 42, kind: str = "hidden_flex", pool: str | None = None, length: int | None = None, **limits) -> DataFrame:
    """A row for each checkpoint: model, seed, n_total, n_train, n_val, n_test, alpha, val_r2, test_r2, test_pearson, test_rmse, status.

    seqs: id, seq and y; pool and length: see encoded. All use the same split by id; a linear head is fitted on each frozen
    encoder's features, with the penalty that val prefers and without a refit, matrix-free (krylov.validated), as flattened
    states are wide. Features are kept on disk between its rounds. A checkpoint that fails has its error in status.
    """
    spark = seqs.sparkSession
    rows = alike(splits.split_by_share(seqs.select("id", "seq", "y"), "id", seed)).persist(StorageLevel.DISK_ONLY)
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    positions = 1 if pool else (length or int(rows.agg(F.max(F.length("seq"))).first()[0] or 0)) - shape.k + 1
    width = positions * {"hidden": shape.width, "flex": shape.targets, "hidden_flex": shape.width + shape.targets}[kind]
    names = ["alpha", "val_r2", "test_r2", "test_pearson", "test_rmse"]
    out = []
    for name, weights in checkpoints.items():
        held = encoded(rows, weights, shape, kind, pool, length=length).select("split", "features", "y").persist(StorageLevel.DISK_ONLY)
        try:
            told = krylov.validated(held, [], width, refit=False, scale=True, **limits).first()
            own = [*(told[k] for k in names), told["status"]]
        except Exception as error:  # noqa: BLE001  one checkpoint doesn't end the others' job
            own = [*[None] * len(names), f"{type(error).__name__}: {error}"[:500]]
        held.unpersist()
        out.append((name, seed, sum(sizes.values()), *(sizes.get(s, 0) for s in ("train", "val", "test")), *own))
    rows.unpersist()
    return spark.createDataFrame(out, "model string, seed int, n_total long, n_train long, n_val long, n_test long, alpha double, val_r2 double, test_r2 double, test_pearson double, test_rmse double, status string")
