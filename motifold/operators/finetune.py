"""Training of the encoder: reverse mode through its layers, gradients summed by all tasks.

A forward pass keeps what each layer needs to go back (a tape), and a backward pass turns slopes of hidden states into those
of weights, of all layers or the last ones. On that stand fine-tuning of the last layer with a head, and training of the
whole encoder on masked tokens and their targets. Steps, mini-batches, best weights and checkpoints are those of training.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.flexibility import SPECIALS, features, token_flexibility, words
from motifold.functions.hashing import mixed
from motifold.operators import encoder, training
from motifold.operators.encoder import FED_TOKENS, Shape, Weights, _fed, _lined, _raised, _with_ones, alike, encoded, one_hot_batch
from motifold.operators.features import _codes, _word_codes
from motifold.operators.sums import Sums, added, block_sums, exact, packed
from motifold.sources.checkpoints import Store

#: Tokens of sequences that a task works on at once.
TOKENS = 1 << 11


def _norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, tuple]:
    """x, which is overwritten, scaled along its last axis."""
    x -= x.mean(-1, keepdims=True)
    scale = 1 / np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / x.shape[-1] + 1e-5)
    x *= scale
    return x * weight + bias, (x, scale, weight)


def _norm_back(grad: np.ndarray, tape: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the input, the weight and the bias."""
    even, scale, weight = tape
    own = grad * weight
    moved = own - even * (np.einsum("...i,...i->...", own, even)[..., None] / own.shape[-1])
    moved -= own.mean(-1, keepdims=True)
    moved *= scale
    return moved, np.einsum("ti,ti->i", grad, even), grad.sum(0)


def forward(weights: Weights, x: np.ndarray, mask: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[dict]]:
    """Hidden states at each position, padding included, as encoder.forward makes them and in the precision of x and weights, and the
    tape, which leaves out the hidden layer of each position: that is made again on the way back."""
    b, n, _ = x.shape
    if n > shape.positions:
        raise ValueError(f"{n} tokens; the encoder has {shape.positions} positions")
    h = _lined(x.reshape(b * n, -1), weights, "input")
    h.reshape(b, n, shape.width)[:] += weights["position"][:n]
    per, tapes = shape.width // shape.heads, []
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
        met = (near @ v).transpose(0, 2, 1, 3).reshape(b * n, shape.width)
        joined = _lined(met, weights, f"{layer}.mix")
        joined += h
        middle, norm1 = _norm(joined, weights[f"{layer}.norm1.weight"], weights[f"{layer}.norm1.bias"])
        fed = _fed(middle, weights, layer)
        fed += middle
        out, norm2 = _norm(fed, weights[f"{layer}.norm2.weight"], weights[f"{layer}.norm2.bias"])
        tapes.append({"in": h, "q": q, "k": k, "v": v, "near": near, "met": met, "norm1": norm1, "middle": middle, "norm2": norm2})
        h = out
    return h.reshape(b, n, shape.width), tapes


def _line_back(grad: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of a linear layer's weight and bias."""
    return grad.T @ value, grad.sum(0)


def _fed_back(grad: np.ndarray, middle: np.ndarray, weights: Weights, layer: str) -> tuple[np.ndarray, Weights]:
    """Slopes of encoder._fed's input and weights, in its blocks."""
    up, down, raised = weights[f"{layer}.up.weight"], weights[f"{layer}.down.weight"], _raised(weights, layer)
    out = np.empty(middle.shape, np.result_type(grad, up))
    lowered, both = np.zeros(down.shape, out.dtype), np.zeros((len(up), len(raised)), out.dtype)  # both: the way up's weights and biases
    held, slopes = (np.empty((FED_TOKENS, len(up)), out.dtype) for _ in range(2))
    middle = _with_ones(middle)
    for a in range(0, len(middle), FED_TOKENS):
        x, g = middle[a : a + FED_TOKENS], grad[a : a + FED_TOKENS]
        hidden, slope = held[: len(x)], slopes[: len(x)]
        np.matmul(x, raised, out=hidden)
        np.maximum(hidden, 0, out=hidden)
        np.matmul(g, down, out=slope)
        slope *= hidden > 0
        lowered += g.T @ hidden
        both += slope.T @ x
        np.matmul(slope, up, out=out[a : a + FED_TOKENS])
    return out, {"down.weight": lowered, "down.bias": grad.sum(0), "up.weight": both[:, :-1], "up.bias": both[:, -1]}


def backward(weights: Weights, x: np.ndarray, tapes: list[dict], grad: np.ndarray, shape: Shape, first: int = 0) -> Weights:
    """Slopes of the weights of layers from `first` on, and, from 0, of the input and positions; grad: slopes of hidden states."""
    b, n, _ = grad.shape
    per, out = shape.width // shape.heads, {}
    part = 1 / float(np.sqrt(per))
    grad = grad.reshape(b * n, shape.width)
    for i in range(shape.layers - 1, first - 1, -1):
        layer, t, own = f"layer{i}", tapes[i], {}
        grad, own["norm2.weight"], own["norm2.bias"] = _norm_back(grad, t["norm2"])
        fed, slopes = _fed_back(grad, t["middle"], weights, layer)
        own |= slopes
        fed += grad
        grad, own["norm1.weight"], own["norm1.bias"] = _norm_back(fed, t["norm1"])
        own["mix.weight"], own["mix.bias"] = _line_back(grad, t["met"])
        met = (grad @ weights[f"{layer}.mix.weight"]).reshape(b, n, shape.heads, per).transpose(0, 2, 1, 3)
        near = met @ t["v"].transpose(0, 1, 3, 2)
        near -= np.einsum("...i,...i->...", near, t["near"])[..., None]
        near *= t["near"]
        near *= part
        qkv = np.empty((b, n, 3, shape.heads, per), grad.dtype)
        for place, made in enumerate((near @ t["k"], near.transpose(0, 1, 3, 2) @ t["q"], t["near"].transpose(0, 1, 3, 2) @ met)):
            qkv[:, :, place] = made.transpose(0, 2, 1, 3)
        qkv = qkv.reshape(b * n, 3 * shape.width)
        own["qkv.weight"], own["qkv.bias"] = _line_back(qkv, t["in"])
        if i > first or first == 0:
            grad = grad + qkv @ weights[f"{layer}.qkv.weight"]
        out |= {f"{layer}.{k}": v for k, v in own.items()}
    if first == 0:
        out["input.weight"], out["input.bias"] = _line_back(grad, x.reshape(b * n, -1))
        out["position"] = np.zeros((shape.positions, shape.width))
        out["position"][:n] = grad.reshape(b, n, -1).sum(0)
    return out


def _batches(texts: list[str]):
    """Places of texts, those of like lengths together, at most TOKENS tokens at once."""
    lengths = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(lengths, kind="stable")
    a = 0
    while a < len(order):
        room = np.flatnonzero(np.arange(1, len(order) - a + 1) * lengths[order[a:]] <= TOKENS)
        b = a + (int(room[-1]) + 1 if len(room) else 1)
        yield order[a:b], [texts[i] for i in order[a:b].tolist()]
        a = b


def _turn(batches: int) -> Column:
    """Which mini-batch of an epoch a row is in, by its key."""
    return F.pmod(F.xxhash64("key", F.lit("batch")), F.lit(batches)).cast("int").alias("turn")


def _tags(batch: pa.RecordBatch):
    """Rows of a batch by split, and of train by turn."""
    codes = pd.DataFrame({"split": batch.column("split").to_pandas(), "turn": batch.column("turn").to_pandas()})
    codes.loc[codes["split"] != "train", "turn"] = -1
    for (split, turn), own in codes.groupby(["split", "turn"], sort=False).indices.items():
        yield split if turn < 0 else f"{split}.{turn}", pa.array(own)


class Tuned(NamedTuple):
    scores: dict[str, float]
    weights: Weights
    state: training.State
    done: bool


def fine_tuned(rows: DataFrame, weights: Weights, shape: Shape = Shape(), hidden: tuple[int, ...] = (64,), rate: float = 1e-3, encoder_rate: float = 1e-5, layers: int = 1, kind: str = "flex", pool: str = "mean", epochs: int = 10, batches: int = 4, patience: int = 5, margin: float = 1e-6, seed: int = 0, store: Store | None = None, most_steps: int | None = None, precision: type = np.float64) -> Tuned:
    """A head on pooled targets (kind flex) or states (hidden) of each sequence, trained with the encoder's last `layers` layers, at a
    rate of its own; the rest stays. With encoder_rate 0, the encoder is frozen, and its features are made once.

    rows: key (long), seq, split (train, val, test), y; rows without a k-mer or with a null y are left out. The best epoch by
    R2 on val is kept, for the scores on test and the weights given. store, most_steps: see training.trained_heads. precision: of
    what the encoder works out; sums over rows, the head and the optimiser are in double precision. rows are read once; their
    blocks, which are kept on disk, once a step. ValueError if a split has no rows.
    """
    first = shape.layers - layers
    frozen = encoder_rate == 0
    names = [n for n in weights if not frozen and n.startswith("layer") and int(n[5 : n.index(".")]) >= first]
    held = rows.select("key", "seq", "split", F.col("y").cast("double").alias("y"), _turn(batches)).where(f"length(seq) >= {shape.k} and y is not null and split in ('train', 'val', 'test')")
    if frozen:
        held = encoded(alike(held), weights, shape, kind, pool, precision=precision).drop("seq")

    def cut(batch: pa.RecordBatch):
        """y, and features of a frozen encoder or else sequences."""
        for tag, own in _tags(batch):
            y = batch.column("y").take(own).to_numpy()
            yield tag, (y, exact(batch.column("features").take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)) if frozen else batch.column("seq").take(own).to_pylist())

    blocks = packed(held, cut)
    try:
        return _fine_tuned(blocks, weights, names, frozen, shape, hidden, rate, encoder_rate, first, kind, pool, epochs, batches, patience, margin, seed, store, most_steps, precision)
    finally:
        blocks.unpersist()


def _fine_tuned(blocks: RDD, weights: Weights, names: list[str], frozen: bool, shape: Shape, hidden: tuple[int, ...], rate: float, encoder_rate: float, first: int, kind: str, pool: str, epochs: int, batches: int, patience: int, margin: float, seed: int, store: Store | None, most_steps: int | None, precision: type) -> Tuned:
    """fine_tuned on its blocks."""
    trains = tuple(f"train.{t}" for t in range(batches))
    tags = {"train": trains, "val": ("val",), "test": ("test",)}
    known = {}
    for split, own in tags.items():
        told = block_sums(blocks, lambda block: {"n": np.array(float(len(block[0]))), "y": np.array(block[0].sum())}, 2, own)
        if not told:
            raise ValueError(f"no rows of {split}")
        mean = float(told["y"] / told["n"])
        squares = block_sums(blocks, lambda block, mean=mean: {"squares": np.array(((block[0] - mean) ** 2).sum())}, 1, own)
        known[split] = {"n": int(told["n"]), "mean": mean, "squares": float(squares["squares"])}
    heads = training.Heads((shape.targets if kind == "flex" else shape.width, *hidden, 1))
    params = heads.start(seed, np.array([known["train"]["mean"]])) | {n: weights[n].copy() for n in names}
    state = training.begun(params, training.first_best(params, 1))
    if store is not None and (saved := store.load()):
        state = training.State.of(saved[0], saved[1])
    context = blocks.context
    numbers = sum(p.size for p in params.values())
    rest = context.broadcast({n: x.astype(precision) for n, x in weights.items() if n not in names})
    sent = lambda params: context.broadcast({n: x.astype(precision) if n in names else x for n, x in params.items()})

    def pooled(weights: Weights, texts: list[str], back: bool = True):
        x, mask = one_hot_batch(texts, shape.k)
        x = x.astype(precision)
        if not back:
            values = encoder.forward(weights, x, mask, shape)[kind == "flex"]
            return values.sum(1) / mask.sum(1)[:, None] if pool == "mean" else np.where(mask[..., None], values, -np.inf).max(1)
        h, tapes = forward(weights, x, mask, shape)
        values = h @ weights["target_head.weight"].T + weights["target_head.bias"] if kind == "flex" else h
        if pool == "mean":
            return x, mask, tapes, (values * mask[..., None]).sum(1) / mask.sum(1)[:, None], None
        values = np.where(mask[..., None], values, -np.inf)
        return x, mask, tapes, values.max(1), values.argmax(1)

    def slopes_of(state: training.State) -> training.Params:
        shared = sent(state.params)

        def part(block) -> Sums:
            params, weights, out = shared.value, rest.value | shared.value, {}
            y, given = block
            if frozen:
                values, kept = heads.forward(params, 0, given.astype(np.float64, copy=False))
                return {n: s[None] for n, s in heads.slopes(params, 0, values, kept, y).items()} | {"n": np.array(float(len(y)))}
            for own, texts in _batches(given):
                x, mask, tapes, features, top = pooled(weights, texts)
                values, kept = heads.forward(params, 0, features)
                slopes, grad = heads.slopes_and_input(params, 0, values, kept, y[own])
                sums: Sums = {n: s[None] for n, s in slopes.items()} | {"n": np.array(float(len(own)))}
                if top is None:
                    grad = (grad / mask.sum(1)[:, None])[:, None] * mask[..., None]
                else:
                    spread = np.zeros((*mask.shape, grad.shape[1]))
                    np.put_along_axis(spread, top[:, None], grad[:, None], 1)
                    grad = spread
                grad = grad.astype(precision)
                if kind == "flex":
                    grad = grad @ weights["target_head.weight"]
                sums |= {n: s for n, s in backward(weights, x, tapes, grad, shape, first).items() if n in names}
                out = added(out, sums)
            return out

        found = block_sums(blocks, part, numbers, (trains[state.step % batches],))
        shared.destroy()
        return {n: found.get(n, np.zeros_like(p)) / max(1.0, float(found.get("n", 0))) for n, p in state.params.items()}

    def squares_of(params: training.Params, split: str) -> float:
        shared = sent(params)

        def part(block) -> Sums:
            weights, left, (y, given) = rest.value | shared.value, 0.0, block
            every = [(slice(None), given.astype(np.float64, copy=False))] if frozen else ((own, pooled(weights, texts, False)) for own, texts in _batches(given))
            for own, features in every:
                left += ((heads.forward(shared.value, 0, features)[0][-1][:, 0] - y[own]) ** 2).sum()
            return {"left": np.array(left)}

        found = block_sums(blocks, part, 1, tags[split])
        shared.destroy()
        return float(found["left"])

    r2 = lambda params, split: 1 - squares_of(params, split) / max(known[split]["squares"], 1e-12)
    rates = {n: encoder_rate if n in names else rate for n in params}
    state, done = training.descended(state, slopes_of, lambda p: np.array([r2(p, "val")]), rates, epochs, batches, patience, margin, store, most_steps)
    scores = {"n": sum(r["n"] for r in known.values()), "val_r2": float(state.best["score"][0]), "test_r2": r2(state.best, "test") if done else None, "epochs": int(state.best["epoch"][0])}
    return Tuned(scores, weights | {n: state.best[n] for n in names}, state, done)


def masks(keys: np.ndarray, counts: np.ndarray, step: int, share: float) -> list[np.ndarray]:
    """Masked positions of each sequence, by its key, the step and the place alone: each with the given chance, else one."""
    out = []
    for key, count in zip(keys.view(np.uint64).tolist(), counts.tolist(), strict=True):
        turn = (key ^ step * 0x9E3779B97F4A7C15) % (1 << 64)
        drawn = (mixed(mixed(np.arange(count, dtype=np.uint64) + np.uint64(turn)) + np.uint64(1)) >> np.uint64(11)) / float(1 << 53)
        chosen = np.flatnonzero(drawn < share)
        out.append(chosen if len(chosen) else np.array([int(drawn.argmin())]))
    return out


def pretrained(rows: DataFrame, weights: Weights, shape: Shape = Shape(), rate: float = 1e-3, token_weight: float = 1.0, target_weight: float = 1.0, share: float = 0.15, stats: tuple[np.ndarray, np.ndarray] | None = None, best: str = "all", epochs: int = 4, batches: int = 8, patience: int = 4, margin: float = 1e-6, store: Store | None = None, most_steps: int | None = None, precision: type = np.float64) -> Tuned:
    """The whole encoder trained on masked k-mers: cross-entropy of the token head at masked positions, and Huber loss of the target
    head against each k-mer's flexibility (scaled by stats, means and deviations) at all, weighted and added.

    rows: key (long), seq, split (train, val). Masks of training are new in each step, those of val always the same. A k-mer
    with another letter counts as [UNK] and has no targets. Masked losses count by their expected number, share times the
    tokens. The epoch of the smallest loss on val, of targets or in all (best), is kept; scores: val_loss, token_loss,
    target_loss, start_loss (of the weights given) and epochs. store, most_steps: see training.trained_heads; precision: see fine_tuned.
    """
    held = rows.select("key", "seq", "split", _turn(batches)).where(f"length(seq) >= {shape.k} and split in ('train', 'val')")
    blocks = packed(held, lambda batch: ((tag, (batch.column("key").take(own).to_numpy(), batch.column("seq").take(own).to_pylist())) for tag, own in _tags(batch)))
    try:
        return _pretrained(blocks, weights, shape, rate, token_weight, target_weight, share, stats, best, epochs, batches, patience, margin, store, most_steps, precision)
    finally:
        blocks.unpersist()


def _pretrained(blocks: RDD, weights: Weights, shape: Shape, rate: float, token_weight: float, target_weight: float, share: float, stats: tuple[np.ndarray, np.ndarray] | None, best: str, epochs: int, batches: int, patience: int, margin: float, store: Store | None, most_steps: int | None, precision: type) -> Tuned:
    """pretrained on its blocks."""
    context, numbers = blocks.context, sum(x.size for x in weights.values())
    every = words(shape.k)
    values = np.array([[token_flexibility(w, f) for f in features()] for w in every])[:, : shape.targets]
    mean, std = stats or (values.mean(0), np.where(values.std(0) < 1e-8, 1.0, values.std(0)))
    known = context.broadcast(((values - mean) / std).astype(precision))
    state = training.begun({n: x.astype(float) for n, x in weights.items()}, training.first_best(dict(weights), 1))
    if store is not None and (saved := store.load()):
        state = training.State.of(saved[0], saved[1])

    def passed(params: training.Params, tag: str, step: int, back: bool) -> Sums:
        shared = context.broadcast({n: params[n].astype(precision) for n in weights})

        def part(block) -> Sums:
            weights, wanted, (keys, given), out = shared.value, known.value, block, {}
            for own, texts in _batches(given):
                x, mask = one_hot_batch(texts, shape.k)
                hidden_at = masks(keys[own], mask.sum(1), step, share)
                row, pos = np.repeat(np.arange(len(own)), [len(p) for p in hidden_at]), np.concatenate(hidden_at)
                x[row, pos] = 0
                x = x.astype(precision)
                h, tapes = forward(weights, x, mask, shape) if back else (encoder.forward(weights, x, mask, shape)[0], [])
                codes = _word_codes(_codes(texts, mask.shape[1] + shape.k - 1), shape.k)
                codes = np.where(mask & (codes < 4**shape.k), codes, -1)
                every_row, every_pos = np.nonzero(codes >= 0)
                seen, told = h[row, pos], h[every_row, every_pos]
                token = np.where(codes[row, pos] < 0, SPECIALS["[UNK]"], codes[row, pos] + len(SPECIALS))
                logits = seen @ weights["token_head.weight"].T + weights["token_head.bias"]
                chance = np.exp(logits - logits.max(1, keepdims=True))
                total = chance.sum(1, keepdims=True)
                loss = np.log(total[:, 0]) + logits.max(1) - logits[np.arange(len(row)), token]
                away = told @ weights["target_head.weight"].T + weights["target_head.bias"] - wanted[codes[every_row, every_pos]]
                huber = np.where(np.abs(away) <= 1, away**2 / 2, np.abs(away) - 0.5).mean(1).sum()
                sums: Sums = {"masked": np.array(float(len(row))), "tokens": np.array(float(mask.sum())), "told": np.array(float(len(told))), "token_loss": np.array(loss.sum()), "target_loss": np.array(huber)}
                if back:
                    guess = chance / total
                    guess[np.arange(len(row)), token] -= 1
                    guess, pull = token_weight / share * guess, target_weight * np.clip(away, -1, 1) / shape.targets
                    sums |= {"token_head.weight": guess.T @ seen, "token_head.bias": guess.sum(0), "target_head.weight": pull.T @ told, "target_head.bias": pull.sum(0)}
                    grad = np.zeros_like(h)
                    grad[row, pos] = guess @ weights["token_head.weight"]
                    grad[every_row, every_pos] += pull @ weights["target_head.weight"]
                    sums |= backward(weights, x, tapes, grad, shape)
                out = added(out, sums)
            return out

        found = block_sums(blocks, part, numbers if back else 8, (tag,))
        shared.destroy()
        return found

    def slopes_of(state: training.State) -> training.Params:
        found = passed(state.params, f"train.{state.step % batches}", state.step, True)
        return {n: found.get(n, np.zeros_like(p)) / max(1.0, float(found.get("tokens", 0))) for n, p in state.params.items()}

    latest: list[tuple[training.Params, tuple[float, float]]] = []

    def losses(params: training.Params) -> tuple[float, float]:
        if latest and all(np.array_equal(latest[0][0][n], params[n]) for n in weights):
            return latest[0][1]  # the best weights are often those of the last pass
        latest[:] = [(params, measured(params))]
        return latest[0][1]

    def measured(params: training.Params) -> tuple[float, float]:
        found = passed(params, "val", -1, False)
        if not found:
            raise ValueError("no rows of val")
        return float(found["token_loss"] / found["masked"]), float(found["target_loss"] / max(1.0, found["told"]))

    total = lambda x: token_weight * x[0] + target_weight * x[1]
    start = total(losses(weights))
    state, done = training.descended(state, slopes_of, lambda p: np.array([-(losses(p)[1] if best == "targets" else total(losses(p)))]), rate, epochs, batches, patience, margin, store, most_steps)
    found = {n: state.best[n] for n in weights}
    token, target = losses(found)
    return Tuned({"start_loss": start, "val_loss": total((token, target)), "token_loss": token, "target_loss": target, "epochs": int(state.best["epoch"][0])}, found, state, done)
