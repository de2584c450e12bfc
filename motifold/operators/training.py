"""Training by gradients that all tasks sum: one algorithm for tables of any size.

Rows are dealt to mini-batches by a hash of their key, dropout is drawn by a hash of step, key and unit, and a step is one
job over its mini-batch, whose sums meet in a tree of tasks; so a run is the same for any partitioning, but for the order in
which floating-point numbers are added. Many groups are trained side by side, each stopped by its own validation rows. A
state can be saved every few steps and resumed with its optimiser's moments.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.hashing import mixed
from motifold.operators.sums import Sums, block_sums, exact, packed
from motifold.sources.checkpoints import Store

Params = dict[str, np.ndarray]
#: Numbers of parameters and moments that the driver holds at once (2 GB); groups beyond go in turns.
MOST_NUMBERS = 1 << 28


class State(NamedTuple):
    step: int
    params: Params
    first: Params
    second: Params
    best: Params

    def arrays(self) -> Params:
        parts = zip(("param", "first", "second", "best"), self[1:], strict=True)
        return {f"{kind}.{name}": x for kind, own in parts for name, x in own.items()}

    @staticmethod
    def of(step: int, arrays: Params) -> State:
        split = lambda kind: {n.partition(".")[2]: x for n, x in arrays.items() if n.startswith(f"{kind}.")}
        return State(step, *(split(kind) for kind in ("param", "first", "second", "best")))


def begun(params: Params, best: Params) -> State:
    zeros = {n: np.zeros_like(x) for n, x in params.items()}
    return State(0, params, zeros, {n: x.copy() for n, x in zeros.items()}, best)


def adam(state: State, slopes: Params, rate: float | dict[str, float], live: np.ndarray | None = None) -> State:
    """The next state. rate: of all parameters, or by name (one that isn't named stays). live: which groups (first axis) move."""
    step = state.step + 1
    params, first, second = dict(state.params), dict(state.first), dict(state.second)
    for name, slope in slopes.items():
        own = rate.get(name, 0.0) if isinstance(rate, dict) else rate
        if own == 0:
            continue
        first[name] = 0.9 * first[name] + 0.1 * slope
        second[name] = 0.999 * second[name] + 0.001 * slope**2
        moved = params[name] - own * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        params[name] = moved if live is None else np.where(live.reshape(-1, *[1] * (moved.ndim - 1)), moved, params[name])
    return state._replace(step=step, params=params, first=first, second=second)


def dropped(keys: np.ndarray, step: int, layer: int, units: int, share: float) -> np.ndarray:
    """Rows x units: 0 for units that are left out, else what makes up for them; by key, step, layer and unit alone."""
    turn = ((step << 8 | layer) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    unit = mixed(np.arange(units, dtype=np.uint64) + np.uint64(turn))
    drawn = mixed(keys.view(np.uint64)[:, None] ^ unit) >> np.uint64(11)
    return (drawn >= np.uint64(int(share * (1 << 53)))) / (1 - share)


class Heads(NamedTuple):
    """Heads of all groups: layer i of group g is x @ w{i}[g] + b{i}[g], with max(0, .) between layers."""

    widths: tuple[int, ...]
    dropout: float = 0.0

    def start(self, seed: int, middle: np.ndarray) -> Params:
        random = np.random.default_rng(seed)
        out = {}
        for i, (a, b) in enumerate(zip(self.widths, self.widths[1:], strict=False)):
            own = random.uniform(-1, 1, (a, b)) / np.sqrt(a)
            out |= {f"w{i}": np.repeat(own[None], len(middle), 0), f"b{i}": np.zeros((len(middle), b))}
        out[f"b{len(self.widths) - 2}"] += middle[:, None]
        return out

    def forward(self, params: Params, g: int, x: np.ndarray, keys: np.ndarray | None = None, step: int = 0) -> tuple[list[np.ndarray], list]:
        """Values of each layer, the input's first; and what dropout does to each, if keys are given."""
        values, kept, last = [x], [1.0], len(self.widths) - 2
        for i in range(last + 1):
            z = values[-1] @ params[f"w{i}"][g] + params[f"b{i}"][g]
            kept.append(dropped(keys, step, i, z.shape[1], self.dropout) if self.dropout and keys is not None and i < last else 1.0)
            values.append(np.maximum(z, 0) * kept[-1] if i < last else z)
        return values, kept

    def slopes(self, params: Params, g: int, values: list[np.ndarray], kept: list, y: np.ndarray) -> Params:
        """Of the sum of squared errors over rows."""
        return self.slopes_and_input(params, g, values, kept, y)[0]

    def slopes_and_input(self, params: Params, g: int, values: list[np.ndarray], kept: list, y: np.ndarray) -> tuple[Params, np.ndarray]:
        """slopes, and the slope of each row's input."""
        grad, out = 2 * (values[-1] - y[:, None]), {}
        for i in range(len(self.widths) - 2, -1, -1):
            out |= {f"w{i}": values[i].T @ grad, f"b{i}": grad.sum(0)}
            grad = grad @ params[f"w{i}"][g].T
            grad = grad * (values[i] > 0) * kept[i] if i else grad
        return out, grad


def row_keys(*columns: str | Column) -> Column:
    """A 64-bit key of each row by its content, so equal rows have equal draws."""
    return F.xxhash64(*columns)


SCORES = "n long, val_r2 double, test_r2 double, test_pearson double, test_rmse double, epochs int"


def descended(state: State, slopes_of: Callable[[State], Params], score_of: Callable[[Params], np.ndarray], rate: float | dict[str, float], epochs: int, batches: int, patience: int, margin: float, store: Store | None = None, most_steps: int | None = None) -> tuple[State, bool]:
    """Steps of Adam until no group goes on: the state, and whether it is the last. After every epoch of `batches` steps each
    group's score (higher is better) decides whether its parameters are the best so far and whether it goes on; the state is
    saved then, if there is a store. state.best holds, beside parameters, score, epoch and waited of each group."""
    steps = 0
    live = state.best["waited"] < patience
    while live.any() and state.step < epochs * batches:
        if most_steps is not None and steps >= most_steps:
            return state, False
        state = adam(state, slopes_of(state), rate, live)
        steps += 1
        if state.step % batches == 0:
            score = score_of(state.params)
            better = live & (score > state.best["score"] + margin)
            best = {k: np.where(better.reshape(-1, *[1] * (x.ndim - 1)), x, state.best[k]) for k, x in state.params.items()}
            best |= {"score": np.where(better, score, state.best["score"]), "epoch": np.where(better, state.step // batches, state.best["epoch"]), "waited": np.where(better, 0, state.best["waited"] + live)}
            state = state._replace(best=best)
            live = best["waited"] < patience
            if store is not None:
                store.save(state.step, state.arrays(), {"epoch": state.step // batches})
    return state, True


def first_best(params: Params, groups: int) -> Params:
    return params | {"score": np.full(groups, -np.inf), "epoch": np.zeros(groups), "waited": np.zeros(groups)}


class Trained(NamedTuple):
    scores: list[dict[str, float]]  #: by group
    state: State
    done: bool  #: whether all epochs were run, or no group improved any more


def trained_heads(rows: DataFrame, groups: int, hidden: tuple[int, ...] = (), rate: float = 1e-3, epochs: int = 30, patience: int = 5, batches: int = 4, margin: float = 1e-6, decay: float = 0.0, dropout: float = 0.0, seed: int = 0, store: Store | None = None, most_steps: int | None = None, scale: bool = True) -> Trained:
    """Heads with hidden layers on rows (group int, split, key long, x array<double>, y double) of any number, by Adam on squared
    error plus decay / 2 |w|^2, in `batches` steps an epoch; features are scaled by what train has.

    Each group keeps the epoch with the best R2 on val, and stops after `patience` epochs without. With a store, the state
    is saved after every epoch, and a run that was ended, by most_steps or a fault, goes on from there. rows are read once; their
    blocks, which are kept on disk, once a step. ValueError for a group without training rows.
    """
    dealt = F.pmod(F.xxhash64("key", F.lit("batch")), F.lit(batches))
    rows = rows.select("group", "split", "key", "x", "y", dealt.alias("turn")).where("x is not null and y is not null and not exists(x, v -> v is null)")

    def cut(batch: pa.RecordBatch):
        """By split, and of train by mini-batch: rows of a group."""
        group, split, keys = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
        lists, y, turn = batch.column(3), batch.column(4).to_numpy(), batch.column(5).to_numpy()
        sizes = lists.value_lengths().to_numpy()
        if len(np.unique(sizes)) > 1:
            raise ValueError("rows of different widths")
        x = exact(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        for s, t in (*(("train", t) for t in range(batches)), ("val", None), ("test", None)):
            some = np.flatnonzero((split == s) & ((turn == t) | (t is None)))
            every = [(g, some[group[some] == g]) for g in np.unique(group[some]).tolist()]
            if every:
                yield s if t is None else f"{s}.{t}", [(g, s, keys[own], x[own], y[own]) for g, own in every]

    blocks = packed(rows, cut)
    try:
        return _trained(blocks, rows.sparkSession.sparkContext, groups, hidden, rate, epochs, patience, batches, margin, decay, dropout, seed, store, most_steps, scale)
    finally:
        blocks.unpersist()


def _trained(blocks: RDD, context: SparkContext, groups: int, hidden: tuple[int, ...], rate: float, epochs: int, patience: int, batches: int, margin: float, decay: float, dropout: float, seed: int, store: Store | None, most_steps: int | None, scale: bool) -> Trained:
    """trained_heads on its blocks."""

    def moments(block) -> Sums:
        out: Sums = {}
        for g, s, _, x, y in block:
            x = x.astype(np.float64, copy=False)
            out |= {f"{s}.{g}": np.array([len(y), y.sum(), (y**2).sum()])} | ({f"x.{g}": x.sum(0), f"xx.{g}": (x**2).sum(0)} if s == "train" else {})
        return out

    found = block_sums(blocks, moments, groups * 1024)
    if missing := [g for g in range(groups) if f"train.{g}" not in found]:
        raise ValueError(f"no training rows in {len(missing)} of {groups} groups")
    n = {s: np.array([found.get(f"{s}.{g}", np.zeros(3)) for g in range(groups)]) for s in ("train", "val", "test")}
    mean = np.stack([found[f"x.{g}"] / found[f"train.{g}"][0] for g in range(groups)])
    std = np.sqrt(np.maximum(np.stack([found[f"xx.{g}"] / found[f"train.{g}"][0] for g in range(groups)]) - mean**2, 0))
    std = np.where(std < 1e-8, 1.0, std)
    if not scale:
        mean, std = np.zeros_like(mean), np.ones_like(std)
    heads = Heads((mean.shape[1], *hidden, 1), dropout)
    fresh = heads.start(seed, n["train"][:, 1] / n["train"][:, 0])
    state = begun(fresh, first_best(fresh, groups))
    if store is not None and (saved := store.load()):
        state = State.of(saved[0], saved[1])
    numbers = sum(x.size for x in fresh.values())

    def slopes_of(state: State) -> Params:
        shared = context.broadcast((state.params, mean, std, state.step))

        def part(block) -> Sums:
            params, mean, std, step = shared.value
            out: Sums = {}
            for g, _, keys, x, y in block:
                values, kept = heads.forward(params, g, (x - mean[g]) / std[g], keys, step)
                out |= {f"{k}.{g}": v for k, v in heads.slopes(params, g, values, kept, y).items()} | {f"n.{g}": np.array(float(len(y)))}
            return out

        found = block_sums(blocks, part, numbers, (f"train.{state.step % batches}",))
        shared.destroy()
        zero = {k: np.zeros(x.shape[1:]) for k, x in state.params.items()}
        return {k: np.stack([found.get(f"{k}.{g}", zero[k]) / max(1.0, float(found.get(f"n.{g}", 0))) for g in range(groups)]) + (decay * x if k[0] == "w" else 0) for k, x in state.params.items()}

    def scores_of(params: Params, *splits: str) -> dict[str, np.ndarray]:
        """By split, groups x (rows, squares left, y, yy, p, pp, yp), y and p being less the mean of training rows."""
        shared = context.broadcast((params, mean, std, n["train"][:, 1] / n["train"][:, 0]))

        def part(block) -> Sums:
            params, mean, std, middle = shared.value
            out: Sums = {}
            for g, s, _, x, y in block:
                p, y = heads.forward(params, g, (x - mean[g]) / std[g])[0][-1][:, 0] - middle[g], y - middle[g]
                out[f"{s}.{g}"] = np.array([len(y), ((y - p) ** 2).sum(), y.sum(), (y * y).sum(), p.sum(), (p * p).sum(), (y * p).sum()])
            return out

        found = block_sums(blocks, part, 7 * groups, splits)
        shared.destroy()
        return {s: np.stack([found.get(f"{s}.{g}", np.zeros(7)) for g in range(groups)]) for s in splits}

    def r2(x: np.ndarray) -> np.ndarray:
        return 1 - x[:, 1] / np.maximum(x[:, 3] - x[:, 2] ** 2 / np.maximum(x[:, 0], 1), 1e-12)

    state, done = descended(state, slopes_of, lambda params: r2(scores_of(params, "val")["val"]), rate, epochs, batches, patience, margin, store, most_steps)
    if not done:
        return Trained([], state, False)
    out = []
    for g, (x, val) in enumerate(zip(scores_of(state.best, "test")["test"], state.best["score"], strict=True)):
        rows_, left, y, yy, p, pp, yp = x
        total, spread, both = yy - y * y / max(rows_, 1), pp - p * p / max(rows_, 1), yp - y * p / max(rows_, 1)
        pearson = both / np.sqrt(total * spread) if total > 0 and spread > 0 else 0.0
        size = int(sum(n[s][g, 0] for s in n))
        out.append({"n": size, "val_r2": float(val), "test_r2": float(1 - left / max(total, 1e-12)), "test_pearson": float(pearson), "test_rmse": float(np.sqrt(left / max(rows_, 1))), "epochs": int(state.best["epoch"][g])})
    return Trained(out, state, True)
