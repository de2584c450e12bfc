"""Ridge regression without a matrix of the features: one Krylov space for each training set serves every penalty.

The Lanczos process on centred X'X, begun at X'y, spans the same space whatever the penalty is, so a round of it is one pass
over the rows, which sums X'(Xv) for all training sets at once, and every penalty is then a small tridiagonal system.
Rows are packed once into blocks of numpy arrays, kept on disk, so that a round is one short job of as many tasks as there are
slots. Tasks hand on one block of sums each, combined in a tree if they are many. Wide rows of few ones are handed in as the places of these.
The driver holds the bases: width x rounds numbers for each training set of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from motifold.operators.ridge import ALPHAS, Fit, _scored
from motifold.operators.sums import Sums, block_sums, packed, tree_sums

#: A fit is done where the residual of its equations is so small a share of X'y.
TOLERANCE = 1e-10
MOST_ROUNDS = 500
#: Numbers of one block of vectors (width x training sets), of which a pass has one in each task (128 MB).
MOST_NUMBERS = 1 << 24
#: Numbers of all bases that the driver holds (2 GB).
MOST_BASIS = 1 << 28
#: Rows of a block, and numbers (features, places, sets) beyond which it has fewer.
BLOCK_ROWS, BLOCK_NUMBERS = 1 << 12, 1 << 20


class Solved(NamedTuple):
    fits: list[Fit]  #: by penalty
    rounds: int
    residual: float  #: largest of all penalties, as a share of X'y
    mean_y: float


class _Batch(NamedTuple):
    """Rows of features (dense, or places of ones), y, and which training sets each is in. Rows of fewer places than the longest have
    the place after the last one."""

    x: np.ndarray | None
    places: np.ndarray
    y: np.ndarray
    member: np.ndarray

    def times(self, v: np.ndarray) -> np.ndarray:
        """X v: rows x columns."""
        if self.x is not None:
            return self.x @ v
        return np.stack([np.append(c, 0.0)[self.places].sum(1) for c in v.T], 1)

    def back(self, u: np.ndarray, width: int) -> np.ndarray:
        """X' u: width x columns."""
        if self.x is not None:
            return self.x.T @ u
        return np.stack([np.bincount(self.places.ravel(), np.repeat(c, self.places.shape[1]), width + 1)[:width] for c in u.T], 1)

    def squares(self, width: int) -> np.ndarray:
        """Sums of squares of features by set."""
        if self.x is not None:
            return (self.x**2).T @ self.member
        return self.back(self.member, width)


def _parts(batch: pa.RecordBatch, width: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns features, y, sets of at most so many rows at once: features in a row (or places, rows of like numbers together,
    filled up to the longest), y, sets, and their number by row."""
    sizes = batch.column(0).value_lengths().to_numpy()
    dense = not pa.types.is_integer(batch.schema.field(0).type.value_type)
    if dense and (sizes != width).any():
        raise ValueError(f"rows of other than {width} features")
    order, a = np.arange(len(sizes)) if dense else np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        room = 1 if dense else np.flatnonzero(np.arange(1, len(order) - a + 1)[:most] * sizes[order[a : a + most]] <= BLOCK_NUMBERS)
        b = a + (most if dense else int(room[-1]) + 1 if len(room) else 1)
        own = batch.take(pa.array(order[a:b]))
        lists, chosen, a = own.column(0), own.column(2), b
        values, many = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
        if dense:
            values = values.reshape(-1, width)
        else:
            if len(values) and not 0 <= values.min() <= values.max() < width:
                raise ValueError(f"rows of other than {width} features")
            filled = np.full((len(many), int(many.max())), width, np.uint16 if width < 1 << 16 else np.int32)
            filled[np.arange(filled.shape[1]) < many[:, None]] = values
            values = filled
        yield values, own.column(1).to_numpy(), chosen.flatten().to_numpy(zero_copy_only=False), chosen.value_lengths().to_numpy()


def _batch(parts: tuple[np.ndarray, ...], width: int, sets: int) -> _Batch:
    values, y, chosen, many = parts
    member = np.zeros((len(y), sets))
    member[np.repeat(np.arange(len(y)), many), chosen] = 1
    if values.dtype.kind == "f":
        return _Batch(values, np.zeros((0, 0), np.int64), y, member)
    return _Batch(None, values.astype(np.int64), y, member)


def _batches(batch: pa.RecordBatch, width: int, sets: int) -> Iterator[_Batch]:
    """Columns features, y, sets; at most 512 rows at once."""
    for parts in _parts(batch, width, 512):
        yield _batch(parts, width, sets)


def _packed(rows: DataFrame, width: int, sets: int) -> RDD:
    """Blocks of rows (see _parts), a bytes object each, kept on disk."""
    dense = "double" in rows.schema["x"].dataType.simpleString()
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(sets, width if dense else 1)))

    return packed(rows, lambda batch: (("", parts) for parts in _parts(batch, width, most)))


def _rows(rows: DataFrame, features: str, y: str, sets: Column) -> DataFrame:
    kind = rows.schema[features].dataType.elementType.simpleString()
    wanted = "array<int>" if kind in ("int", "bigint", "smallint", "tinyint") else "array<double>"
    out = rows.select(F.col(features).cast(wanted).alias("x"), F.col(y).cast("double").alias("y"), sets.cast("array<int>").alias("sets"))
    return out.where("x is not null and y is not null and sets is not null and not exists(x, v -> v is null)")


def fits(rows: DataFrame, width: int, sets: Column, count: int, alphas: tuple[float, ...] = ALPHAS, features: str = "features", y: str = "y", scale: bool = False, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> list[Solved]:
    """A ridge fit for each penalty on each of `count` training sets; sets: an array of those that a row is in.

    features: an array of `width` numbers, or of the places (ints) of ones among so many. The intercept is free; with scale,
    features are divided by their deviation in the set (one under 1e-8: 1), the weights being for features as they are.
    Rows with a null are left out. rows are read once; their blocks, which are kept on disk, once a round. ValueError for a set without rows,
    or for rows of another width.
    """
    out: list[Solved] = []
    step = max(1, MOST_NUMBERS // width)
    for first in range(0, count, step):
        own = range(first, min(count, first + step))
        moved = F.transform(F.filter(sets, lambda s: s.between(own.start, own.stop - 1)), lambda s: s - first)
        out += _fits(_rows(rows, features, y, moved), width, len(own), alphas, scale, tolerance, most_rounds)
    return out


def _fits(rows: DataFrame, width: int, sets: int, alphas: tuple[float, ...], scale: bool, tolerance: float, most_rounds: int) -> list[Solved]:
    blocks = _packed(rows, width, sets)
    try:
        return _fits_of(blocks, width, sets, alphas, scale, tolerance, most_rounds)
    finally:
        blocks.unpersist()


def _small(t: np.ndarray, e: np.ndarray, alphas: tuple[float, ...]) -> list[np.ndarray]:
    """(t + alpha) x = e for each penalty; t has no negative value, so only a penalty of 0 may need the least squares."""
    try:
        return [np.linalg.solve(t + a * np.eye(len(t)), e) for a in alphas]
    except np.linalg.LinAlgError:
        return [np.linalg.lstsq(t + a * np.eye(len(t)), e, rcond=None)[0] for a in alphas]


def _fits_of(blocks: RDD, width: int, sets: int, alphas: tuple[float, ...], scale: bool, tolerance: float, most_rounds: int) -> list[Solved]:
    context = blocks.context

    def moments(parts: tuple[np.ndarray, ...]) -> Sums:
        b = _batch(parts, width, sets)
        told = b.member * b.y[:, None]
        return {"n": b.member.sum(0), "y": told.sum(0), "x": b.back(b.member, width), "xy": b.back(told, width), "xx": b.squares(width)}

    found = block_sums(blocks, moments, 3 * width * sets)
    if not found or (found["n"] == 0).any():
        raise ValueError("a training set has no rows")
    n, mean_y, mean = found["n"], found["y"] / found["n"], found["x"] / found["n"]
    std = np.sqrt(np.maximum(found["xx"] / n - mean**2, 0))
    by = np.where(std < 1e-8, 1.0, std) if scale else np.ones_like(std)
    start = (found["xy"] - n * mean * mean_y) / by
    beta0 = np.linalg.norm(start, axis=0)
    active = np.flatnonzero(beta0 > 0)
    bases: list[list[np.ndarray]] = [[] for _ in range(sets)]
    diagonal: list[list[float]] = [[] for _ in range(sets)]
    beside: list[list[float]] = [[] for _ in range(sets)]
    weights, left = np.zeros((sets, len(alphas), width)), np.zeros(sets)
    for s in active.tolist():
        bases[s].append(start[:, s] / beta0[s])

    def products(v: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Centred and scaled X'Xv of training sets `own`, a column each."""
        shared = context.broadcast((v / by[:, own], ((mean[:, own] / by[:, own]) * v).sum(0)))

        def part(parts: tuple[np.ndarray, ...]) -> Sums:
            b = _batch(parts, width, sets)
            u = (b.times(shared.value[0]) - shared.value[1]) * b.member[:, own]
            return {"back": b.back(u, width), "u": u.sum(0)}

        found = block_sums(blocks, part, width * len(own))
        shared.destroy()
        return (found["back"] - mean[:, own] * found["u"]) / by[:, own]

    rounds = 0
    while len(active) and rounds < most_rounds and (rounds + 1) * width * sets <= max(MOST_BASIS, 2 * width * sets):
        rounds += 1
        w = products(np.stack([bases[s][-1] for s in active], 1), active)
        going = []
        for k, s in enumerate(active.tolist()):
            basis, own = np.stack(bases[s]), w[:, k]
            diagonal[s].append(float(basis[-1] @ own))
            for _ in range(2):  # orthogonal to all before, rounding notwithstanding
                own = own - basis.T @ (basis @ own)
            beta = float(np.linalg.norm(own))
            t = np.diag(diagonal[s]) + np.diag(beside[s], 1) + np.diag(beside[s], -1)
            e = np.zeros(len(t))
            e[0] = beta0[s]
            z = _small(t, e, alphas)
            left[s] = max(abs(x[-1]) for x in z) * beta / beta0[s]
            scale_of = max(abs(x) for x in diagonal[s])
            if left[s] <= tolerance or beta <= 1e-14 * scale_of or len(t) >= width:
                weights[s] = np.stack([basis.T @ x for x in z])
                left[s] = left[s] if beta > 1e-14 * scale_of and len(t) < width else 0.0
                bases[s] = []
                continue
            if rounds == most_rounds or (rounds + 1) * width * sets > MOST_BASIS:
                weights[s] = np.stack([basis.T @ x for x in z])
            beside[s].append(beta)
            bases[s].append(own / beta)
            going.append(s)
        active = np.array(going, np.int64)
    out = []
    for s in range(sets):
        told = [Fit(x / by[:, s], float(mean_y[s] - mean[:, s] @ (x / by[:, s]))) for x in weights[s]]
        out.append(Solved(told, len(diagonal[s]), float(left[s]), float(mean_y[s])))
    return out


def scored(rows: DataFrame, width: int, tests: Column, solved: list[Solved], features: str = "features", y: str = "y") -> list[list[dict[str, float] | None]]:
    """R2, Pearson (0 if either is constant), RMSE and n of each training set's fits, by penalty, on the rows whose array `tests`
    has the set; None where there are none. One pass."""
    found = test_sums(rows, width, tests, solved, features, y)
    return [[(told(x) | {"n": int(x[0])}) if x[0] else None for x in own] for own in found]


def test_sums(rows: DataFrame, width: int, tests: Column, solved: list[Solved], features: str = "features", y: str = "y") -> np.ndarray:
    """Sets x penalties x 6: rows, and sums of y, y y, p, p p and y p, y and p being less a number that is the same for all."""
    sets, penalties = len(solved), len(solved[0].fits)
    flat = [f for s in solved for f in s.fits]
    middle = float(np.mean([s.mean_y for s in solved]))
    shared = rows.sparkSession.sparkContext.broadcast((np.stack([f.weights for f in flat], 1), np.array([f.intercept - middle for f in flat])))

    def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        weights, intercepts = shared.value
        out = np.zeros((6, sets * penalties))
        for b in _batches(batch, width, sets):
            some = np.repeat(b.member, penalties, 1)
            p, t = (b.times(weights) + intercepts) * some, (b.y[:, None] - middle) * some
            out += np.stack([some.sum(0), t.sum(0), (t * t).sum(0), p.sum(0), (p * p).sum(0), (t * p).sum(0)])
        return {"sums": out}

    found = tree_sums(_rows(rows, features, y, tests), part)
    shared.unpersist()
    return found.get("sums", np.zeros((6, sets * penalties))).T.reshape(sets, penalties, 6)


def told(sums: np.ndarray) -> dict[str, float]:
    """R2, Pearson and RMSE from one row of test_sums, or the sum of several."""
    n, y, yy, p, pp, yp = sums
    return _scored(yy - y * y / n, pp - p * p / n, yp - y * p / n, n, y / n, p / n)


#: What validated() gives.
VALIDATED = "alpha double, val_r2 double, test_r2 double, test_pearson double, test_rmse double, rounds int, residual double"


def validated(rows: DataFrame, by: list[str], width: int, split: str = "split", alphas: tuple[float, ...] = ALPHAS, refit: bool = True, scale: bool = False, features: str = "features", y: str = "y", **limits) -> DataFrame:
    """(by, VALIDATED, status): for each group alpha by val (of equal R2 the first), scores on test; fitted on train, or with refit on
    train and val. All groups are fitted together. Rows are kept on disk between rounds. A group that lacks train, val or
    test rows has that as its status; its number of rounds and residual tell how far a fit came.
    """
    spark = rows.sparkSession
    some = rows.where(F.col(features).isNotNull() & F.col(y).isNotNull())
    has = {r[0]: r.asDict() for r in some.groupBy(F.struct(*by) if by else F.struct(F.lit(0))).agg(*(F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test"))).collect()}  # a row a group, whose weights the driver holds anyway
    names, out, fine = [x.split()[0] for x in VALIDATED.split(", ")], [], []
    own_of = lambda key: tuple(key) if by else ()
    for key, sizes in has.items():
        if lacks := [s for s in ("train", "val", "test") if not sizes[s]]:
            out.append((*own_of(key), *[None] * len(names), f"ValueError: no rows of {lacks[0]}"))
        else:
            fine.append(key)
    kinds = [f for f in rows.schema.fields if f.name in by]
    if fine:
        if by:
            numbered = spark.createDataFrame([(*own_of(key), i) for i, key in enumerate(fine)], T.StructType([*kinds, T.StructField("_group", T.IntegerType())]))
            key = lambda df: F.struct(*(df[k] for k in by))  # noqa: E731  nulls are equal within
            some = some.withColumn("_key", key(some)).join(F.broadcast(numbered.select(key(numbered).alias("_key"), "_group")), "_key")
        else:
            some = some.withColumn("_group", F.lit(0))
        held = some.select("_group", F.col(split).alias("split"), F.col(features).alias("x"), F.col(y).alias("y")).persist(StorageLevel.DISK_ONLY)
        n, of = len(fine), lambda *splits: F.col("split").isin(*splits)
        sets = F.array_compact(F.array(F.when(of("train"), F.col("_group")), *([F.when(of("train", "val"), F.col("_group") + n)] if refit else [])))
        own = lambda s: F.array_compact(F.array(F.when(of(s), F.col("_group"))))
        solved = fits(held, width, sets, n * (1 + refit), alphas, "x", "y", scale, **limits)
        val = scored(held, width, own("val"), solved[:n], "x", "y")
        best = [int(np.argmax([x["r2"] for x in v])) for v in val]
        chosen = [s._replace(fits=[s.fits[b]]) for s, b in zip(solved[-n:], best, strict=True)]
        test = scored(held, width, own("test"), chosen, "x", "y")
        held.unpersist()
        for g, key in enumerate(fine):
            both = (solved[g], solved[g - n])
            told = test[g][0]
            out.append((*own_of(key), float(alphas[best[g]]), *(float(x) for x in (val[g][best[g]]["r2"], told["r2"], told["pearson"], told["rmse"])), max(s.rounds for s in both), max(s.residual for s in both), "ok"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds)
    return spark.createDataFrame(out, f"{fields}{VALIDATED}, status string")


def nested(rows: DataFrame, width: int, outer: int, inner: int, alphas: tuple[float, ...] = ALPHAS, scale: bool = False, features: str = "features", y: str = "y", **limits) -> dict[str, float]:
    """Nested cross-validation of rows with columns outer and inner (see splits.inner_folds): n, alpha (the median of those chosen),
    r2, pearson and rmse of all held-out predictions together, rounds, residual. All outer x (inner + 1) training sets at once."""
    per = inner + 1
    every = F.sequence(F.lit(0), F.lit(outer - 1))
    inner_of = lambda o: F.get("inner", o)
    # Set o * per + i, i < inner, is outer fold o's training rows without inner fold i; o * per + inner has all of them.
    trains = F.flatten(F.transform(F.filter(every, lambda o: o != F.col("outer")), lambda o: F.transform(F.filter(F.sequence(F.lit(0), F.lit(inner)), lambda i: i != inner_of(o)), lambda i: o * per + i)))
    tests = F.transform(every, lambda o: F.when(o == F.col("outer"), o * per + inner).otherwise(o * per + inner_of(o)))
    solved = fits(rows, width, trains, outer * per, alphas, features, y, scale, **limits)
    sums = test_sums(rows, width, tests, solved, features, y)
    total, chosen = np.zeros(6), []
    for o in range(outer):
        means = np.mean([[told(x)["r2"] for x in sums[o * per + i]] for i in range(inner)], 0)
        best = int(np.argmax(means))
        chosen.append(alphas[best])
        total += sums[o * per + inner, best]
    return {"n": int(total[0]), "alpha": float(np.median(chosen)), **told(total), "rounds": max(s.rounds for s in solved), "residual": max(s.residual for s in solved)}
