"""Ridge regression over whole grids from one pass: Gram sums of each cell, then algebra.

For rows [1, x, y], the sums of products G are all that fitting, scaling and scoring need. G is taken for each cell (group
and fold) in one distributed pass; G of a training set is a sum of cells. Every penalty, fold and nesting is then solved
from matrices of the features' width, in one task for each group. Groups of few rows skip the sums: their rows meet in a
task, which is exact too and far cheaper where features are more than rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
#: Widest rows for which a task holds Gram matrices.
MOST_WIDTH = 4096
#: Numbers of triangles that a task holds before it hands them on (256 MB).
MOST_HELD = 1 << 25


class Fit(NamedTuple):
    weights: np.ndarray
    intercept: float


def usable(rows: DataFrame, by: list[str], features: str, y: str) -> DataFrame:
    """(by, x, y) of the rows that can be fitted: without a null in features or y."""
    some = rows.select(*by, F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    return some.where("x is not null and y is not null and not exists(x, v -> v is null)")


def gram_sums(rows: DataFrame, by: list[str], features: str = "features", y: str = "y") -> DataFrame:
    """(by, width, place, value): for each cell the sums of products of [1, features, y]; place counts the upper triangle by rows.

    Tasks multiply whole batches and hand on one triangle for each cell they met; those of a cell are added in a shuffle.
    Rows with a null in features or y are left out. Rows of another width make a triangle of their own, which `matrix` refuses.
    """
    some = usable(rows, by, features, y)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields if f.name in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def out():
            for (width, *key), packed in held.items():
                n = len(packed)
                keys = [pa.array([k], t).take(pa.array(np.zeros(n, np.int32))) for k, t in zip(key, types, strict=True)]
                values = [pa.array(np.full(n, width, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(packed)]
                yield pa.RecordBatch.from_arrays([*keys, *values], names=[*by, "width", "place", "value"])
            held.clear()

        for batch in batches:
            types[:] = [batch.schema.field(k).type for k in range(len(by))]
            lists, told = batch.column(len(by)), batch.column(len(by) + 1).to_numpy()
            widths = np.diff(lists.offsets.to_numpy())
            for width in np.unique(widths).tolist():
                if width > MOST_WIDTH:
                    raise ValueError(f"{width} features; Gram matrices are for {MOST_WIDTH} at most")
                some = np.flatnonzero(widths == width)
                x = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)
                z, upper = with_ends(x, told[some]), np.triu(np.ones((width + 2, width + 2), bool))
                for key, own in _groups(batch, by, some):
                    packed = (z[own].T @ z[own])[upper]
                    held[width, *key] = held[width, *key] + packed if (width, *key) in held else packed
                if sum(map(len, held.values())) > MOST_HELD:
                    yield from out()
        yield from out()

    partial = some.mapInArrow(run, ", ".join(x for x in (kinds, "width int, place int, value double") if x))
    return partial.groupBy(*by, "width", "place").agg(F.sum("value").alias("value"))


def with_ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows [1, x, y]."""
    return np.concatenate([np.ones((len(x), 1)), x, y[:, None]], 1)


def _groups(batch: pa.RecordBatch, by: list[str], some: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """Places in `some` (rows of the batch) by the values of the first columns."""
    if not by:
        yield (), np.arange(len(some))
        return
    codes = pd.DataFrame({c: pd.factorize(batch.column(k).take(pa.array(some)).to_pandas(), use_na_sentinel=False)[0] for k, c in enumerate(by)})
    for own in codes.groupby(by, sort=False).indices.values():
        yield tuple(batch.column(k)[int(some[own[0]])].as_py() for k in range(len(by))), own


def matrix(cell: pd.DataFrame) -> np.ndarray:
    """Of a cell's rows of gram_sums. ValueError if its rows had different widths."""
    if cell["width"].nunique() > 1:
        raise ValueError(f"rows of {' and '.join(map(str, sorted(cell['width'].unique())))} features")
    size = int(cell["width"].iloc[0]) + 2
    packed = np.zeros(size * (size + 1) // 2)
    packed[cell["place"]] = cell["value"]
    out = np.zeros((size, size))
    out[np.triu(np.ones((size, size), bool))] = packed
    return out + np.triu(out, 1).T


def solve(gram: np.ndarray, alpha: float, scale: bool = False, least: float = 1e-8) -> Fit:
    """Weights that minimise squares + alpha |w|**2, the intercept being free. With scale, of features divided by their
    deviation (one under `least`: 1); weights are given for features as they are."""
    return solves(gram, (alpha,), scale, least)[0]


def solves(gram: np.ndarray, alphas: tuple[float, ...], scale: bool = False, least: float = 1e-8) -> list[Fit]:
    """solve() for each penalty; sums are centred once."""
    n = gram[0, 0]
    mean = gram[0] / n
    centred = gram - n * np.outer(mean, mean)
    a, b, by = centred[1:-1, 1:-1], centred[1:-1, -1], np.ones(len(gram) - 2)
    if scale:
        std = np.sqrt(np.maximum(np.diag(centred)[1:-1] / n, 0.0))
        by = np.where(std < least, 1.0, std)
        a, b = a / np.outer(by, by), b / by
    out = []
    for alpha in alphas:
        own = a.copy()
        np.fill_diagonal(own, np.diag(a) + alpha)
        try:
            w = np.linalg.solve(own, b) / by
        except np.linalg.LinAlgError:
            w = np.linalg.lstsq(own, b, rcond=None)[0] / by
        out.append(Fit(w, float(mean[-1] - mean[1:-1] @ w)))
    return out


def centred(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means of [x, y], and sums of products about them."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    return n, mean, gram[1:, 1:] - n * np.outer(mean, mean)


def squares(gram: np.ndarray, fit: Fit, told: tuple[float, np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float, float, float, float]:
    """From sums alone: squares of y about its mean, squares of the prediction about its, their product; rows and both means.
    told: centred(gram), where it is known."""
    n, mean, about = told or centred(gram)
    spread, both = fit.weights @ about[:-1, :-1] @ fit.weights, fit.weights @ about[:-1, -1]
    return about[-1, -1], spread, both, n, mean[-1], fit.intercept + fit.weights @ mean[:-1]


def scores(gram: np.ndarray, fit: Fit) -> dict[str, float]:
    """R2, Pearson (0 if either is constant) and RMSE."""
    return _scored(*squares(gram, fit))


def r2s(gram: np.ndarray, fits: list[Fit]) -> list[float]:
    """R2 of each fit; sums are centred once."""
    about = centred(gram)
    return [_scored(*squares(gram, fit, about))["r2"] for fit in fits]


def _scored(total: float, spread: float, both: float, n: float, mean_y: float, mean_p: float) -> dict[str, float]:
    left = max(total - 2 * both + spread + n * (mean_y - mean_p) ** 2, 0.0)
    denominator = np.sqrt(max(total, 0.0) * max(spread, 0.0))
    return {"r2": 1 - left / max(total, 1e-12), "pearson": both / denominator if denominator > 0 else 0.0, "rmse": float(np.sqrt(left / n))}


def select_alpha(train: np.ndarray, val: np.ndarray, alphas: tuple[float, ...] = ALPHAS, scale: bool = False) -> tuple[float, float]:
    """(alpha, R2 on val) of the best fit on train; of equal ones the first."""
    found = r2s(val, solves(train, alphas, scale))
    best = int(np.argmax(found))
    return alphas[best], found[best]


def subset_scores(cells: dict[tuple[str, int], np.ndarray], percents: list[int], scale: bool = True) -> list[dict[str, float]]:
    """validated(), without a refit, for nested subsets of training rows. cells: by (split, band); a training row's band is
    the smallest subset it is in, so a subset's sums are those of its band and all before."""
    rest = {s: sum(g for (x, _), g in cells.items() if x == s) for s in ("val", "test")}
    out, train = [], 0.0
    for i, percent in enumerate(percents):
        train = train + cells.get(("train", i), 0.0)
        out.append({"percent": percent, "n_train": int(train[0, 0])} | validated({"train": train, **rest}, refit=False, scale=scale))
    return out


def validated(cells: dict[str, np.ndarray], alphas: tuple[float, ...] = ALPHAS, refit: bool = True, scale: bool = False) -> dict[str, float]:
    """Alpha by val, scores on test; fitted on train, or with refit on train and val."""
    alpha, val_r2 = select_alpha(cells["train"], cells["val"], alphas, scale)
    fit = solve(cells["train"] + cells["val"] if refit else cells["train"], alpha, scale)
    return {"alpha": alpha, "val_r2": val_r2, **{f"test_{k}": v for k, v in scores(cells["test"], fit).items()}}


#: What validated() gives.
VALIDATED = "alpha double, val_r2 double, test_r2 double, test_pearson double, test_rmse double"


def nested(cells: dict[tuple[int, int], np.ndarray], alphas: tuple[float, ...] = ALPHAS, scale: bool = False) -> dict[str, float]:
    """Nested cross-validation from cells (outer fold, inner fold of its training rows; -1: the held-out rows).

    Scores are of all held-out predictions together, alpha is the median over outer folds.
    """
    return _nested(({i: g for (x, i), g in sorted(cells.items()) if x == o} for o in sorted({o for o, _ in cells})), alphas, scale)


def _nested(folds: Iterable[dict[int, np.ndarray]], alphas: tuple[float, ...], scale: bool) -> dict[str, float]:
    chosen, parts = [], []
    for cells in folds:
        inner, held = [g for i, g in cells.items() if i >= 0], cells[-1]
        train = sum(inner)
        means = np.mean([r2s(g, solves(train - g, alphas, scale)) for g in inner], 0)
        chosen.append(alphas[int(np.argmax(means))])
        parts.append(squares(held, solve(train, chosen[-1], scale)))
    total, spread, both, n, mean_y, mean_p = np.array(parts).T
    y, p = (n @ mean_y) / n.sum(), (n @ mean_p) / n.sum()  # all folds' predictions together
    pooled = total.sum() + n @ (mean_y - y) ** 2, spread.sum() + n @ (mean_p - p) ** 2, both.sum() + n @ ((mean_y - y) * (mean_p - p))
    return {"n": int(n.sum()), "alpha": float(np.median(chosen)), **_scored(*pooled, n.sum(), y, p)}


def leave_one_out(rows: DataFrame, gram: np.ndarray, alphas: tuple[float, ...] = ALPHAS, features: str = "features", y: str = "y") -> DataFrame:
    """(alpha, mean_square): error of leaving each row out, by the closed form, for all penalties in one more pass."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n
    centred = (gram - n * np.outer(gram[0] / n, gram[0] / n))[1:-1, 1:-1]
    values, vectors = np.linalg.eigh(centred)
    fits = [solve(gram, a) for a in alphas]
    shared = rows.sparkSession.sparkContext.broadcast((mean, values, vectors, fits))

    def run(batches):
        mean, values, vectors, fits = shared.value
        sums = np.zeros(len(fits))
        count = 0
        for batch in batches:
            lists = batch.column(0)
            if batch.num_rows and (np.diff(lists.offsets.to_numpy()) != len(mean)).any():
                raise ValueError(f"rows of other than {len(mean)} features")
            if batch.num_rows:
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                z, told = ((x - mean) @ vectors) ** 2, batch.column(1).to_numpy()
                for k, (alpha, fit) in enumerate(zip(alphas, fits, strict=True)):
                    weight = 1 / n + z @ (1 / (np.maximum(values, 0) + alpha))
                    sums[k] += (((told - x @ fit.weights - fit.intercept) / (1 - weight)) ** 2).sum()
                count += batch.num_rows
        yield pa.RecordBatch.from_pydict({"alpha": list(alphas), "squares": sums, "n": [count] * len(fits)})

    parts = usable(rows, [], features, y).mapInArrow(run, "alpha double, squares double, n long")
    return parts.groupBy("alpha").agg((F.sum("squares") / F.sum("n")).alias("mean_square"))


def solved(sums: DataFrame, by: list[str], cell: list[str], fit: Callable[[dict], dict | list[dict]], schema: str) -> DataFrame:
    """fit() of each group's cells, one task a group; a group that fails has its error as status, not the job.

    sums: of gram_sums over by + cell. schema: the fields that fit gives, in a row or several. Result: by, those fields, status
    (ok or the error).
    """
    cells = lambda pdf: {k[0] if len(cell) == 1 else tuple(k): matrix(g) for k, g in pdf.groupby(cell, dropna=False)}
    run = told(by, lambda pdf: fit(cells(pdf)), [x.split()[0] for x in schema.split(",")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in by)
    return sums.groupBy(*by).applyInPandas(run, f"{kinds}, {schema}, status string")


#: Values of features up to which a group's rows meet in one task (256 MB), and rows up to which their products are taken.
MOST_VALUES = 1 << 25
MOST_PRODUCTS = 2048


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, dealt by keys to so many tasks that few have two groups: a group's rows are few bytes and its fits much work, so
    adaptive execution would join tasks by their bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if keys else rows


def summed(rows: DataFrame, by: list[str], listed: list[str], cells_of: Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[tuple, np.ndarray]]], fit: Callable[[dict], dict | list[dict]], schema: str, features: str = "features", y: str = "y") -> DataFrame:
    """solved(gram_sums()) of rows that may be in several cells: a task takes a batch's products by cell and hands on a
    triangle as one array; arrays of a cell are added in a task, and those of a group solved in one.

    cells_of: of a batch with columns by and listed, and places of some of its rows, the cells (of strings, ints or None) and the
    places among these that are in each. Give rows whose tasks have few groups, else as many triangles are handed on.
    """
    some = usable(rows, [*by, *listed], features, y)
    types = {f.name: f.dataType.simpleString() for f in some.schema.fields}
    keys = "".join(f"`{c}` {types[c]}, " for c in by)
    arrow = {f.name: pa.field(f.name, to_arrow_type(f.dataType)) for f in some.schema.fields if f.name in by}
    middle = pa.schema([*(arrow[c] for c in by), ("cell", pa.string()), ("width", pa.int32()), ("packed", pa.list_(pa.float64()))])
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    last = pa.schema([*(arrow[c] for c in by), *((x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")), ("status", pa.string())])
    fields = [x.split()[0] for x in schema.split(",")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out():
            for (key, cell, width), packed in held.items():
                yield pa.RecordBatch.from_pylist([dict(zip(by, key, strict=True)) | {"cell": cell, "width": width, "packed": packed}], schema=middle)
            held.clear()

        for batch in batches:
            lists, told = batch.column("x"), batch.column("y").to_numpy()
            widths = np.diff(lists.offsets.to_numpy())
            for width in np.unique(widths).tolist():
                if width > MOST_WIDTH:
                    raise ValueError(f"{width} features; Gram matrices are for {MOST_WIDTH} at most")
                some = np.flatnonzero(widths == width)
                z, upper = with_ends(lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width), told[some]), np.triu(np.ones((width + 2, width + 2), bool))
                for key, own in _groups(batch, by, some):
                    mine = z[own]
                    for cell, places in cells_of(batch, some[own]):
                        x = mine[places]
                        packed, at = (x.T @ x)[upper], (key, json.dumps(cell), width)
                        held[at] = held[at] + packed if at in held else packed
                    if sum(map(len, held.values())) > MOST_HELD:
                        yield from out()
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                own = own or {c: batch.column(c)[r].as_py() for c in (*by, "cell", "width")}
                packed = batch.column("packed")[r].values.to_numpy()
                total = packed.copy() if total is None else np.add(total, packed, out=total)
        yield pa.RecordBatch.from_pylist([own | {"packed": total}], schema=middle)

    def solve_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells, widths = {}, {}, set()
        for batch in batches:
            for r in range(batch.num_rows):
                own = own or {c: batch.column(c)[r].as_py() for c in by}
                width = batch.column("width")[r].as_py()
                widths.add(width)
                full = np.zeros((width + 2, width + 2))
                full[np.triu(np.ones(full.shape, bool))] = batch.column("packed")[r].values.to_numpy()
                at = tuple(json.loads(batch.column("cell")[r].as_py()))
                cells[at[0] if len(at) == 1 else at] = full + np.triu(full, 1).T
        try:
            if len(widths) > 1:
                raise ValueError(f"rows of {' and '.join(map(str, sorted(widths)))} features")
            found = fit(cells)
            found = [x | {"status": "ok"} for x in (found if isinstance(found, list) else [found])]
        except Exception as error:  # noqa: BLE001  one group's data don't end the others' job
            found = [dict.fromkeys(fields) | {"status": f"{type(error).__name__}: {error}"}]
        yield pa.RecordBatch.from_pylist([own | x for x in found], schema=last)

    packed = f"{keys}cell string, width int, packed array<double>"
    parts = some.mapInArrow(count, packed)
    cells = spread(parts, *by, "cell", "width").groupBy(*by, "cell", "width").applyInArrow(add, packed)
    return spread(cells, *by).groupBy(*by).applyInArrow(solve_cells, f"{keys}{schema}, status string")


def fitted(rows: DataFrame, by: list[str], cell: list[str], fit: Callable[[dict], dict | list[dict]], schema: str, width: int, features: str = "features", y: str = "y", counted: DataFrame | None = None) -> DataFrame:
    """solved() of rows: groups of at most MOST_VALUES values make their cells' sums in the task that solves them, larger ones
    by gram_sums, in all tasks. width: features of a row. counted: a table with the rows' groups that is cheaper to count."""
    small, large = _by_size(rows, by, width, counted)
    some = usable(small, [*by, *cell], features, y)
    fields = [x.split()[0] for x in schema.split(",")]

    def cells(pdf: pd.DataFrame) -> dict:
        widths = {len(x) for x in pdf["x"]}
        if len(widths) > 1:
            raise ValueError(f"rows of {' and '.join(map(str, sorted(widths)))} features")
        out = {}
        for key, own in pdf.groupby(cell, dropna=False):
            z = with_ends(np.stack(own["x"].to_numpy()), own["y"].to_numpy(float))
            out[key[0] if len(cell) == 1 else tuple(key)] = z.T @ z
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields if f.name in by)
    few = spread(some, *by).groupBy(*by).applyInPandas(told(by, lambda pdf: fit(cells(pdf)), fields), f"{kinds}, {schema}, status string")

    def cells_of(batch: pa.RecordBatch, own: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        return _groups(batch.select(cell), cell, own)

    return few if large is None else few.unionByName(summed(large, by, cell, cells_of, fit, schema, features, y))


def _by_size(rows: DataFrame, by: list[str], width: int, counted: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """rows of groups of at most MOST_VALUES values, and the others (None: there are none)."""
    sizes = (rows if counted is None else counted).groupBy(*by).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") * width > MOST_VALUES).drop("_n")
    if large.isEmpty():
        return rows, None
    large = F.broadcast(large.select(F.struct(*by).alias("_group")))  # at most the rows' values by MOST_VALUES
    keyed = rows.withColumn("_group", F.struct(*by))
    return keyed.join(large, "_group", "left_anti").drop("_group"), keyed.join(large, "_group", "left_semi").drop("_group")


def told(by: list[str], fit: Callable[[pd.DataFrame], dict | list[dict]], fields: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """fit of a group's rows as a function for applyInPandas: a group that fails has its error as status, not the job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[by].iloc[0].to_dict()
        try:
            found = fit(pdf)
            found = [x | {"status": "ok"} for x in (found if isinstance(found, list) else [found])]
        except Exception as error:  # noqa: BLE001  one group's data don't end the others' job
            found = [dict.fromkeys(fields) | {"status": f"{type(error).__name__}: {error}"}]
        return pd.DataFrame([own | x for x in found])

    return run


class Rows:
    """A group's rows in one task, for fits by cell: products of rows with rows if those are fewer than features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        self.products = x @ x.T

    def predicted(self, train: np.ndarray, test: np.ndarray, alphas: tuple[float, ...]) -> np.ndarray:
        """alphas x test: ridge predictions of rows `test` from rows `train`, the intercept being free."""
        k, cross = self.products[np.ix_(train, train)], self.products[np.ix_(test, train)]
        mean, middle = self.y[train].mean(), k.mean(0)
        k = k - middle - middle[:, None] + middle.mean()
        cross = cross - middle - cross.mean(1)[:, None] + middle.mean()
        values, vectors = np.linalg.eigh(k)
        told = vectors.T @ (self.y[train] - mean)
        return np.stack([mean + cross @ (vectors @ (told / (np.maximum(values, 0) + a))) for a in alphas])


def nested_of_rows(x: np.ndarray, y: np.ndarray, outer: np.ndarray, inner: np.ndarray, alphas: tuple[float, ...] = ALPHAS, scale: bool = False) -> dict[str, float]:
    """What nested() gives, from rows: outer fold of each, and its inner fold in each outer one (rows x folds; -1: held out)."""
    if scale or len(y) > min(x.shape[1], MOST_PRODUCTS):
        z = with_ends(x, y)
        return _nested(({i: z[inner[:, o] == i].T @ z[inner[:, o] == i] for i in np.unique(inner[:, o]).tolist()} for o in np.unique(outer).tolist()), alphas, scale)
    rows = Rows(x, y)
    out, chosen = np.zeros(len(y)), []
    for o in np.unique(outer).tolist():
        train, held = np.flatnonzero(outer != o), np.flatnonzero(outer == o)
        means = np.zeros(len(alphas))
        for i in (folds := np.unique(inner[train, o]).tolist()):
            val = train[inner[train, o] == i]
            left = ((rows.predicted(train[inner[train, o] != i], val, alphas) - y[val]) ** 2).sum(1)
            means += (1 - left / max(((y[val] - y[val].mean()) ** 2).sum(), 1e-12)) / len(folds)
        chosen.append(alphas[int(np.argmax(means))])
        out[held] = rows.predicted(train, held, (chosen[-1],))[0]
    left, total = ((y - out) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    spread = np.sqrt(total * ((out - out.mean()) ** 2).sum())
    both = ((y - y.mean()) * (out - out.mean())).sum()
    return {"n": len(y), "alpha": float(np.median(chosen)), "r2": 1 - left / max(total, 1e-12), "pearson": both / spread if spread > 0 else 0.0, "rmse": float(np.sqrt(left / len(y)))}


NESTED = "n long, alpha double, r2 double, pearson double, rmse double"


def nested_folds(rows: DataFrame, by: list[str], outer: str, inner: str, width: int, features: str = "features", y: str = "y", scale: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """(by, n, alpha, r2, pearson, rmse, status): nested() of each group. outer, inner: as splits.inner_folds makes them.

    Groups of at most MOST_VALUES values are solved from their rows, in a task each; larger ones from Gram sums of their cells.
    width, counted: see fitted.
    """
    small, large = _by_size(rows, by, width, counted)

    def solve_rows(pdf: pd.DataFrame) -> dict[str, float]:
        widths = {len(x) for x in pdf["x"]}
        if len(widths) > 1:
            raise ValueError(f"rows of {' and '.join(map(str, sorted(widths)))} features")
        return nested_of_rows(np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float), pdf["outer"].to_numpy(), np.stack(pdf["inner"].to_numpy()), scale=scale)

    some = usable(small.withColumns({"outer": F.col(outer), "inner": F.col(inner)}), [*by, "outer", "inner"], features, y)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    few = spread(some, *by).groupBy(*by).applyInPandas(told(by, solve_rows, [x.split()[0] for x in NESTED.split(", ")]), f"{kinds}, {NESTED}, status string")
    if large is None:
        return few

    def cells_of(batch: pa.RecordBatch, own: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        places = batch.column("inner").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
        for o, folds in enumerate(places.T):
            yield from (((o, i), np.flatnonzero(folds == i)) for i in np.unique(folds).tolist())

    # A row is in a cell of each outer fold, so folds are told by an array, not by copies of the row.
    listed = large.select(*by, F.col(inner).alias("inner"), features, y)
    return few.unionByName(summed(listed, by, ["inner"], cells_of, lambda cells: nested(cells, scale=scale), NESTED, features, y))
