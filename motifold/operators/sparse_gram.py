"""Gram sums of rows of a few ones, in coordinates: how often two places are taken together, counted by Spark itself.

A row of n ones has n (n + 1) / 2 pairs whatever the width is, and tasks add equal pairs up before the shuffle, in which
only pairs are that occur. Folds need no pairs in a shuffle: the rows of one outer fold of one group meet in a task, batch by
batch, which counts their pairs and solves it; the rows of a large group meet in several, which hand on their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifold.operators import ridge


def cooccurrence(rows: DataFrame, by: list[str], places: str = "places") -> DataFrame:
    """(by, i, j, n): in how many rows places i <= j are both taken. places: ascending arrays of different ints; null: none."""
    first = rows.select(*by, F.col(places).alias("_all"), F.posexplode(places).alias("_at", "i"))
    pairs = first.select(*by, "i", F.explode(F.slice("_all", F.col("_at") + 1, F.size("_all"))).alias("j"))
    return pairs.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))


def sums(rows: DataFrame, by: list[str], width: int, places: str = "places", y: str = "y") -> DataFrame:
    """(by, i, j, value): sums of products of [1, ones, y] that aren't zero, i <= j; place p is number p + 1, y is width + 1.

    Those with the 1 before are left out: they equal the diagonal. Rows with a null y or places are left out.
    """
    some = rows.select(*by, F.col(places).alias("places"), F.col(y).cast("double").alias("y")).where("places is not null and y is not null")
    end = F.lit(width + 1)
    pairs = cooccurrence(some, by).select(*by, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.col("n").cast("double").alias("value"))
    told = some.select(*by, F.explode("places").alias("place"), "y").groupBy(*by, "place").agg(F.sum("y").alias("value")).select(*by, (F.col("place") + 1).alias("i"), end.alias("j"), "value")
    totals = some.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") ** 2).alias("yy"))
    corners = F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(v).alias("value")) for i, j, v in ((0, 0, "n"), (0, width + 1, "y"), (width + 1, width + 1, "yy")))))
    return pairs.unionByName(told).unionByName(totals.select(*by, corners))


def matrix(cell: pd.DataFrame, width: int) -> np.ndarray:
    """Of a cell's rows of sums(), as ridge.matrix makes them. ValueError for a place that isn't below width."""
    i, j = cell["i"].to_numpy(np.int64), cell["j"].to_numpy(np.int64)
    if len(i) and (i.min() < 0 or j.max() > width + 1):
        raise ValueError(f"places beyond {width}")
    out = np.zeros((width + 2, width + 2))
    out[i, j] = cell["value"]
    out[0, 1:-1] = np.diag(out)[1:-1]
    return out + np.triu(out, 1).T


#: Rows of one cell's group whose pairs a task counts.
MOST_ROWS = 1 << 22
#: Pairs that are listed at once (32 MB).
MOST_PAIRS = 1 << 22


class Counts:
    """Sums of products of [1, ones, y] over rows of a few ones, added up batch by batch."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.pairs = np.zeros((width + 1) * (width + 1))  # the last place is that of no one
        self.told = np.zeros(width + 1)
        self.ends = np.zeros(3)

    def add(self, values: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
        """values: the rows' ascending places, one row's after the other's; sizes: how many each has."""
        if len(values) and (values.min() < 0 or values.max() >= self.width):
            raise ValueError(f"places beyond {self.width}")
        self.ends += [len(y), y.sum(), (y * y).sum()]
        most = int(sizes.max(initial=0))
        if not most:
            return
        placed = np.full((len(sizes), most), self.width, np.int64)
        placed[np.arange(most) < sizes[:, None]] = values
        self.told += np.bincount(placed.ravel(), np.repeat(y, most), self.width + 1)
        i, j = np.triu_indices(most)
        step = max(1, MOST_PAIRS // len(i))
        for a in range(0, len(placed), step):
            own = placed[a : a + step].T
            self.pairs += np.bincount((own[i] * (self.width + 1) + own[j]).ravel(), minlength=len(self.pairs))

    def packed(self) -> np.ndarray:
        return np.concatenate([self.ends, self.told, self.pairs])

    def add_packed(self, values: np.ndarray) -> None:
        """What another's packed() gave."""
        self.ends += values[:3]
        self.told += values[3 : self.width + 4]
        self.pairs += values[self.width + 4 :]

    def matrix(self) -> np.ndarray:
        """As ridge.matrix makes them."""
        w = self.width
        out = np.zeros((w + 2, w + 2))
        out[1:-1, 1:-1] = self.pairs.reshape(w + 1, w + 1)[:-1, :-1]
        out[0, 0], out[0, -1], out[-1, -1] = self.ends
        out[0, 1:-1] = np.diag(out)[1:-1]
        out[1:-1, -1] = self.told[:-1]
        return out + np.triu(out, 1).T


def solved(rows: DataFrame, by: list[str], cell: list[str], width: int, fit: Callable[[dict], dict | list[dict]], schema: str, places: str = "places", y: str = "y", counted: DataFrame | None = None, most: int = MOST_ROWS) -> DataFrame:
    """(by, fields of schema, status): fit() of each group's cells, as ridge.fitted does, from places of ones.

    A group of at most `most` rows meets in the task that solves it, which reads it batch by batch; a larger one in several,
    and their counts in another. cell: columns of whole numbers or strings. counted: (n, and some of by), where that is cheaper to
    count.
    """
    kind = "smallint" if width < 1 << 15 else "int"
    some = rows.select(*by, *cell, F.col(places).cast(f"array<{kind}>").alias("_places"), F.col(y).cast("double").alias("_y")).where("_places is not null and _y is not null")
    types = {f.name: f.dataType.simpleString() for f in some.schema.fields}
    fields = [x.split()[0] for x in schema.split(",")]
    keys = "".join(f"`{c}` {types[c]}, " for c in by)

    def cells_of(batches: Iterator[pa.RecordBatch], own: dict) -> dict[tuple, Counts]:
        """The counts of each cell; own: takes the group's columns."""
        held: dict[tuple, Counts] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own.update({c: batch.column(c)[0].as_py() for c in by})
            codes = pd.DataFrame({c: batch.column(c).to_pandas() for c in cell})
            lists, told = batch.column("_places"), batch.column("_y").to_numpy()
            for at, some in codes.groupby(cell, dropna=False, sort=False).indices.items():
                listed = lists.take(pa.array(some))
                counts = held.setdefault(at if isinstance(at, tuple) else (at,), Counts(width))
                counts.add(listed.flatten().to_numpy(zero_copy_only=False), listed.value_lengths().to_numpy(), told[some])
        return held

    def result(own: dict, work: Callable[[], dict | list[dict]]) -> pa.RecordBatch:
        try:
            found = work()
            found = [x | {"status": "ok"} for x in (found if isinstance(found, list) else [found])]
        except Exception as error:  # noqa: BLE001  one group's data don't end the others' job
            found = [dict.fromkeys(fields) | {"status": f"{type(error).__name__}: {error}"}]
        return pa.RecordBatch.from_pylist([own | x for x in found], schema=arrow)

    def matrices(held: dict[tuple, Counts]) -> dict:
        out = {}
        for at in list(held):
            out[at[0] if len(at) == 1 else at] = held.pop(at).matrix()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}

        def work():
            return fit(matrices(cells_of(batches, own)))

        yield result(own, work)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for at, counts in cells_of(batches, own).items():
            yield pa.RecordBatch.from_pylist([own | dict(zip(cell, at, strict=True)) | {"_packed": counts.packed()}], schema=middle)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                own = own or {c: batch.column(c)[0].as_py() for c in by}
                at = tuple(batch.column(c)[r].as_py() for c in cell)
                held.setdefault(at, Counts(width)).add_packed(batch.column("_packed")[r].values.to_numpy())
        yield result(own, lambda: fit(matrices(held)))

    field = {f.name: pa.field(f.name, to_arrow_type(f.dataType)) for f in some.schema.fields if f.name in (*by, *cell)}
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([*(field[c] for c in by), *((x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")), ("status", pa.string())])
    middle = pa.schema([*(field[c] for c in (*by, *cell)), ("_packed", pa.list_(pa.float64()))])
    out = f"{keys}{schema}, status string"
    sizes = some.groupBy(*by).agg(F.count("*").alias("n")) if counted is None else counted
    shared = [c for c in by if c in sizes.columns]
    key = lambda df: F.struct(F.lit(0), *(df[c] for c in shared)).alias("_group")  # noqa: E731  nulls are equal within
    large = sizes.where(F.col("n") > most).select(key(sizes), F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    if large.isEmpty():
        return ridge.spread(some, *by).groupBy(*by).applyInArrow(run, out)
    keyed, large = some.withColumn("_group", key(some)), F.broadcast(large)  # as many as rows by `most`
    few = ridge.spread(keyed.join(large, "_group", "left_anti").drop("_group"), *by).groupBy(*by).applyInArrow(run, out)
    parts = keyed.join(large, "_group").withColumn("_part", F.pmod(F.xxhash64("_places", "_y"), F.col("_parts"))).drop("_group", "_parts")
    counts = ridge.spread(parts, *by, "_part").groupBy(*by, "_part").applyInArrow(count, f"{keys}{''.join(f'`{c}` {types[c]}, ' for c in cell)}_packed array<double>")
    return few.unionByName(counts.groupBy(*by).applyInArrow(add, out))


def nested_folds(rows: DataFrame, by: list[str], outer: str, inner: str, width: int, places: str = "places", y: str = "y", alphas: tuple[float, ...] = ridge.ALPHAS, scale: bool = False, counted: DataFrame | None = None, most: int = MOST_ROWS) -> DataFrame:
    """(by, n, alpha, r2, pearson, rmse, status): nested cross-validation of each group, as ridge.nested_folds, from places of ones.

    A task gets an outer fold of a group, inner folds' sums and the held-out rows' ones; scores of all folds are then added up.
    counted, most: see solved.
    """
    at = F.posexplode(inner).alias("_outer", "_inner")
    names = ["n", "alpha", "total", "spread", "both", "mean_y", "mean_p"]

    def fold(cells: dict[int, np.ndarray]) -> dict[str, float]:
        inner, held = [g for i, g in sorted(cells.items()) if i >= 0], cells[-1]
        train = sum(inner)
        means = np.mean([ridge.r2s(g, ridge.solves(train - g, alphas, scale)) for g in inner], 0)
        alpha = alphas[int(np.argmax(means))]
        total, spread, both, n, mean_y, mean_p = ridge.squares(held, ridge.solve(train, alpha, scale))
        return dict(zip(names, (float(x) for x in (n, alpha, total, spread, both, mean_y, mean_p)), strict=True))

    by_fold = solved(rows.select(*by, places, y, at), [*by, "_outer"], ["_inner"], width, fold, ", ".join(f"{x} double" for x in names), places, y, counted, most)
    n, y_, p = F.sum("n"), F.sum(F.col("n") * F.col("mean_y")), F.sum(F.col("n") * F.col("mean_p"))
    plus = lambda c, a, b: F.sum(F.col(c) + F.col("n") * F.col(a) * F.col(b))
    fine = F.count_if(F.col("status") != "ok") == 0
    told = by_fold.groupBy(*by).agg(
        n.alias("n"), F.median("alpha").alias("alpha"), y_.alias("y"), p.alias("p"), plus("total", "mean_y", "mean_y").alias("yy"), plus("spread", "mean_p", "mean_p").alias("pp"), plus("both", "mean_y", "mean_p").alias("yp"),
        F.when(fine, "ok").otherwise(F.max(F.when(F.col("status") != "ok", F.col("status")))).alias("status"),
    )
    total, spread, both = F.col("yy") - F.col("y") ** 2 / F.col("n"), F.col("pp") - F.col("p") ** 2 / F.col("n"), F.col("yp") - F.col("y") * F.col("p") / F.col("n")
    left = F.greatest(F.col("yy") - 2 * F.col("yp") + F.col("pp"), F.lit(0.0))
    under = F.sqrt(F.greatest(total, F.lit(0.0)) * F.greatest(spread, F.lit(0.0)))
    ok = lambda c, name: F.when(F.col("status") == "ok", c).alias(name)
    r2, pearson = 1 - left / F.greatest(total, F.lit(1e-12)), F.when(under > 0, F.try_divide(both, under)).otherwise(0.0)
    return told.select(*by, ok(F.col("n").cast("long"), "n"), ok(F.col("alpha"), "alpha"), ok(r2, "r2"), ok(pearson, "pearson"), ok(F.sqrt(left / F.col("n")), "rmse"), "status")
