"""Quality of texts by a regularised quadratic discriminant over transformed statistics of each text.

Each class has a normal density over the statistics. Its covariance is shrunk to the covariance within all classes, and that
to its own diagonal; how far is chosen by folds of the labelled rows. A text's score is the posterior of label 1, from the
difference of log densities, whose Mahalanobis distances use Cholesky factors made once a model. Fitting needs only sums of
products by class and fold, over all labelled rows.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.language_id import held_out
from motifold.llm.shared import stored, tidied
from motifold.llm.textbatch import SPACED, Piece, Words, byte_set, pieces, words
from motifold.operators import ridge

#: Smallest score of label 1.
CUT = 0.3
#: Added to shares before their logarithm, so that a rare sign in a long text and none are alike.
FLOOR = 0.01
#: Grid of shrinkage to the covariance within classes, and of that to its diagonal, and of what log-odds are divided by.
SHRINKS = (0.1, 0.5, 0.9)
DIAGONALS = (0.01, 0.1, 0.5)
HEATS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)

_LINES = ~byte_set((0x0A, 0x0A))
#: Kinds of bytes that are counted.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, EMPHASIS, SYMBOL, LEAD, REST, CONTROL = range(11)
_KIND = np.full(256, SYMBOL, np.uint8)
_KIND[:0x20], _KIND[0x7F], _KIND[0x80:0xC0], _KIND[0xC0:] = CONTROL, CONTROL, REST, LEAD
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = LOWER, UPPER, DIGIT
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D]], _KIND[ord("!")] = SPACE, LINE, EMPHASIS
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = STOP
_LETTER = np.isin(_KIND, (LOWER, UPPER, LEAD, REST))

NAMES = (
    "chars", "words", "word_length", "longest_word", "line_length", "letters", "upper", "digits", "spaces", "stops", "emphasis", "symbols", "beyond_ascii", "controls",
    "repeated_next", "distinct_words", "top_word", "letterless_words", "symbol_ends", "shouted_words", "repeated_lines",
)


def _by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values (of words) by row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[rows[1:]] - total[rows[:-1]]


def _runs(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its number of distinct hashes and how often the commonest occurs."""
    row = np.repeat(np.arange(len(found.rows) - 1), np.diff(found.rows))
    order = np.lexsort((found.hashes, row))
    h, r = found.hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(h)))
    most = np.zeros(len(found.rows) - 1, np.int64)
    np.maximum.at(most, r[at], sizes)
    return np.bincount(r[at], minlength=len(most)), most


def statistics(piece: Piece) -> np.ndarray:
    """Rows x NAMES: logarithms of sizes and of shares. An empty text has those of shares of 0 and sizes of 0."""
    data, bounds = piece.data, piece.bounds
    n = len(bounds) - 1
    counts = np.zeros((n, 11), np.int64)
    step = 1 << 20
    for a in range(0, len(data), step):  # a very long text is counted in stretches
        own = np.searchsorted(bounds, np.arange(a, min(a + step, len(data))), "right") - 1
        counts += np.bincount(own * 11 + _KIND[data[a : a + step]], minlength=11 * n).reshape(n, 11)
    found, lines = words(piece, SPACED), words(piece, _LINES, lower=False)
    first = np.repeat(found.rows[:-1], np.diff(found.rows))
    places, lengths = np.arange(len(found.starts)), found.ends - found.starts
    again = np.zeros(len(places), bool)
    again[1:] = found.hashes[1:] == found.hashes[:-1]
    again &= places > first
    letter, low = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (_LETTER[data], _KIND[data] != UPPER))
    letters = letter[found.ends] - letter[found.starts]
    kind = np.isin(_KIND[data[found.ends - 1]], (SYMBOL, EMPHASIS))
    shouted = (low[found.ends] - low[found.starts] <= lengths - 2) & (letters >= 2) & (2 * (low[found.ends] - low[found.starts]) <= lengths)
    chars = counts.sum(1) - counts[:, REST]
    n_words, n_lines = np.diff(found.rows), np.diff(lines.rows)
    distinct, top = _runs(found)
    different, _ = _runs(lines)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(n), n_words), lengths)
    all_letters = counts[:, [LOWER, UPPER, LEAD]].sum(1)
    share = lambda a, b: np.log(a / np.maximum(b, 1) + FLOOR)
    out = [np.log1p(chars), np.log1p(n_words), np.log1p(chars / np.maximum(n_words, 1)), np.log1p(longest), np.log1p(chars / np.maximum(n_lines, 1))]
    out += [share(all_letters, chars), share(counts[:, UPPER], all_letters)]
    out += [share(counts[:, k], chars) for k in (DIGIT, SPACE, STOP, EMPHASIS, SYMBOL, LEAD, CONTROL)]
    out += [share(_by_row(again, found.rows), n_words), share(distinct, n_words), share(top, n_words)]
    out += [share(_by_row(x, found.rows), n_words) for x in (letters == 0, kind, shouted)]
    return np.stack([*out, share(n_lines - different, n_lines)], 1)


class Discriminant(NamedTuple):
    """Class means, inverse Cholesky factors of class covariances, and what is added to the log-odds, which are divided by heat."""

    means: np.ndarray  #: 2 x statistics
    factors: np.ndarray  #: 2 x statistics x statistics
    offset: float
    heat: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1, before heat."""
        away = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        return (away[0] - away[1]) / 2 + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.heat, -700, 700)))


def fitted(sums: dict[int, np.ndarray], shrink: float, diagonal: float, heat: float = 1.0) -> Discriminant:
    """From each class's sums of products of [1, statistics, _] (see ridge.gram_sums). Without one of the classes, every score is its share
    of labelled rows, with one row of each added."""
    counts = [sums[c][0, 0] if c in sums else 0.0 for c in (0, 1)]
    prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))
    if min(counts) == 0:
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0, 0)), prior, 1.0)
    grams = [sums[c][:-1, :-1] for c in (0, 1)]
    means = np.stack([g[0, 1:] / n for g, n in zip(grams, counts, strict=True)])
    about = [g[1:, 1:] - n * np.outer(m, m) for g, n, m in zip(grams, counts, means, strict=True)]
    within = sum(about) / sum(counts)
    spread = np.maximum(np.diag(within), 1e-4)
    within = (1 - diagonal) * within + diagonal * np.diag(spread) + 1e-6 * np.diag(spread)
    factors = np.stack([np.linalg.cholesky((1 - shrink) * a / n + shrink * within) for a, n in zip(about, counts, strict=True)])
    logs = 2 * np.log(np.stack([np.diag(f) for f in factors])).sum(1)
    return Discriminant(means, np.stack([np.linalg.inv(f) for f in factors]), prior + float(logs[0] - logs[1]) / 2, heat)


def _chosen(rows: DataFrame, cells: dict[tuple[int, int], np.ndarray]) -> tuple[float, float, float]:
    """(shrink, diagonal, heat) of the least log loss over folds, each scored by a model of the others. rows: quality, fold, features."""
    folds = sorted({f for _, f in cells})
    grid = list(itertools.product(SHRINKS, DIAGONALS))
    rest = {f: {c: sum(g for (k, x), g in cells.items() if k == c and x != f) for c in (0, 1) if any(k == c and x != f for k, x in cells)} for f in folds}
    if any(len(x) < 2 for x in rest.values()) or len(folds) < 2:
        return SHRINKS[-1], DIAGONALS[-1], 1.0
    shared = rows.sparkSession.sparkContext.broadcast({f: [fitted(x, *g) for g in grid] for f, x in rest.items()})

    def run(batches):
        total = np.zeros((len(grid), len(HEATS)))
        for batch in batches:
            if not batch.num_rows:
                continue
            sign, fold = 2.0 * batch.column(0).to_numpy() - 1, batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for f in np.unique(fold).tolist():
                own = fold == f
                for i, model in enumerate(shared.value[f]):
                    odds = model.odds(x[own]) * sign[own]
                    total[i] += [np.logaddexp(0, -odds / heat).sum() for heat in HEATS]
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size, dtype=np.int32), "loss": total.ravel()})

    losses = rows.mapInArrow(run, "place int, loss double").groupBy("place").agg(F.sum("loss").alias("loss")).collect()  # a row for each choice
    best = min(losses, key=lambda r: (round(r["loss"], 9), r["place"]))["place"]
    return *grid[best // len(HEATS)], HEATS[best % len(HEATS)]


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 from `cut` on).

    Learned from rows that are not held out and have a quality of 0 or 1 in labels (doc_id, quality), by their statistics
    alone; a row counts once for each of its labels, null ids and other qualities teach nothing. A null text is as an empty
    one, which has statistics like any other. Repeated rows and ties get equal answers. With labels of one kind or none,
    every row has the share of label 1, one row of each being added. Further columns are ignored.
    """
    spark = docs.sparkSession

    def told(batches):
        for batch in batches:
            for piece in pieces(batch.column(1)):
                found = statistics(piece)
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                own = batch.slice(piece.first, len(found))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(told), f"doc_id {kind}, features array<double>"))
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    taught = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    taught = stored(rows.join(taught, "doc_id").withColumn("fold", fold).where("fold <> 0").select("quality", "fold", "features"))
    sums = ridge.gram_sums(taught.withColumn("y", F.lit(0.0)), ["quality", "fold"]).toPandas()  # ten matrices at most
    cells = {(int(q), int(f)): ridge.matrix(g) for (q, f), g in sums.groupby(["quality", "fold"])}
    shrink, diagonal, heat = _chosen(taught, cells)
    every = {c: sum(g for (k, _), g in cells.items() if k == c) for c in {k for k, _ in cells}}
    shared = spark.sparkContext.broadcast(fitted(every, shrink, diagonal, heat))

    def scored(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(scored, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
