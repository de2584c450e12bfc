"""Language identification by rank-order profiles of character n-grams and out-of-place distance."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.llm.shared import tidied

#: Ranks in a profile, of a language or of a document.
RANKS = 400
UNKNOWN = "und"
#: Distinct n-grams that a training task holds before it hands its counts on.
HELD_GRAMS = 1 << 21


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of the text's lower-cased words, each word between marks, packed into 64 bits."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters()[codes]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one mark after each word
    line = np.zeros(int(kept.sum()) + 2, np.int64)
    line[1:-1] = np.where(inside, codes, 0)[kept]
    a, b, c = line[:-2], line[1:-1], line[2:]
    # Marks are 0, so a pair with a mark before it needs the third place to tell it from a word's first three letters.
    middle = b > 0
    two = (line[:-1] > 0) | (line[1:] > 0)
    return np.concatenate([b[middle] << 42, ((line[:-1] + 1) << 21 | (line[1:] + 1))[two], ((a + 1) << 42 | (b + 1) << 21 | (c + 1))[middle] | (1 << 63 - 1)])


def ranked(text: str, ranks: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties by n-gram."""
    keys, counts = np.unique(grams(text), return_counts=True)
    return keys[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """Ranks of n-grams by language; broadcast, at most `ranks` entries for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int) -> None:
        self.ranks = ranks
        self.languages = sorted({x[0] for x in rows})
        self.keys = np.unique(np.array([x[1] for x in rows], np.int64))
        self.places = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        column = {x: i for i, x in enumerate(self.languages)}
        for language, key, rank in rows:
            self.places[np.searchsorted(self.keys, key), column[language]] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language of the smallest out-of-place distance (ties: the first by name), and 1 less its share of the largest possible."""
        own = ranked(text, self.ranks) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != own] = len(self.keys)
        places = self.places[at]
        away = np.where(places < 0, self.ranks, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.languages[best], float(1 - away[best] / (self.ranks * len(own)))


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}

    def out():
        for lang, parts in held.items():
            keys, counts = _counted(*map(list, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], schema=schema)
        held.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            some, size = [], 0
            for i, text in enumerate(own):
                some.append(text)
                size += len(text)
                if size > 1 << 19 or i == len(own) - 1:
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams("\n".join(some)), return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [_counted(*map(list, zip(*parts, strict=True)))]
                    some, size = [], 0
        if sum(len(x[0]) for parts in held.values() for x in parts) > HELD_GRAMS:
            yield from out()
    yield from out()


def learn(docs: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles from all rows of docs (text, lang); rows with a null in either teach nothing."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(tidied(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return Profiles([(x["lang"], x["gram"], x["rank"] - 1) for x in top.select("lang", "gram", "rank").collect()], ranks)


def identified(docs: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, the language and its score (0 to 1), from text alone. docs mustn't have columns of these names.

    `und` and 0 where text is null or has no letter, or without profiles. A text that shares no n-gram with any profile has
    the first language by name, with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        known = shared.value
        for batch in batches:
            found = [known.nearest(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*batch.schema.names, lang, score])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields)
    return docs.mapInArrow(tidied(run), f"{fields}, `{lang}` string, `{score}` double")


def held_out():
    """The fifth of documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from; a null doc_id is in no fold."""
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def language_predictions(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score; profiles come from the rows that are not held out.

    Repeated rows and ties get equal answers. With nothing to learn from, every answer is `und`.
    """
    profiles = learn(training_rows(docs), ranks)
    found = identified(docs.select("doc_id", F.col("text").cast("string").alias("text")), profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
