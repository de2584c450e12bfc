"""Feature tables of sequences: token targets, tracks, encodings, pooling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.functions.flexibility import BASES, SPECIALS, Feature, feature_names, features, kmer_frame, token_flexibility, words
from motifold.functions.sequences import kmers, one_hot


def token_targets(seqs: DataFrame, k: int = 6, strict: bool = True) -> DataFrame:
    """A row for each k-mer of seqs: pos, kmer, token_id and flex (twelve means).

    Strict: a k-mer with another letter is an error. Lenient: its unknown words count as 0 in the means, its id is [UNK].
    The dictionary has 4 ** k rows and is broadcast.
    """
    listed = kmers(seqs, k)
    if not strict:
        return _lenient_targets(listed, k)
    joined = listed.join(F.broadcast(kmer_frame(seqs.sparkSession, k)), "kmer", "left")
    wrong = F.raise_error(F.concat(F.lit("unknown word in "), F.col("kmer")))
    return joined.withColumn("token_id", F.when(F.col("token_id").isNull(), wrong).otherwise(F.col("token_id")))


def _lenient_targets(listed: DataFrame, k: int) -> DataFrame:
    """Each distinct k-mer of a batch is worked out once; k-mers with other letters are too many for a dictionary."""
    place = listed.columns.index("kmer")
    known = {w: i + len(SPECIALS) for i, w in enumerate(words(k))}

    def run(batches):
        held: dict[str, list[float]] = {}
        for batch in batches:
            coded = batch.column(place).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            ids = pa.array([known.get(x, SPECIALS["[UNK]"]) for x in distinct], pa.int32())
            if len(held) > 1 << 16:
                held.clear()
            held |= {x: [token_flexibility(x, f, strict=False) for f in features()] for x in distinct if x not in held}
            flex = pa.array([held[x] for x in distinct], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids.take(coded.indices), flex.take(coded.indices)], names=[*batch.schema.names, "token_id", "flex"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.mapInArrow(run, f"{kinds}, token_id int, flex array<double>")


def track(seqs: DataFrame, used: tuple[Feature, ...] | None = None) -> DataFrame:
    """Raw values at each position of seq, a row each: feature_index, feature, pos, place, value.

    place is the position in the flat track, features of triples first, then of pairs, each over all positions; an unknown
    word has the value 0. Words are listed once for each width and meet a table of 384 values, which is broadcast.
    """
    spark = seqs.sparkSession
    used = used or features()
    order = sorted(used, key=lambda f: (-f.width, f.index))
    out = None
    for width in sorted({f.width for f in order}, reverse=True):
        own = [f for f in order if f.width == width]
        listed = kmers(seqs.withColumn("_length", F.length("seq")), width)
        before = sum((F.col("_length") - f.width + 1 for f in order if f.width > width), F.lit(0))
        names = spark.createDataFrame([(i, f.index, f.name) for i, f in enumerate(own)], "turn int, feature_index int, feature string")
        values = spark.createDataFrame([(f.index, w, v) for f in own for w, v in f.values.items()], "feature_index int, kmer string, value double")
        rows = listed.crossJoin(F.broadcast(names)).join(F.broadcast(values), ["feature_index", "kmer"], "left")
        place = before + F.col("turn") * (F.col("_length") - width + 1) + F.col("pos")
        rows = rows.withColumns({"place": place, "value": F.coalesce("value", F.lit(0.0))}).drop("_length", "turn", "kmer")
        out = rows if out is None else out.unionByName(rows)
    return out


def track_profile(seqs: DataFrame, used: tuple[Feature, ...] | None = None) -> DataFrame:
    """What track() gives, summed over sequences: feature, pos, place, n, mean.

    Words are counted by length and position first, so for sequences of a few lengths a few thousand rows leave a task;
    values meet those counts, not the words.
    """
    spark = seqs.sparkSession
    order = sorted(used or features(), key=lambda f: (-f.width, f.index))
    out = None
    for width in sorted({f.width for f in order}, reverse=True):
        own = [f for f in order if f.width == width]
        counts = kmers(seqs.select("seq", F.length("seq").alias("_length")), width).groupBy("_length", "pos", "kmer").agg(F.count("*").alias("times"))
        before = sum((F.col("_length") - f.width + 1 for f in order if f.width > width), F.lit(0))
        names = spark.createDataFrame([(i, f.index, f.name) for i, f in enumerate(own)], "turn int, feature_index int, feature string")
        values = spark.createDataFrame([(f.index, w, v) for f in own for w, v in f.values.items()], "feature_index int, kmer string, value double")
        rows = counts.crossJoin(F.broadcast(names)).join(F.broadcast(values), ["feature_index", "kmer"], "left")
        place = before + F.col("turn") * (F.col("_length") - width + 1) + F.col("pos")
        rows = rows.select("feature", "pos", place.alias("place"), "times", (F.coalesce("value", F.lit(0.0)) * F.col("times")).alias("sum"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("feature", "pos", "place").agg(F.sum("times").alias("n"), (F.sum("sum") / F.sum("times")).alias("mean"))


def per_feature(aggregates: DataFrame, by: str, parts: list[str]) -> DataFrame:
    """(by, feature, parts): from one row for each key with columns part_i (i: a feature's number), a row for each feature."""
    cells = [F.struct(F.lit(n).alias("feature"), *(F.col(f"{p}_{i}").alias(p) for p in parts)) for i, n in enumerate(feature_names())]
    return aggregates.select(by, F.inline(F.array(*cells)))


def _codes(seqs: list[str], length: int) -> np.ndarray:
    """Sequences x length: 0 to 3 by base, 4 for another letter or none."""
    table = np.full(256, 4, np.uint8)
    table[[ord(b) for b in BASES]] = range(4)
    raw = "".join(s[:length].ljust(length, "?") for s in seqs).encode("latin-1", "replace")
    return table[np.frombuffer(raw, np.uint8)].reshape(len(seqs), length).astype(np.int64)


def _word_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Number of each n-letter word in base 4; 4 ** n if a letter is unknown."""
    places = codes.shape[1] - n + 1
    parts = [codes[:, i : i + places] for i in range(n)]
    return np.where(np.maximum.reduce(parts) < 4, sum(p * 4 ** (n - 1 - i) for i, p in enumerate(parts)), 4**n)


def _positional(codes: np.ndarray, n: int) -> np.ndarray:
    hot = np.eye(4**n + 1, 4**n)[_word_codes(codes, n)]
    return hot.reshape(len(codes), -1)


def _flat_track(codes: np.ndarray) -> np.ndarray:
    parts = []
    for f in sorted(features(), key=lambda f: (-f.width, f.index)):
        values = np.array([*(f.values.get(w, 0.0) for w in words(f.width)), 0.0])
        parts.append(values[_word_codes(codes, f.width)])
    return np.concatenate(parts, 1)


def _flexible_parts(codes: np.ndarray, names: tuple[str, ...] = ("DNaseI", "NPP", "twistDisp", "stifness")) -> np.ndarray:
    """Some features' values at each position: of triples first, then of pairs, each in the order of names."""
    own = {f.name: f for f in features()}
    parts = []
    for f in sorted((own[n] for n in names), key=lambda f: -f.width):
        parts.append(np.array([*(f.values.get(w, 0.0) for w in words(f.width)), 0.0])[_word_codes(codes, f.width)])
    return np.concatenate(parts, 1)


#: Feature rows by kind, from codes of sequences of one length.
FEATURE_BUILDERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "1mer": lambda codes: _positional(codes, 1),
    "2mer": lambda codes: _positional(codes, 2),
    "3mer": lambda codes: _positional(codes, 3),
    "1mer_flex": lambda codes: np.concatenate([_positional(codes, 1), _flexible_parts(codes)], 1),
    "1mer12flex": lambda codes: np.concatenate([_positional(codes, 1), _flat_track(codes)], 1),
}


def feature_matrix(rows: DataFrame, kind: str, length: int, seq: str = "seq") -> DataFrame:
    """rows with an array column features; longer sequences are cut to length, shorter ones have unknown letters at the end.

    ValueError for an unknown kind. Wide rows of constants are array work, so they are made on Arrow batches.
    """
    if kind not in FEATURE_BUILDERS:
        raise ValueError(f"feature kind {kind!r}; there are {sorted(FEATURE_BUILDERS)}")
    place = rows.columns.index(seq)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                x = FEATURE_BUILDERS[kind](_codes([s or "" for s in own.column(place).to_pylist()], length))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*own.columns, listed], names=[*own.schema.names, "features"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def placed(rows: DataFrame, n: int, length: int, name: str = "places", seq: str = "seq") -> DataFrame:
    """rows with an array column of the places of their words of n letters (see sequences.positional_places), made on Arrow batches;
    longer sequences are cut to length. Null has none."""
    place = rows.columns.index(seq)

    def run(batches):
        for batch in batches:
            codes = _word_codes(_codes([s or "" for s in batch.column(place).to_pylist()], length), n)
            taken = codes < 4**n
            values = (codes + np.arange(codes.shape[1]) * 4**n)[taken].astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(taken.sum(1))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(values))], names=[*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<int>")


def token_one_hot(seqs: DataFrame, k: int = 6) -> DataFrame:
    """A row for each k-mer: pos, kmer, onehot (4 k numbers, zero for another letter)."""
    return kmers(seqs, k).withColumn("onehot", one_hot(F.col("kmer")))


def pooled(rows: DataFrame, values: str, mask: str, by: list[str]) -> DataFrame:
    """(by, place, mean, max) over rows whose mask is not 0; without any, mean 0 and max -1e9."""
    listed = rows.select(*by, mask, F.posexplode(values).alias("place", "value"))
    held = F.when(F.col(mask) != 0, F.col("value"))
    return listed.groupBy(*by, "place").agg((F.coalesce(F.sum(held), F.lit(0.0)) / F.greatest(F.count(held), F.lit(1))).alias("mean"), F.coalesce(F.max(held), F.lit(-1e9)).alias("max"))
