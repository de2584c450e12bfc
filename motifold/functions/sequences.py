"""Columns over sequences: cleaning, k-mers, encodings, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.functions.flexibility import SPECIALS

#: Letters that are cut into one chunk before k-mers are listed, so that no row work is quadratic in a sequence's length.
CHUNK = 256


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def only_bases(text: Column, letters: str = "ACGT") -> Column:
    """Upper-cased, with all other letters removed."""
    return F.regexp_replace(F.upper(text), f"[^{letters}]", "")


def is_valid(seq: Column) -> Column:
    """Whether a sequence has no letters but the four bases; an empty one hasn't."""
    return seq.rlike("^[ACGT]*$")


def kmers(df: DataFrame, k: int = 6, seq: str = "seq") -> DataFrame:
    """A row for each overlapping k-mer of seq, in columns pos (from 0) and kmer; seq goes. Shorter sequences give none.

    A sequence is cut into chunks that overlap by k - 1, and a chunk's positions are listed: work is in proportion to its
    length, whatever that is. seq is looked at once, so what makes it isn't worked out again.
    """
    keep = [c for c in df.columns if c != seq]
    parts = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    chunk = F.transform("_parts", lambda x, i: F.struct((i * CHUNK).alias("start"), F.concat(x, F.left(F.coalesce(F.get("_parts", i + 1), F.lit("")), F.lit(k - 1))).alias("letters")))
    chunks = df.withColumn("_parts", parts).select(*keep, F.explode(chunk).alias("_chunk")).where(F.length("_chunk.letters") >= k)
    listed = chunks.select(*keep, "_chunk", F.explode(F.sequence(F.lit(1), F.length("_chunk.letters") - k + 1)).alias("_at"))
    return listed.select(*keep, (F.col("_chunk.start") + F.col("_at") - 1).cast("int").alias("pos"), F.substring(F.col("_chunk.letters"), F.col("_at"), F.lit(k)).alias("kmer"))


def kmer_list(seq: Column, k: int, made: Callable[[Column], Column]) -> Column:
    """An array of what made gives of each overlapping k-mer. Letters are looked up in overlapping chunks, as in kmers, so work is in
    proportion to the sequence's length."""
    parts = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    overlapping = lambda x: F.transform(x, lambda own, i: F.concat(own, F.left(F.coalesce(F.get(x, i + 1), F.lit("")), F.lit(k - 1))))
    starts = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - k + 1)), lambda i: i + k - 1 <= F.length(x))
    listed = lambda x: F.transform(starts(x), lambda i: made(F.substring(x, i, F.lit(k))))
    # An array of one, so that parts are made once.
    return F.flatten(F.transform(F.flatten(F.transform(F.array(parts), overlapping)), listed))


def token_id(kmer: Column, k: int = 6) -> Column:
    """Closed form of the vocabulary: specials, then base 4; [UNK] for any other letter, length or null."""
    digits = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("int")
    return F.when(kmer.rlike(f"^[ACGT]{{{k}}}$"), digits + len(SPECIALS)).otherwise(SPECIALS["[UNK]"])


def one_hot(word: Column) -> Column:
    """Flat, four numbers a letter in the order A, C, G, T; all zero for any other letter."""
    hot = F.transform(F.split(word, ""), lambda x: F.array(*(F.when(x == b, 1.0).otherwise(0.0) for b in "ACGT")))
    return F.when(F.length(word) > 0, F.flatten(hot)).otherwise(F.array().cast("array<double>"))


def word_code(word: Column, n: int) -> Column:
    """Base-4 number of an n-letter word; null if it has another letter."""
    return F.when(word.rlike(f"^[ACGT]{{{n}}}$"), F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("int"))


def positional_words(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The non-zero places of the positional n-letter one-hot: pos and place = pos * 4**n + code. Unknown words have none."""
    listed = kmers(df, n, seq)
    code = word_code(F.col("kmer"), n)
    return listed.withColumn("place", F.col("pos") * 4**n + code).where("place is not null").drop("kmer")


def positional_places(seq: Column, n: int) -> Column:
    """positional_words of a short sequence as one ascending array of places."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(seq) - n, F.lit(0))), lambda i: i + n <= F.length(seq))
    return F.array_compact(F.transform(starts, lambda i: (i * 4**n + word_code(F.substring(seq, i + 1, F.lit(n)), n)).cast("int")))


def positional_counts(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """(place, hits): how often each place of positional_words is taken. Words are counted by position before they are coded."""
    counts = kmers(df.select(seq), n, seq).groupBy("pos", "kmer").agg(F.count("*").alias("hits"))
    return counts.select((F.col("pos") * 4**n + word_code(F.col("kmer"), n)).alias("place"), "hits").where("place is not null")


def kmer_gc(df: DataFrame, k: int = 6, seq: str = "seq") -> DataFrame:
    """A row for each k-mer: pos, kmer and its share of C and G."""
    return kmers(df, k, seq).withColumn("gc", gc_share(F.col("kmer")))


def gc_share(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / F.nullif(F.length(seq), F.lit(0))


def padded(values: Column, size: int, filler: Column) -> Column:
    """An array cut or filled up to a size."""
    return F.slice(F.concat(values, F.array_repeat(filler, size)), 1, size)


def file_family(name: Column) -> Column:
    return F.get(F.split(name, "_"), F.lit(0))


def file_factor(name: Column) -> Column:
    """The second part of a file name, or all of it if there is one part."""
    stem = F.replace(name, F.lit(".txt"), F.lit(""))
    return F.coalesce(F.get(F.split(stem, "_"), F.lit(1)), stem)


def sorted_families(names: DataFrame, column: str = "file") -> DataFrame:
    """(family): each once, in alphabetical order."""
    return names.select(file_family(F.col(column)).alias("family")).distinct().orderBy("family")


def longest_tokens(seqs: DataFrame, k: int = 6, seq: str = "seq") -> DataFrame:
    """(n): k-mers of the longest sequence, one row. An error when read if none has one."""
    n = F.max(F.length(seq)) - k + 1
    return seqs.agg(F.when(F.coalesce(n, F.lit(0)) > 0, n).otherwise(F.raise_error(F.lit(f"no sequence of {k} letters or more"))).cast("int").alias("n"))


def told_number(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.printf(F.lit("%.4f"), x))


def resolve_column(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first candidate that df has. None, or ValueError if required, if it has none."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return found
