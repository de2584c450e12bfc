"""Flexibility tables, and the k-mer dictionary that is computed from them once."""

from __future__ import annotations

from functools import cache
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

BASES = "ACGT"
#: Ids before the k-mers'.
SPECIALS = {"[PAD]": 0, "[CLS]": 1, "[MASK]": 2, "[UNK]": 3}

# Published scales of DNA flexibility, by word, for one strand. A word and its reverse complement have equal
# values, so each pair is given once, under the word that comes first. gc is a rule: the share of C and G.
_DI = """
xDisp            AA=-0.323 AC=-0.719 AG=-0.948 AT=-0.7 CA=0.986 CC=0.519 CG=0.869 GA=-0.297 GC=0.853 TA=0.162
wedge            AA=7.2 AC=1.1 AG=8.4 AT=2.6 CA=3.5 CC=2.1 CG=6.7 GA=5.3 GC=5.0 TA=0.9
prop             AA=-17.3 AC=-6.7 AG=-14.3 AT=-16.9 CA=-8.6 CC=-12.8 CG=-11.2 GA=-15.1 GC=-11.7 TA=-11.1
freeen           AA=-1.0 AC=-1.44 AG=-1.28 AT=-0.88 CA=-1.45 CC=-1.84 CG=-2.17 GA=-1.3 GC=-2.24 TA=-0.58
gc
twistDisp        AA=3.9 AC=4.2 AG=4.5 AT=4.5 CA=6.5 CC=5.2 CG=5.5 GA=4.4 GC=4.7 TA=5.5
stifness         AA=1820 AC=1660 AG=2390 AT=5500 CA=1370 CC=3500 CG=1340 GA=1230 GC=2350 TA=1990
bendingstiffness AA=35 AC=60 AG=60 AT=20 CA=60 CC=130 CG=85 GA=60 GC=85 TA=20
"""
_TRI = """
NPP AAA=36 AAC=6 AAG=6 AAT=30 ACA=6 ACC=8 ACG=8 ACT=11 AGA=9 AGC=25 AGG=8 ATA=13 ATC=7 ATG=18 CAA=9 CAC=17
    CAG=2 CCA=8 CCC=13 CCG=2 CGA=31 CGC=25 CTA=18 CTC=8 GAA=12 GAC=8 GCA=13 GCC=45 GGA=5 GTA=6 TAA=20 TCA=8
DNaseI AAA=-0.274 AAC=-0.205 AAG=-0.081 AAT=-0.28 ACA=-0.006 ACC=-0.032 ACG=-0.033 ACT=-0.183 AGA=0.027 AGC=0.017
    AGG=-0.057 ATA=0.182 ATC=-0.11 ATG=0.134 CAA=0.015 CAC=0.04 CAG=0.175 CCA=-0.246 CCC=-0.012 CCG=-0.136 CGA=-0.003
    CGC=-0.077 CTA=0.09 CTC=0.031 GAA=-0.037 GAC=-0.013 GCA=0.076 GCC=0.107 GGA=0.013 GTA=0.025 TAA=0.068 TCA=0.194
bendabilityDNase AAA=0.1 AAC=1.6 AAG=4.2 AAT=0 ACA=5.8 ACC=5.2 ACG=5.2 ACT=2 AGA=6.5 AGC=6.3 AGG=4.7 ATA=9.7 ATC=3.6
    ATG=8.7 CAA=6.2 CAC=6.8 CAG=9.6 CCA=0.7 CCC=5.7 CCG=3 CGA=5.8 CGC=4.3 CTA=7.8 CTC=6.6 GAA=5.1 GAC=5.6 GCA=7.5
    GCC=8.2 GGA=6.2 GTA=6.4 TAA=7.3 TCA=10
bendabilityConcensus AAA=0.05 AAC=2.65 AAG=4.7 AAT=0.35 ACA=5.5 ACC=5.3 ACG=5.3 ACT=3.9 AGA=4.9 AGC=6.9 AGG=5.05 ATA=6.25
    ATC=4.45 ATG=7.7 CAA=4.75 CAC=6.65 CAG=6.9 CCA=3.05 CCC=5.85 CCG=3.85 CGA=7.05 CGC=5.9 CTA=5 CTC=6 GAA=4.05 GAC=5.5
    GCA=6.75 GCC=9.1 GGA=5 GTA=5.05 TAA=4.65 TCA=7.7
"""

Table = dict[str, float]


class Feature(NamedTuple):
    index: int
    name: str
    width: int  #: letters of a word
    values: Table


def reverse_complement(word: str) -> str:
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _read(text: str) -> dict[str, Table]:
    out: dict[str, Table] = {}
    name = ""
    for item in text.split():
        word, _, value = item.partition("=")
        if not value:
            name = word
            out[name] = {}
        else:
            out[name][word] = out[name][reverse_complement(word)] = float(value)
    return out


def words(width: int) -> list[str]:
    return ["".join(x) for x in product(BASES, repeat=width)]


@cache
def features() -> tuple[Feature, ...]:
    """The twelve features: eight over pairs of bases, then four over triples."""
    di, tri = _read(_DI), _read(_TRI)
    di["gc"] = {x: sum(c in "CG" for c in x) / 2 for x in words(2)}
    return tuple(Feature(i, name, width, table) for i, (name, width, table) in enumerate([*((n, 2, t) for n, t in di.items()), *((n, 3, t) for n, t in tri.items())]))


def features_from(lookup: dict[str, dict[str, dict[str, float]]], order: dict[str, list[str]] | None = None, in_file_order: bool = False) -> tuple[Feature, ...]:
    """Features of a parsed lookup file ({dinucleotide: {name: {word: value}}, trinucleotide: ...}).

    Pairs come first, in a config's order if there is one; with in_file_order, groups and features come as in the file.
    ValueError if a group or a named feature is missing, or a word doesn't fit its group.
    """
    widths = {"dinucleotide": 2, "trinucleotide": 3}
    for group in widths:
        if group not in lookup:
            raise ValueError(f"the lookup has no {group}")
    out = []
    for group in (g for g in lookup if g in widths) if in_file_order else widths:
        for name in order[group] if order else lookup[group]:
            if name not in lookup[group]:
                raise ValueError(f"the lookup has no {group} feature {name}")
            table = {str(w).upper(): float(v) for w, v in lookup[group][name].items()}
            if any(len(w) != widths[group] for w in table):
                raise ValueError(f"{name} has words that are not {widths[group]} letters")
            out.append(Feature(len(out), name, widths[group], table))
    return tuple(out)


def feature_names() -> list[str]:
    return [f.name for f in features()]


def token_flexibility(kmer: str, feature: Feature, strict: bool = True) -> float:
    """Mean over a k-mer's words. Strict: KeyError for an unknown word; else it counts as 0. No word: 0."""
    parts = [kmer[i : i + feature.width] for i in range(len(kmer) - feature.width + 1)]
    values = [feature.values[x] if strict else feature.values.get(x, 0.0) for x in parts]
    return sum(values) / len(values) if values else 0.0


def lookup_frame(spark: SparkSession, used: tuple[Feature, ...] | None = None) -> DataFrame:
    """(feature_index, feature, width, word, value)."""
    rows = [(f.index, f.name, f.width, w, v) for f in used or features() for w, v in sorted(f.values.items())]
    return spark.createDataFrame(rows, "feature_index int, feature string, width int, word string, value double")


def kmer_frame(spark: SparkSession, k: int = 6) -> DataFrame:
    """(kmer, token_id, flex): every k-mer of the four bases with its twelve means. 4 ** k rows; k is at most 6."""
    if not 1 <= k <= 6:
        raise ValueError("the dictionary has 4 ** k rows and is broadcast; k is from 1 to 6")
    rows = [(x, i + len(SPECIALS), [token_flexibility(x, f) for f in features()]) for i, x in enumerate(words(k))]
    return spark.createDataFrame(rows, "kmer string, token_id int, flex array<double>")


def vocabulary_frame(spark: SparkSession, k: int = 6) -> DataFrame:
    """(token, token_id): specials, then k-mers in alphabetical order."""
    rows = [*SPECIALS.items(), *((x, i + len(SPECIALS)) for i, x in enumerate(words(k)))]
    return spark.createDataFrame(rows, "token string, token_id int")
