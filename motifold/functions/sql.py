"""The engine's functions for SQL, over built-in expressions, all named motifold_*.

They are SQL functions of the session, so Catalyst inlines them: no Python runs, and they may be used in views and joins.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from motifold.functions.flexibility import SPECIALS

#: name(arguments) RETURNS ... RETURN ...; each may use those before it.
_UNKNOWN = SPECIALS["[UNK]"]
_FUNCTIONS = {
    "only_bases": "(text STRING, letters STRING) RETURNS STRING RETURN regexp_replace(upper(text), concat('[^', letters, ']'), '')",
    "is_valid": "(seq STRING) RETURNS BOOLEAN RETURN seq RLIKE '^[ACGT]*$'",
    "gc_share": "(seq STRING) RETURNS DOUBLE RETURN (length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq), 0)",
    "token_id": f"(kmer STRING, k INT) RETURNS INT RETURN if(length(kmer) = k AND kmer RLIKE '^[ACGT]+$', cast(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS INT) + {len(SPECIALS)}, {_UNKNOWN})",
    "reverse_complement": "(seq STRING) RETURNS STRING RETURN reverse(translate(seq, 'ACGT', 'TGCA'))",
    "one_hot": "(word STRING) RETURNS ARRAY<DOUBLE> RETURN if(length(word) > 0, flatten(transform(split(word, ''), x -> array(if(x = 'A', 1D, 0D), if(x = 'C', 1D, 0D), if(x = 'G', 1D, 0D), if(x = 'T', 1D, 0D)))), cast(array() AS ARRAY<DOUBLE>))",
    "file_family": "(name STRING) RETURNS STRING RETURN get(split(name, '_'), 0)",
    "file_factor": "(name STRING) RETURNS STRING RETURN coalesce(get(split(replace(name, '.txt', ''), '_'), 1), replace(name, '.txt', ''))",
    "windows": "(seq STRING, width INT) RETURNS ARRAY<STRING> RETURN regexp_extract_all(seq, concat('.{1,', width, '}'), 0)",
    # For columns that LATERAL VIEW inline(column) lists: chunks that overlap by k - 1 letters, then a chunk's k-mers, so that no row work or array
    # is more than in proportion to a chunk. (SQL table functions would be joined with the table by its sequences.)
    "chunks": """(seq STRING, k INT) RETURNS ARRAY<STRUCT<start: INT, letters: STRING>> RETURN flatten(transform(array(regexp_extract_all(seq, '(?s).{1,256}', 0)), parts ->
        transform(parts, (x, n) -> named_struct('start', 256 * n, 'letters', concat(x, left(coalesce(get(parts, n + 1), ''), k - 1))))))""",
    "kmers": """(start INT, letters STRING, k INT) RETURNS ARRAY<STRUCT<pos: INT, kmer: STRING>> RETURN
        transform(filter(sequence(1, greatest(1, length(letters) - k + 1)), i -> i + k - 1 <= length(letters)), i -> named_struct('pos', start + i - 1, 'kmer', substr(letters, i, k)))""",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, in place of any of the same names; their names."""
    for name, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION motifold_{name}{body}")
    return [f"motifold_{name}" for name in _FUNCTIONS]
