"""FASTA files as a data source: byte ranges as partitions, chromosomes chosen before anything is read.

An index tells where each record's letters begin and how long its lines are, so the bytes of any stretch follow by
arithmetic. It is made once, by tasks that look at a range of bytes each, and kept as a table. A filter on chrom reaches the
reader, which plans ranges of the chosen records alone; a stretch that starts or ends within a line, or in another range
than its header, is read as such.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.window import Window

#: Bytes of a range, letters of a row.
RANGE_BYTES = 32 << 20
ROW_LETTERS = 1 << 16
_HEADERS = "file string, header long, chrom string, offset long, line_letters long, line_bytes long, size long, closing long"
_ROWS = "chrom string, start long, seq string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Stretch(NamedTuple):
    """Letters start to end of a record."""

    file: str
    chrom: str
    offset: int
    line_letters: int
    line_bytes: int
    start: int
    end: int
    length: int

    def place(self, letter: int) -> int:
        return self.offset + letter // self.line_letters * self.line_bytes + letter % self.line_letters


class Ranges(InputPartition):
    def __init__(self, stretches: list[Stretch]) -> None:
        self.stretches = stretches

    def size(self) -> int:
        return sum(s.place(s.end - 1) + 1 - s.place(s.start) for s in self.stretches)


class Bytes(InputPartition):
    def __init__(self, file: str, first: int, last: int, size: int) -> None:
        self.file, self.first, self.last, self.size = file, first, last, size


def opened(path: str) -> pa.NativeFile:
    from pyarrow import fs  # its threads start where it is used

    system, own = fs.FileSystem.from_uri(path)
    return system.open_input_file(own)


def files_of(path: str) -> list[tuple[str, int]]:
    """Files of a path, which may be a folder, by name, with their sizes. Names that begin with _ or . are left out."""
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path)
    info = system.get_file_info(own)
    every = system.get_file_info(fs.FileSelector(own)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    return sorted((prefix + f.path, f.size) for f in every if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def _headers(part: Bytes) -> Iterator[tuple]:
    """Records whose header begins within the range: file, header, chrom, offset, letters and bytes of the first line, and of the
    file its size and the bytes of its last line's end."""
    with opened(part.file) as source:
        data = source.read_at(part.last - part.first, part.first)
        tail = source.read_at(min(2, part.size), max(0, part.size - 2))
        closing = 2 if tail.endswith(b"\r\n") else int(tail.endswith(b"\n"))
        before = source.read_at(1, part.first - 1) if part.first else b"\n"
        at = 0 if data.startswith(b">") and before == b"\n" else data.find(b"\n>") + 1 or -1
        while at >= 0:
            lines, more = b"", 1 << 16
            while lines.count(b"\n") < 2 and len(lines) < part.size - part.first - at:
                lines = source.read_at(min(more, part.size - part.first - at), part.first + at)
                more *= 4
            name, _, rest = lines.partition(b"\n")
            line, ended, _ = rest.partition(b"\n")
            letters = line.rstrip(b"\r")
            if letters.startswith(b">"):
                letters, line, ended = b"", b"", b""
            chrom = (name[1:].split() or [b""])[0].decode()
            yield part.file, part.first + at, chrom, part.first + at + len(name) + 1, len(letters), max(1, len(line) + len(ended)), part.size, closing
            at = data.find(b"\n>", at) + 1 or -1


def _letters(stretch: Stretch) -> str:
    with opened(stretch.file) as source:
        first, last = stretch.place(stretch.start), stretch.place(stretch.end - 1) + 1
        raw = source.read_at(last - first, first)
    found = raw.replace(b"\n", b"").replace(b"\r", b"")
    # Uneven lines put other bytes where line ends are told to be.
    ends = range(stretch.line_letters - stretch.start % stretch.line_letters, len(raw), stretch.line_bytes)
    if len(found) != stretch.end - stretch.start or b">" in found or any(raw[i] not in b"\r\n" for i in ends):
        raise ValueError(f"{stretch.chrom} in {stretch.file} has lines of uneven length")
    return found.decode().upper()


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.index = options.get("index")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.row_letters = int(options.get("rowletters", ROW_LETTERS))
        self.overlap = int(options.get("overlap", 0))
        self.chosen: list[set[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.index and isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chosen.append({f.value})
            elif self.index and isinstance(f, In) and f.attribute == ("chrom",):
                self.chosen.append(set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not self.index:
            return [Bytes(file, a, min(size, a + self.range_bytes), size) for file, size in files_of(self.path) for a in range(0, size, self.range_bytes)]
        from pyarrow import fs
        from pyarrow import parquet as pq

        system, own = fs.FileSystem.from_uri(self.index)
        names = set.intersection(*self.chosen) if self.chosen else None
        wanted = None if names is None else [("chrom", "in", sorted(names))]
        records = pq.read_table(own, filesystem=system, filters=wanted).to_pylist() if names != set() else []
        out, held, size = [], [], 0
        for r in sorted(records, key=lambda r: (r["file"], r["offset"])):
            step = max(self.row_letters, self.range_bytes // self.row_letters * self.row_letters)
            for a in range(0, r["length"], step):
                own = Stretch(r["file"], r["chrom"], r["offset"], r["line_letters"], r["line_bytes"], a, min(r["length"], a + step), r["length"])
                if held and size + own.end - own.start > self.range_bytes:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(own)
                size += own.end - own.start
        return [*out, Ranges(held)] if held else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Bytes):
            yield from _headers(partition)
            return
        schema = pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("seq", pa.string())])
        for s in partition.stretches:
            for a in range(s.start, s.end, 16 * self.row_letters):
                last = min(s.end, a + 16 * self.row_letters)
                text = _letters(s._replace(start=a, end=min(s.length, last + self.overlap)))
                starts = range(a, last, self.row_letters)
                seqs = [text[b - a : b - a + min(self.row_letters, last - b) + self.overlap] for b in starts]
                yield pa.RecordBatch.from_arrays([pa.array([s.chrom] * len(seqs)), pa.array(list(starts), pa.int64()), pa.array(seqs)], schema=schema)


class FastaSource(DataSource):
    """format("motifold_fasta"): without the option index the files' headers, with it rows of letters. Other options: rangeBytes,
    rowLetters, overlap (letters of the next row that a row has too)."""

    @classmethod
    def name(cls) -> str:
        return "motifold_fasta"

    def schema(self) -> str:
        return _ROWS if "index" in self.options else _HEADERS

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.conf.set(PUSHDOWN, "true")


def fasta_index(spark: SparkSession, path: str, index: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write the index of a FASTA file or folder, a row for each record, and read it: file, chrom, offset, length, line_letters, line_bytes."""
    _register(spark)
    found = spark.read.format("motifold_fasta").option("rangeBytes", range_bytes).load(path)
    following = F.lead("header").over(Window.partitionBy("file").orderBy("header"))
    size = F.coalesce(following, F.col("size")) - F.col("offset")
    line_end = F.when(following.isNull(), F.col("closing")).otherwise(F.col("line_bytes") - F.col("line_letters"))
    # Letters of whole lines, then those of what is left, less its line end; none where the first line is empty.
    rest = size % F.col("line_bytes")
    length = F.floor(size / F.col("line_bytes")) * F.col("line_letters") + F.greatest(F.lit(0), F.least(rest - F.when(rest > 0, line_end).otherwise(0), F.col("line_letters")))
    out = found.withColumn("length", F.greatest(F.lit(0), length).cast("long"))
    out.select("file", "chrom", "offset", "length", "line_letters", "line_bytes").write.parquet(index)
    return spark.read.parquet(index)


def read_fasta(spark: SparkSession, path: str, index: str, chromosomes: list[str] | None = None, overlap: int = 0, range_bytes: int = RANGE_BYTES, row_letters: int = ROW_LETTERS) -> DataFrame:
    """(chrom, start, seq), upper-cased, in rows of row_letters letters, each with `overlap` letters of the next one's too.

    index: as fasta_index wrote it. chromosomes, or any equality or list on chrom in a later filter, choose what is read.
    ValueError at once if none of the chromosomes is there; lines of uneven length within a record are an error when read.
    Paths: local, or of a store that Arrow's file systems know.
    """
    if chromosomes is not None and spark.read.parquet(index).where(F.col("chrom").isin(chromosomes)).isEmpty():
        raise ValueError(f"none of {chromosomes} in {path}")
    _register(spark)
    reader = spark.read.format("motifold_fasta").option("index", index).option("overlap", overlap).option("rangeBytes", range_bytes).option("rowLetters", row_letters)
    rows = reader.load(path)
    return rows if chromosomes is None else rows.where(F.col("chrom").isin(chromosomes))
