"""Numbered lines, FASTA ranges, exact medians, the stateful stream and SQL functions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from motifold.functions import sql
from motifold.functions.sequences import kmers, one_hot, token_id
from motifold.operators import metrics, order_stats
from motifold.sources import fasta, text
from motifold.streaming.running_stats import run_stateful, windowed_stats

# -- lines -----------------------------------------------------------------------------------------------------------


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    own = random.Random(1)
    plain = []
    for name in ("a.txt", "b.txt", "c.txt"):
        rows = [own.choice(["", "acgt", " ac g ", "x" * own.randrange(40)]) for _ in range(own.randrange(1, 90))]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        plain += [(name, x) for x in rows]
    (tmp_path / "d.txt").write_text("")
    for size in ("64", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = sorted((r.line, r.file, r.value) for r in text.numbered_lines(spark, str(tmp_path)).collect())
            assert found == [(i, *x) for i, x in enumerate(plain)]
            for most in (0, 1, 7, len(plain) - 1, len(plain) + 5):
                few = text.numbered_lines(spark, str(tmp_path), most)
                assert sorted((r.line, r.file, r.value) for r in few.collect()) == found[:most]
                seqs = sorted((r.line, r.seq) for r in text.one_per_line(few).collect())
                assert seqs == [(i, x.strip().upper()) for i, (_, x) in enumerate(plain[:most]) if x.strip()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_written_by_split(spark, tmp_path):
    rows = spark.createDataFrame([("AC", "train"), ("GG", "val"), ("TT", "train"), (None, "val")], "seq string, split string")
    text.write_lines(rows, str(tmp_path / "out"), by="split")
    found = {s: sorted(r.value for r in spark.read.text(str(tmp_path / f"out/split={s}")).collect()) for s in ("train", "val")}
    assert found == {"train": ["AC", "TT"], "val": ["", "GG"]}


# -- FASTA -----------------------------------------------------------------------------------------------------------


def genome(folder, sizes, width=60, end="\n", last=True):
    own = random.Random(len(sizes))
    seqs = {f"chr{i}": "".join(own.choice("acgtN") for _ in range(n)) for i, n in enumerate(sizes)}
    body = end.join(line for name, s in seqs.items() for line in (f">{name} some text", *(s[i : i + width] for i in range(0, len(s), width))))
    (folder / "g.fa").write_bytes((body + (end if last else "")).encode())
    return seqs, f"file://{folder}/g.fa"


def joined(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.chrom, r.start)):
        assert r.start == len(out.get(r.chrom, ""))
        out[r.chrom] = out.get(r.chrom, "") + r.seq
    return out


@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\r\n", True), ("\n", False), ("\r\n", False)])
def test_fasta_ranges(spark, tmp_path, end, last):
    """Records over range ends, empty ones, ones that end with a whole line, with both line ends, and without the last."""
    seqs, path = genome(tmp_path, (0, 1, 59, 60, 61, 5000, 120, 777), end=end, last=last)
    for size in (90, 1 << 20):
        index = f"file://{tmp_path}/index{size}"
        assert {r.chrom: r.length for r in fasta.fasta_index(spark, path, index, size).collect()} == {c: len(s) for c, s in seqs.items()}
    for letters in (10, 64, 100_000):
        rows = fasta.read_fasta(spark, path, index, range_bytes=500, row_letters=letters)
        assert joined(rows.collect()) == {c: s.upper() for c, s in seqs.items() if s}
    lapped = fasta.read_fasta(spark, path, index, ["chr5"], overlap=9, row_letters=100).collect()
    assert all(r.seq == seqs["chr5"][r.start : r.start + 109].upper() for r in lapped) and len(lapped) == 50


def test_fasta_reads_chosen_records_alone(spark, tmp_path, capsys):
    seqs, path = genome(tmp_path, (5000, 100, 20_000, 300))
    index = f"file://{tmp_path}/index"
    fasta.fasta_index(spark, path, index)
    rows = fasta.read_fasta(spark, path, index, ["chr1", "chr3"])
    rows.explain("formatted")
    assert "PushedFilters: [In(chrom, [chr1,chr3])]" in capsys.readouterr().out
    assert joined(rows.collect()) == {c: seqs[c].upper() for c in ("chr1", "chr3")}
    sizes = []
    for names in (None, {"chr2"}, {"chr1", "chr3"}, {"chr9"}):
        reader = fasta.FastaReader({"path": path, "index": index, "rangebytes": "1000", "rowletters": "500"})
        assert names is None or list(reader.pushFilters([fasta.In(("chrom",), tuple(names))])) == []
        sizes.append(sum(p.size() for p in reader.partitions()))
    assert 25_400 < sizes[0] < 26_500 and 20_000 <= sizes[1] < 20_800 and 400 <= sizes[2] < 420 and sizes[3] == 0
    with pytest.raises(ValueError, match="none of"):
        fasta.read_fasta(spark, path, index, ["chr9"])


def test_fasta_tells_uneven_lines(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nACGT\nAC\nACGT\n>b\nACG\n")
    fasta.fasta_index(spark, f"file://{tmp_path}/g.fa", f"file://{tmp_path}/index")
    assert fasta.read_fasta(spark, f"file://{tmp_path}/g.fa", f"file://{tmp_path}/index", ["b"]).first().seq == "ACG"
    with pytest.raises(Exception, match="uneven"):
        fasta.read_fasta(spark, f"file://{tmp_path}/g.fa", f"file://{tmp_path}/index").collect()


# -- medians ---------------------------------------------------------------------------------------------------------


def test_medians_of_large_groups(spark):
    own = random.Random(3)
    groups = {
        "even": [own.gauss(0, 1) for _ in range(3000)], "odd": [own.gauss(0, 1) ** 9 for _ in range(2999)], "ties": [float(own.randrange(3)) for _ in range(3000)], "one": [5.0] * 2500,
        "wide": [own.choice([-1, 1]) * 10.0 ** own.randrange(-300, 300) for _ in range(3000)], "inf": [float("inf")] * 1400 + [float("-inf")] * 1400 + [1.0], None: [own.random() for _ in range(2000)],
        "few": [3.0, 1.0, 2.0], "steps": [float(i // 10) for i in range(4000)],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("none", None), ("even", None)], "g string, x double").repartition(5).cache()
    wanted = {g: statistics.median(v) for g, v in groups.items()} | {"none": None}
    for most in (50, 1000, 10_000):
        assert {r.g: r["median"] for r in order_stats.medians(rows, ["g"], "x", most).collect()} == wanted
    told = {r.g: r for r in metrics.summary(rows, ["g"], "x", most=100).collect()}
    plain = {r.g: r for r in metrics.summary(rows, ["g"], "x").collect()}
    assert told.keys() == plain.keys() == wanted.keys() and all(told[g]["median"] == wanted[g] and told[g].n == plain[g].n for g in wanted)
    assert order_stats.medians(rows.where("g = 'even'"), [], "x", 100).first()["median"] == wanted["even"]


def test_ranks_with_nan(spark):
    values = [float("nan")] * 600 + [float(i) for i in range(900)]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, x double").repartition(3)
    found = order_stats.ranked_values(rows, ["g"], "x", [(("g",), r, 1500) for r in (1, 450, 900, 901, 1500)], 20)
    assert [found[("g",), r] for r in (1, 450, 900)] == [0.0, 449.0, 899.0] and all(found[("g",), r] != found[("g",), r] for r in (901, 1500))


# -- stream ----------------------------------------------------------------------------------------------------------


def test_stateful_windows_restart_and_drop_late_rows(spark, tmp_path):
    day = 86_400
    rows = [(i * 3600, "ab"[i % 2] if i % 5 else None, float(i % 17) if i % 7 else None) for i in range(120)]
    frame = lambda some: spark.createDataFrame(some, "s long, event_type string, value double").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    schema, path = frame(rows).schema, str(tmp_path / "in")
    run = lambda: run_stateful(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), str(tmp_path / "out"), str(tmp_path / "check"))
    for a in (0, 50):  # a run, then another that goes on from its checkpoint
        for b in range(a, a + 50, 25):
            frame(rows[b : b + 25]).coalesce(1).write.mode("append").parquet(path)
        run()
    frame([(3600, "a", 1000.0), (99 * 3600, "a", 4.0)]).coalesce(1).write.mode("append").parquet(path)  # the first one is late
    run()
    frame(rows[100:]).coalesce(1).write.mode("append").parquet(path)
    run()
    order = lambda r: (r.starts, r.event_type or "")
    found = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=order)
    every = frame([*rows, (99 * 3600, "a", 4.0)])
    wanted = sorted((r for r in windowed_stats(every).collect() if r.n and (r.starts.timestamp() + day) <= 119 * 3600 - 600), key=order)
    assert [(r.starts, r.event_type, r.n) for r in found] == [(r.starts, r.event_type, r.n) for r in wanted] and len(found) == 12
    assert all((a["mean"], a["std"]) == pytest.approx((b["mean"], b["std"])) for a, b in zip(found, wanted, strict=True))


# -- SQL -------------------------------------------------------------------------------------------------------------


def test_sql_functions_are_the_column_functions(spark):
    assert "motifold_kmers" in sql.register(spark)
    own = random.Random(5)
    seqs = ["", "A", "ACGTN", *("".join(own.choice("ACGTN") for _ in range(n)) for n in (255, 256, 257, 261, 600))]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    rows.createOrReplaceTempView("seqs")
    for k in (1, 2, 6):
        found = spark.sql(f"SELECT id, pos, kmer, motifold_token_id(kmer, {k}) AS token_id, motifold_one_hot(kmer) AS hot FROM (SELECT id, motifold_kmers(start, letters, {k}) AS words FROM (SELECT id, motifold_chunks(seq, {k}) AS chunks FROM seqs) LATERAL VIEW inline(chunks) c) LATERAL VIEW inline(words) w")
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Join" not in found._jdf.queryExecution().executedPlan().toString()
        wanted = kmers(rows, k).select("id", "pos", "kmer", token_id(F.col("kmer"), k), one_hot(F.col("kmer")))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    told = spark.sql("SELECT motifold_reverse_complement('AACGN') AS r, motifold_gc_share('GGAC') AS gc, motifold_is_valid('ACGN') AS ok, motifold_windows('ACGTACG', 3) AS w, motifold_file_factor('a_b_c.txt') AS f, motifold_only_bases('xa-c', 'ACGT') AS b").first()
    assert tuple(told) == ("NCGTT", 0.75, False, ["ACG", "TAC", "G"], "b", "AC")
