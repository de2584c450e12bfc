import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifold.functions import flexibility as X
from motifold.functions.hashing import ranked
from motifold.functions.sequences import kmers, longest_tokens, one_hot, padded, positional_counts, positional_words, resolve_column, token_id
from motifold.operators import encoder, metrics, normalization, ridge, splits
from motifold.operators.features import FEATURE_BUILDERS, feature_matrix, pooled, token_targets, track, track_profile
from motifold.sources import text
from motifold.streaming.running_stats import read_moments, run_moments, windowed_stats

#: Worked out by hand from the published scales: token id and twelve means of the 6-mers of ACGTACGTAA.
GOLDEN = {
    "ACGTAC": (437, -0.2252, 2.18, -8.48, -1.414, 0.5, 4.72, 1662.0, 57.0, 7.0, -0.004, 5.8, 5.175),
    "CGTACG": (1738, 0.0924, 3.3, -9.38, -1.56, 0.6, 4.98, 1598.0, 62.0, 7.0, -0.004, 5.8, 5.175),
    "GTACGT": (2847, -0.2252, 2.18, -8.48, -1.414, 0.5, 4.72, 1662.0, 57.0, 7.0, -0.004, 5.8, 5.175),
    "TACGTA": (3184, -0.049, 2.14, -9.36, -1.242, 0.4, 4.98, 1728.0, 49.0, 7.0, -0.004, 5.8, 5.175),
    "ACGTAA": (436, -0.146, 3.4, -10.6, -1.326, 0.4, 4.66, 1694.0, 52.0, 10.5, 0.00675, 6.025, 5.075),
}


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")


def test_golden_tokens(spark):
    found = {r.pos: r for r in token_targets(frame(spark, ["ACGTACGTAA"])).collect()}
    assert len(found) == 5
    for pos, kmer in enumerate(["ACGTAC", "CGTACG", "GTACGT", "TACGTA", "ACGTAA"]):
        assert found[pos].kmer == kmer and found[pos].token_id == GOLDEN[kmer][0]
        assert found[pos].flex == pytest.approx(GOLDEN[kmer][1:], abs=1e-9)


def test_tables_are_strand_symmetric():
    for f in X.features():
        assert len(f.values) == 4**f.width
        assert all(f.values[w] == f.values[X.reverse_complement(w)] for w in f.values)
    for kmer in ("ACGTTA", "GGGCAT"):
        assert all(X.token_flexibility(kmer, f) == pytest.approx(X.token_flexibility(X.reverse_complement(kmer), f)) for f in X.features())


@pytest.mark.parametrize("length", [0, 5, 6, 255, 256, 257, 261, 262, 600])
def test_kmers_of_any_length(spark, length):
    seq = "".join("ACGT"[i * i % 4 - i % 3] for i in range(length))
    found = sorted((r.pos, r.kmer) for r in kmers(frame(spark, [seq])).collect())
    assert found == [(i, seq[i : i + 6]) for i in range(max(0, length - 5))]


def test_unknown_letters_by_path(spark):
    rows = frame(spark, ["ACGTNC"])
    lenient = token_targets(rows, strict=False).first()
    assert lenient.token_id == 3
    gc = next(f for f in X.features() if f.name == "gc")
    assert lenient.flex[gc.index] == pytest.approx(X.token_flexibility("ACGTNC", gc, strict=False))
    with pytest.raises(KeyError):
        X.token_flexibility("ACGTNC", gc)
    with pytest.raises(Exception, match="unknown word"):
        token_targets(rows).collect()
    hot = rows.select(one_hot(F.col("seq")).alias("x")).first().x
    assert sum(hot) == 5 and hot[16:20] == [0, 0, 0, 0]
    assert rows.select(token_id(F.col("seq")).alias("x")).first().x == 3


def test_flat_track_matches_features(spark):
    seq = "ACGTACGTAAGGNT"
    flat = FEATURE_BUILDERS["1mer12flex"]
    rows = feature_matrix(frame(spark, [seq]), "1mer12flex", len(seq)).first().features
    assert len(rows) == 4 * 14 + 4 * 12 + 8 * 13 and flat
    listed = sorted((r.place, r.value) for r in track(frame(spark, [seq])).collect())
    assert [v for _, v in listed] == pytest.approx(rows[56:])
    counted = {r.place: (r.n, r["mean"]) for r in track_profile(frame(spark, [seq, seq, "ACG"])).where("place >= 0").collect()}
    short = {r.place for r in track(frame(spark, ["ACG"])).collect()}
    assert all(n == 2 and m == pytest.approx(dict(listed)[p]) for p, (n, m) in counted.items() if p not in short)
    with pytest.raises(ValueError):
        feature_matrix(frame(spark, [seq]), "4mer", 14)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_positional_words(spark, n):
    seqs = ["ACGTNACGA", "ACG", "A", "", None, "TTTTACGT"]
    wanted = Counter()
    for s in seqs:
        for i in range(len(s or "") - n + 1):
            if "N" not in (word := s[i : i + n]):
                wanted[i * 4**n + sum("ACGT".index(c) * 4 ** (n - 1 - k) for k, c in enumerate(word))] += 1
    assert Counter(r.place for r in positional_words(frame(spark, seqs), n).collect()) == wanted
    assert {r.place: r.hits for r in positional_counts(frame(spark, seqs), n).collect()} == wanted


def test_feature_kinds(spark):
    widths = {"1mer": 144, "2mer": 560, "3mer": 2176, "1mer_flex": 282, "1mer12flex": 560}
    assert widths.keys() == FEATURE_BUILDERS.keys()
    seq = "ACGT" * 9
    for kind, width in widths.items():
        rows = {r.id: r.features for r in feature_matrix(frame(spark, [seq, "ACGTN", None, seq + "AAAA"]), kind, 36).collect()}
        assert {len(x) for x in rows.values()} == {width} and rows[0] == rows[3] and not any(rows[2])
        assert sum(rows[1][:144]) == 4 if kind.startswith("1mer") else sum(rows[1]) == 5 - int(kind[0])
    flex = next(r.features for r in feature_matrix(frame(spark, [seq]), "1mer_flex", 36).collect())[144:]
    table = {f.name: f.values for f in X.features()}
    assert flex == pytest.approx([table[n][seq[i : i + w]] for n, w in (("DNaseI", 3), ("NPP", 3), ("twistDisp", 2), ("stifness", 2)) for i in range(37 - w)])


def test_pad_and_pool(spark):
    row = spark.range(1).select(padded(F.array(F.lit(1), F.lit(2)), 4, F.lit(0)).alias("a"), padded(F.array(F.lit(1), F.lit(2)), 1, F.lit(0)).alias("b")).first()
    assert row.a == [1, 2, 0, 0] and row.b == [1]
    rows = spark.createDataFrame([(1, 1, [1.0, 5.0]), (1, 0, [9.0, 9.0]), (1, 1, [3.0, 1.0]), (2, 0, [4.0, 4.0])], "g int, m int, x array<double>")
    found = {(r.g, r.place): (r["mean"], r["max"]) for r in pooled(rows, "x", "m", ["g"]).collect()}
    assert found == {(1, 0): (2.0, 3.0), (1, 1): (3.0, 5.0), (2, 0): (0.0, -1e9), (2, 1): (0.0, -1e9)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("acgtac\t1.5\n\n  \nACGTAC x1\nACGTAA 2 7\nACG 3\nACGTAA\nACGTTT nan\n")
    told = Counter(r.reason for r in text.judged_pairs(text.lines(spark, str(tmp_path))).collect())
    assert told == {None: 2, "blank": 2, "score": 2, "short": 1, "fields": 1}
    assert sorted(r.seq for r in text.one_per_line(text.lines(spark, str(tmp_path))).collect()) == ["ACG 3", "ACGTAA", "ACGTAA 2 7", "ACGTAC\t1.5", "ACGTAC X1", "ACGTTT NAN"]
    assert text.one_per_line(text.numbered_lines(spark, str(tmp_path), 3)).count() == 1  # blank lines count
    found = {(r.seq, r.score, r["count"], r.grp) for r in text.lenient_pairs(text.lines(spark, str(tmp_path))).collect()}
    assert found == {("ACGTAC", 1.5, None, None), ("ACGTAA", 2.0, 7.0, "7")}
    with pytest.raises(ValueError):
        text.whole_pairs(text.lines(spark, str(tmp_path)), 100)
    with pytest.raises(Exception, match="not two fields|CAST_INVALID_INPUT"):
        text.strict_pairs(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.half_strict_pairs(text.lines(spark, str(tmp_path))).collect()
    for name in ("c.txt", "b.txt", "d.csv"):
        (tmp_path / name).write_text("ACGTAC 1\n")
    assert [text.file_name(x) for x in text.first_files(spark, str(tmp_path))] == ["a.txt", "b.txt", "c.txt"]
    assert [text.file_name(x) for x in text.first_files(spark, str(tmp_path), most=2)] == ["a.txt", "b.txt"]


def test_split_directory(spark, tmp_path):
    for i, name in enumerate(("train_set.txt", "vaild_set.txt", "test_set.txt")):
        (tmp_path / name).write_text("".join(f"acg {k}.5 g{i}\n" for k in range(i + 1)) + "ACG bad\nACG 7\n")
    rows = text.split_directory(spark, str(tmp_path)).collect()
    assert Counter(r.split for r in rows) == {"train": 2, "val": 3, "test": 4}
    assert {r.grp for r in rows if r.split == "val"} == {"g1", None} and {r.seq for r in rows} == {"ACG"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "seq string, n int, x double")
    text.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]
    for _ in range(2):
        text.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and len(list((tmp_path / "csv").glob("*.csv"))) == 1
    for _ in range(2):
        text.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert resolve_column(back, ["score", "x", "n"]) == "x" and resolve_column(back, ["score"], required=False) is None
    with pytest.raises(ValueError):
        resolve_column(back, ["score"])


def test_resumable_results(spark, tmp_path):
    path, asked = str(tmp_path / "results"), []

    def work(value):
        def run(left):
            asked.append(sorted(r.file for r in left.collect()))
            return left.select("file", F.when(F.col("file") == "c", float("nan")).otherwise(value).alias("r2"))

        return run

    files = lambda names: spark.createDataFrame([(x,) for x in names], "file string")
    metrics.save_resumed(spark, files("ab"), path, "file", "r2", work(0.1))
    metrics.save_resumed(spark, files("abc"), path, "file", "r2", work(0.2))
    metrics.save_resumed(spark, files("abcd"), path, "file", "r2", work(0.3))
    assert asked == [["a", "b"], ["c"], ["c", "d"]]
    found = {r.file: r.r2 for r in metrics.read_resumed(spark, path, "file").collect()}
    assert {k: v for k, v in found.items() if k != "c"} == {"a": 0.1, "b": 0.1, "d": 0.3} and math.isnan(found["c"])
    assert metrics.read_resumed(spark, str(tmp_path / "none"), "file") is None


def test_lookup_orders():
    groups = {f"{n}nucleotide": {f.name: f.values for f in X.features() if f.width == w} for n, w in (("tri", 3), ("di", 2))}
    assert [f.name for f in X.features_from(groups)] == X.feature_names()
    assert [f.name for f in X.features_from(groups, in_file_order=True)] == X.feature_names()[8:] + X.feature_names()[:8]
    config = {"dinucleotide": ["wedge"], "trinucleotide": ["NPP"]}
    assert [(f.index, f.name) for f in X.features_from(groups, config)] == [(0, "wedge"), (1, "NPP")]
    for bad in ({"dinucleotide": {}}, groups | {"dinucleotide": {"wedge": {"ACG": 1}}}):
        with pytest.raises(ValueError):
            X.features_from(bad)
    with pytest.raises(ValueError):
        X.features_from(groups, {"dinucleotide": ["none"], "trinucleotide": []})


def test_ranks_within_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("g"))
    found: dict = {}
    for r in ranked(rows, 7, "id", "g").collect():
        found.setdefault(r.g, []).append(r["rank"])
    assert {k: sorted(v) == list(range(1, len(v) + 1)) for k, v in found.items()} == {"a": True, "b": True, None: True}
    assert Counter(r.g for r in splits.capped(rows, "id", 5, "g").collect()) == {"a": 5, "b": 5, None: 5}
    few, many = (splits.capped(rows, "id", 900, "g", seed=7), ranked(rows, 7, "id", "g").where("rank <= 900"))
    assert {r.id for r in few.collect()} == {r.id for r in many.collect()}
    assert splits.subset(rows, "id", 100).count() == 100 and splits.subset(rows, "id", 0).count() == splits.subset(rows, "id", 4000).count() == 3000
    assert {r.id for r in splits.subset(rows, "id", 100).collect()} - {r.id for r in splits.subset(rows, "id", 200).collect()}


def test_inner_folds(spark):
    rows = spark.range(103).select("id", (F.col("id") % 2).alias("g"))
    found = splits.inner_folds(rows, "id", 5, 3, within="g").collect()
    assert len(found) == 103
    for g in (0, 1):
        own = [r for r in found if r.g == g]
        assert max(Counter(r.outer for r in own).values()) - min(Counter(r.outer for r in own).values()) <= 1
        for o in range(5):
            sizes = Counter(r.inner[o] for r in own if r.outer != o)
            assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 1
            assert all(r.inner[o] == -1 for r in own if r.outer == o)


def test_sampled_windows(spark):
    seqs = ["ACGT" * 20, "ACGTN" * 20, "AC", "N" * 50 + "ACGTACGTACGT"]
    chunks = spark.createDataFrame([(f"c{i}", a, s[a : a + 30]) for i, s in enumerate(seqs) for a in range(0, len(s), 23)], "chrom string, start long, seq string")
    found = splits.sampled_windows(chunks, 400, 5).collect()
    assert len(found) == 400 and all(r.seq == seqs[int(r.chrom[1])][r.start : r.start + 5] and set(r.seq) <= set("ACGT") for r in found)
    assert {r.chrom for r in found} == {"c0", "c3"} and sorted({r.draw for r in found}) == [r.draw for r in found]
    assert {tuple(r) for r in splits.sampled_windows(chunks.repartition(5), 400, 5).collect()} == {tuple(r) for r in found}
    assert splits.sampled_windows(chunks.where("chrom = 'c2'"), 10, 5, tries=20).count() == 0
    rare = splits.sampled_windows(chunks.where("chrom in ('c1', 'c3')"), 50, 12, tries=500).collect()
    assert len(rare) == 50 and {r.start for r in rare} == {50}


def test_fasta_over_blocks(spark, tmp_path):
    random = np.random.default_rng(1)
    genome = {f"chr{i}": "".join(random.choice(list("acgtN"), 400)) for i in (1, 2, 3)}
    (tmp_path / "g.fa").write_text("".join(f">{n} about\n" + "\n".join(s[i : i + 50] for i in range(0, 400, 50)) + "\n" for n, s in genome.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = text.fasta(spark, str(tmp_path / "g.fa"), ["chr1", "chr3"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("chr1", "chr3"):
        own = sorted((r.start, r.seq) for r in rows if r.chrom == name)
        assert "".join(s for _, s in own) == genome[name].upper() and [a for a, _ in own] == list(range(0, 400, 50))
    assert {r.chrom for r in rows} == {"chr1", "chr3"}
    with pytest.raises(ValueError):
        text.fasta(spark, str(tmp_path / "g.fa"), ["chr9"])


def test_stats_layouts():
    names = ["a", "b"]
    flat = text.parsed_stats({"mean": [1, 2], "std": [0, 3]}, names)
    assert flat == text.parsed_stats({"means": [1, 2], "stds": [0, 3]}, names) == text.parsed_stats({"a": {"mean": 1, "std": 0}, "b": {"mean": 2, "std": 3}}, names)
    assert flat.std == [1.0, 3.0] and text.parsed_stats({}, names) is None
    with pytest.raises(ValueError):
        text.parsed_stats({"feature_names": ["b", "a"], "mean": [1, 2], "std": [1, 1]}, names)


def test_stats_are_written_and_read(spark, tmp_path):
    lines = spark.createDataFrame([(0, ""), (1, "ACGTACGTAA"), (2, "GGGAAACCCC"), (3, "TTTTTTTT")], "line int, seq string")
    stats = normalization.flexibility_stats(normalization.first_lines(lines, 3))
    text.write_stats(stats, str(tmp_path / "stats.yaml"), 3)
    told = text.read_yaml(spark, str(tmp_path / "stats.yaml"))
    assert told["feature_names"] == X.feature_names() and told["n_tokens"] == 10 and told["max_windows_used"] == 3
    found = text.read_stats(spark, str(tmp_path / "stats.yaml"), X.feature_names())
    values = np.array([[X.token_flexibility(s[i : i + 6], f) for f in X.features()] for s in ("ACGTACGTAA", "GGGAAACCCC") for i in range(5)])
    assert found.mean == pytest.approx(values.mean(0)) and found.std == pytest.approx(values.std(0))
    assert normalization.first_lines(lines, None).count() == 4
    scaled = spark.range(1).select(normalization.normalized(F.array(*map(F.lit, values[0].tolist())), found.mean, found.std).alias("z")).first().z
    assert scaled == pytest.approx(((values[0] - values.mean(0)) / values.std(0)).tolist())
    (tmp_path / "other.yaml").write_text("a: 1\n")
    with pytest.warns(UserWarning, match="no statistics"):
        assert text.read_stats(spark, str(tmp_path / "other.yaml"), ["a"]) is None
    assert longest_tokens(lines).first().n == 5
    with pytest.raises(Exception, match="no sequence of 6 letters"):
        longest_tokens(lines.where("line = 0")).collect()


def test_split_sizes(spark):
    rows = spark.range(1071)
    sizes = Counter(r.split for r in splits.split_by_share(rows, "id").collect())
    assert sizes == {"train": 856, "val": 107, "test": 108}
    assert sorted(Counter(r.fold for r in splits.folds(rows, "id", 10).collect()).values()) == [107] * 9 + [108]
    subsets: dict = {}
    for r in splits.nested_subsets(rows, "id", [1, 10, 100]).collect():
        subsets.setdefault(r.percent, set()).add(r.id)
    assert [len(subsets[p]) for p in (1, 10, 100)] == [16, 108, 1071] and subsets[1] < subsets[10] < subsets[100]
    again = splits.split_by_share(rows.repartition(7), "id").collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in splits.split_by_share(rows, "id").collect()}


def test_dominant_length_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([("f", i, "A" * n) for i, n in enumerate([10, 8, 8, 10])], "file string, i int, seq string")
    assert splits.dominant_length(rows, "file", "seq", "i").first().length == 10


def test_masks_have_one_at_least(spark):
    rows = spark.range(300).withColumn("forced", splits.forced_position("id", F.lit(4), 0.05))
    tokens = rows.select("id", "forced", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    found = tokens.withColumn("masked", splits.masked("id", "forced", share=0.05)).groupBy("id").agg(F.count_if("masked").alias("n")).collect()
    assert len(found) == 300 and min(r.n for r in found) == 1
    assert spark.range(1).select(splits.forced_position("id", F.lit(0)).alias("x")).first().x is None
    assert [r.x for r in spark.range(5).select(splits.fixed_position(F.col("id").cast("int")).alias("x")).orderBy("id").collect()] == [None, 0, 1, 2, 2]


def test_metrics_on_constants(spark):
    row = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0)], "y double, p double").agg(metrics.pearson("y", "p").alias("a"), metrics.r2("y", "p", "null").alias("b"), metrics.r2("y", "p", "exact").alias("c"), metrics.r2("y", "p").alias("d")).first()
    assert row.a == 0.0 and row.b is None and row.c == 0.0 and row.d < -1e9
    assert metrics.summary(spark.createDataFrame([("a", 1.0)], "g string, x double"), ["g"], "x", fill=0.0).first()["std"] == 0.0


def direct_ridge(x, y, alpha):
    xm, ym = x.mean(0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_ridge_from_sums(spark):
    random = np.random.default_rng(3)
    x = random.standard_normal((200, 5)) + 100
    y = x @ np.arange(5) + random.standard_normal(200)
    rows = spark.createDataFrame([(int(i % 4), a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "fold int, features array<double>, y double").repartition(3)
    cells = {k: ridge.matrix(g) for k, g in ridge.gram_sums(rows, ["fold"]).toPandas().groupby("fold")}
    train, test = sum(g for f, g in cells.items() if f), cells[0]
    fold = np.arange(200) % 4
    for alpha in (0.1, 10.0):
        w, b = direct_ridge(x[fold > 0], y[fold > 0], alpha)
        fit = ridge.solve(train, alpha)
        assert fit.weights == pytest.approx(w, abs=1e-6)
        p, t = x[fold == 0] @ w + b, y[fold == 0]
        found = ridge.scores(test, fit)
        assert found["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), abs=1e-6)
        assert found["pearson"] == pytest.approx(np.corrcoef(t, p)[0, 1], abs=1e-6)
    whole = sum(cells.values())
    loo = {r.alpha: r.mean_square for r in ridge.leave_one_out(rows, whole, (1.0,)).collect()}
    errors = []
    for i in range(200):
        keep = np.arange(200) != i
        w, b = direct_ridge(x[keep], y[keep], 1.0)
        errors.append((y[i] - x[i] @ w - b) ** 2)
    assert loo[1.0] == pytest.approx(np.mean(errors), rel=1e-6)


def test_a_failing_group_does_not_end_the_others(spark):
    rows = spark.createDataFrame([("a", "train", [1.0], 1.0), ("a", "train", [2.0], 2.0), ("b", "val", [1.0], 1.0)], "g string, split string, features array<double>, y double")
    found = {r.g: r.status for r in ridge.solved(ridge.gram_sums(rows, ["g", "split"]), ["g"], ["split"], lambda c: {"w": float(ridge.solve(c["train"], 1.0).weights[0])}, "w double").collect()}
    assert found["a"] == "ok" and "KeyError" in found["b"]


def test_ragged_and_null_features_are_told(spark):
    rows = [("a", "train", [1.0, 2.0], 1.0), ("a", "train", [2.0, 1.0], 2.0), ("a", "train", None, 5.0), ("a", "train", [1.0, None], 5.0), ("a", "train", [1.0, 1.0], None), ("b", "train", [1.0, 2.0, 3.0], 1.0), ("b", "train", [1.0], 1.0), (None, "train", [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "g string, split string, features array<double>, y double")
    fit = lambda c: {"n": float(c["train"][0, 0])}
    for parts in (1, 4):
        found = {r.g: (r.n, r.status) for r in ridge.solved(ridge.gram_sums(df.repartition(parts), ["g", "split"]), ["g"], ["split"], fit, "n double").collect()}
        assert found["a"] == (2.0, "ok") and found[None] == (1.0, "ok") and "1 and 3 features" in found["b"][1]
    with pytest.raises(Exception, match="other than 2 features"):
        ridge.leave_one_out(df, ridge.matrix(ridge.gram_sums(df.where("g = 'a'"), []).toPandas())).collect()


def brute_nested(x, y, outer, inner, alphas=ridge.ALPHAS):
    out, chosen = np.zeros(len(y)), []
    for o in sorted(set(outer)):
        train, means = outer != o, []
        for alpha in alphas:
            own = []
            for i in sorted(set(inner[train, o])):
                fit, val = train & (inner[:, o] != i), train & (inner[:, o] == i)
                w, b = direct_ridge(x[fit], y[fit], alpha)
                own.append(1 - ((y[val] - x[val] @ w - b) ** 2).sum() / ((y[val] - y[val].mean()) ** 2).sum())
            means.append(np.mean(own))
        chosen.append(alphas[int(np.argmax(means))])
        w, b = direct_ridge(x[train], y[train], chosen[-1])
        out[~train] = x[~train] @ w + b
    return {"n": len(y), "alpha": np.median(chosen), "r2": 1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum(), "pearson": np.corrcoef(y, out)[0, 1], "rmse": np.sqrt(((y - out) ** 2).mean())}


def test_nested_folds(spark, monkeypatch):
    random = np.random.default_rng(6)
    x = random.standard_normal((90, 8))
    y = x @ np.arange(8.0) + 4 * random.standard_normal(90)
    wide = np.concatenate([x, random.standard_normal((90, 120))], 1)
    for features in (x, wide):
        rows = spark.createDataFrame([(i, "g" if i < 60 else "h", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(features, y, strict=True))], "id int, g string, features array<double>, y double")
        folded = splits.inner_folds(rows, "id", 4, 3, within="g").cache()
        given = sorted(folded.collect(), key=lambda r: r.id)
        outer, inner = np.array([r.outer for r in given]), np.array([r.inner for r in given])
        # In a task from rows with rows, in a task from sums, and from distributed sums.
        for values, products in ((ridge.MOST_VALUES, 1000), (ridge.MOST_VALUES, 0), (0, 0)):
            monkeypatch.setattr(ridge, "MOST_VALUES", values)
            monkeypatch.setattr(ridge, "MOST_PRODUCTS", products)
            for r in ridge.nested_folds(folded, ["g"], "outer", "inner", features.shape[1]).collect():
                own = np.array([q.g == r.g for q in given])
                wanted = brute_nested(features[own], y[own], outer[own], inner[own])
                assert r.status == "ok" and {k: r[k] for k in wanted} == pytest.approx(wanted, rel=1e-6, abs=1e-6)
    broken = folded.withColumn("features", F.when(F.col("id") == 3, F.array(F.lit(1.0))).otherwise(F.col("features")))
    monkeypatch.undo()
    found = {r.g: r.status for r in ridge.nested_folds(broken, ["g"], "outer", "inner", 128).collect()}
    assert found["h"] == "ok" and "features" in found["g"]


def test_subsets_share_sums(spark):
    random = np.random.default_rng(7)
    x = random.standard_normal((300, 4))
    y = x @ np.arange(4.0) + random.standard_normal(300)
    rows = splits.split_by_share(spark.createDataFrame([(i, "m", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, model string, features array<double>, y double"), "id")
    percents = [3, 10, 100]
    train = rows.where("split = 'train'")
    bands = splits.subset_bands(train, "id", percents)
    sums = ridge.gram_sums(bands.unionByName(rows.where("split <> 'train'").withColumn("band", F.lit(-1))), ["model", "split", "band"])
    found = {r.percent: r for r in ridge.solved(sums, ["model"], ["split", "band"], lambda c: ridge.subset_scores(c, percents, False), f"percent double, n_train long, {ridge.VALIDATED}").collect()}
    subsets: dict = {}
    for r in splits.nested_subsets(train.select("id"), "id", percents).collect():
        subsets.setdefault(r.percent, []).append(r.id)
    split = {s: [r.id for r in rows.collect() if r.split == s] for s in ("val", "test")}
    score = lambda ids, w, b: 1 - ((y[ids] - x[ids] @ w - b) ** 2).sum() / ((y[ids] - y[ids].mean()) ** 2).sum()
    for percent, ids in subsets.items():
        fits = [direct_ridge(x[ids], y[ids], a) for a in ridge.ALPHAS]
        best = int(np.argmax([score(split["val"], *f) for f in fits]))
        assert found[percent].n_train == len(ids) and found[percent].alpha == ridge.ALPHAS[best] and found[percent].test_r2 == pytest.approx(score(split["test"], *fits[best]), abs=1e-9)


def test_heads_from_sums(spark):
    random = np.random.default_rng(8)
    x = random.standard_normal((500, 3)) * [1, 5, 0.2] + 3
    y = np.tanh(x[:, 0] - 3) * 2 + x[:, 1] - 4 * x[:, 2] + 0.1 * random.standard_normal(500)
    rows = spark.createDataFrame([(i, "g" if i % 2 else "h", a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, "g", None, 1.0)], "id int, g string, features array<double>, y double")
    rows = splits.split_by_share(rows, "id").repartition(3).cache()
    for r in encoder.head_scores(rows, ["g"]).collect():
        own = [q for q in rows.collect() if q.g == r.g and q.features]
        part = {s: (np.array([q.features for q in own if q.split == s]), np.array([q.y for q in own if q.split == s])) for s in ("train", "test")}
        a = np.column_stack([np.ones(len(part["train"][0])), part["train"][0]])
        best = np.linalg.lstsq(a, part["train"][1], rcond=None)[0]
        left = part["test"][1] - part["test"][0] @ best[1:] - best[0]
        assert r.status == "ok" and r.n == len(own) and r.test_rmse == pytest.approx(np.sqrt((left**2).mean()), rel=0.15)
    many = {r.g: r for r in encoder.head_scores(rows, ["g"], (16,), rate=3e-2, epochs=12, patience=12).collect()}
    assert many.keys() == {"g", "h"} and all(r.status == "ok" and r.val_r2 > 0.9 and r.test_r2 > 0.9 for r in many.values()), many
    odd = rows.withColumn("features", F.when(F.col("id") == 4, F.array(F.lit(1.0))).otherwise(F.col("features"))).where("g = 'h' or split <> 'val'")
    found = {r.g: r.status for r in encoder.head_scores(odd, ["g"], (4,), epochs=1).collect()}
    assert "features" in found["h"] and "no rows of val" in found["g"]


def test_compared_checkpoints(spark):
    shape = encoder.Shape(width=4, heads=2, hidden=8, layers=1)
    random = np.random.default_rng(11)
    seqs = ["".join(random.choice(list("ACGT"), 12)) for _ in range(120)]
    rows = spark.createDataFrame([(i, s, s.count("G") + 0.1 * float(random.standard_normal())) for i, s in enumerate(seqs)], "id int, seq string, y double")
    sets = {f"w{n}": encoder.random_weights(n, shape) for n in (1, 2)}
    found = {r.model: r for r in encoder.compared(rows, sets, shape).collect()}
    split = {r.id: r.split for r in splits.split_by_share(rows, "id").collect()}
    y = np.array([r.y for r in rows.sort("id").collect()])
    for name, weights in sets.items():
        hidden, targets = encoder.forward(weights, *encoder.one_hot_batch(seqs, 6), shape)
        x = np.concatenate([hidden, targets], 2).reshape(120, -1)
        at = {s: np.array([split[i] == s for i in range(120)]) for s in ("train", "val", "test")}
        std = x[at["train"]].std(0)
        x = x / np.where(std < 1e-8, 1, std)
        score = lambda own, w, b: 1 - ((y[own] - x[own] @ w - b) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()  # noqa: B023, E731
        fits = [direct_ridge(x[at["train"]], y[at["train"]], a) for a in ridge.ALPHAS]
        best = int(np.argmax([score(at["val"], *f) for f in fits]))
        r = found[name]
        assert (r.n_total, r.n_train, r.n_val, r.n_test, r.alpha, r.status) == (120, 96, 12, 12, ridge.ALPHAS[best], "ok")
        assert (r.val_r2, r.test_r2) == pytest.approx((score(at["val"], *fits[best]), score(at["test"], *fits[best])), abs=1e-4)


def test_token_losses(spark):
    shape = encoder.Shape(k=3, width=8, heads=2, hidden=8, layers=1, tokens=68)
    weights = encoder.random_weights(4, shape)
    seqs = ["ACGTACGTAAC", "GGNGG", "AC", None, "TTTTTTTT"]
    for tokens in (1, 1 << 12):
        found = {r.id: r for r in encoder.token_losses(frame(spark, seqs), weights, shape, 0.4, tokens=tokens).collect()}
        rows = frame(spark, seqs).withColumn("forced", splits.forced_position("id", F.length("seq") - 2, 0.4, 12345))
        masks = {r.id: [] for r in rows.collect()}
        for r in kmers(rows, 3).withColumn("m", splits.masked("id", "forced", share=0.4, seed=12345)).where("m").collect():
            masks[r.id].append(r.pos)
        assert found[2].loss is None and found[3].loss is None
        for i in (0, 1, 4):
            x, mask = encoder.one_hot_batch([seqs[i]], 3)
            x[0, masks[i]] = 0
            logits = encoder.forward(weights, x, mask, shape)[0][0] @ weights["token_head.weight"].T
            ids = [r.x for r in kmers(frame(spark, [seqs[i]]), 3).orderBy("pos").select(token_id(F.col("kmer"), 3).alias("x")).collect()]
            own = [math.log(np.exp(logits[p]).sum()) - logits[p][ids[p]] for p in masks[i]]
            assert found[i].n_masked == len(own) and found[i].loss == pytest.approx(np.mean(own))


def test_calibration_and_totals(spark):
    rows = spark.createDataFrame([("g", "val", 1.0, 3.0), ("g", "val", 2.0, 5.0), ("g", "test", 10.0, 0.0), ("h", "test", 1.0, 1.0)], "g string, split string, p double, y double")
    found = {(r.g, r.p): r.calibrated for r in metrics.calibrated(rows, ["g"], "y", "p", F.col("split") == "val").collect()}
    assert found == {("g", 1.0): 3.0, ("g", 2.0): 5.0, ("g", 10.0): 21.0, ("h", 1.0): None}
    total = metrics.weighted_total({"a": (2.0, F.lit(1.5)), "b": (0.0, F.lit(float("nan")))})
    assert spark.range(1).select(total.alias("x")).first().x == 3.0
    values = spark.range(1001).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    assert metrics.summary(values, ["g"], "x", accuracy=1000).first()["median"] == pytest.approx(500, abs=2)


def test_standardising_a_tail_of_columns(spark):
    rows = spark.createDataFrame([(i, [float(i), 7.0, float(2 * i)]) for i in range(10)], "id int, x array<double>")
    found = {r.id: r.x for r in normalization.standardized(rows, "x", F.col("id") < 5, first=1).collect()}
    assert [found[i][:2] for i in range(10)] == [[i, 0.0] for i in range(10)] and np.std([found[i][2] for i in range(5)]) == pytest.approx(1)
    dropped = {r.id: r.x for r in normalization.standardized(rows, "x", F.col("id") < 5, drop=True).collect()}
    assert {len(x) for x in dropped.values()} == {2}


def test_small_files_are_dealt(spark, tmp_path, monkeypatch):
    from motifold import session

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    sizes = session.dealt(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 1000
    monkeypatch.setattr(session, "SMALL_BYTES", 10)
    assert session.dealt(rows) is rows


def test_merged_moments_match(spark):
    values = np.random.default_rng(0).standard_normal(1000) + 1e6
    rows = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(values)], "i int, g string, v double")
    parts = rows.groupBy("g", (F.col("i") % 7).alias("p")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")).drop("p")
    found = normalization.merged_moments(parts, "g").first()
    assert found["mean"] == pytest.approx(values.mean()) and math.sqrt(found.m2 / found.n) == pytest.approx(values.std(), rel=1e-6)


def test_padding_changes_nothing(spark):
    shape = encoder.Shape(width=16, heads=2, hidden=32)
    weights = encoder.random_weights(1, shape)
    alone = encoder.forward(weights, *encoder.one_hot_batch(["ACGTACGTAA"], 6), shape)[0][0]
    padded_ = encoder.forward(weights, *encoder.one_hot_batch(["ACGTACGTAA", "ATATCGCGTACGTA"], 6), shape)[0][0]
    assert padded_[: len(alone)] == pytest.approx(alone, abs=1e-12) and not padded_[len(alone) :].any()
    rows = encoder.encoded(frame(spark, ["ACGTACGTAA", "ACG", None]), weights, shape, "hidden_flex").orderBy("id").collect()
    assert len(rows[0].features) == 28 and rows[1].features is None and rows[2].features is None
    assert rows[0].features[:16] == pytest.approx(alone.mean(0).tolist(), abs=1e-5)
    seqs = ["ACGTACGTAAC", "ATATCGCGTAC", "GGGGGGGGGGG"]
    hidden, targets = encoder.forward(weights, *encoder.one_hot_batch(seqs, 6), shape)
    for tokens in (1, 1 << 14):
        flat = encoder.encoded(frame(spark, seqs), weights, shape, "hidden_flex", None, tokens, np.float64).orderBy("id").collect()
        assert all(r.features == pytest.approx(np.concatenate([hidden[i], targets[i]], 1).ravel().tolist()) for i, r in enumerate(flat))
        top = encoder.encoded(frame(spark, seqs), weights, shape, "hidden", "max", tokens, np.float64).orderBy("id").collect()
        assert all(r.features == pytest.approx(hidden[i].max(0).tolist()) for i, r in enumerate(top))
    with pytest.raises(ValueError):
        encoder.forward(weights, *encoder.one_hot_batch(["A" * 600], 6), shape)


def test_weights_are_strict(spark, tmp_path):
    shape = encoder.Shape(width=8, heads=2, hidden=8, layers=1, tokens=4, positions=8)
    weights = encoder.random_weights(2, shape)
    encoder.save_weights(spark, weights, str(tmp_path / "w"))
    assert all(np.array_equal(v, weights[k]) for k, v in encoder.load_weights(spark, str(tmp_path / "w"), shape).items())
    weights.pop("position")
    encoder.save_weights(spark, weights, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        encoder.load_weights(spark, str(tmp_path / "v"), shape)


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") * 1.5).alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_moments(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    told = {r.event_type: (r.n, r["mean"], r["std"]) for r in read_moments(spark, str(tmp_path / "out")).collect()}
    for r in rows.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect():
        assert told[r.event_type] == pytest.approx((r.n, r["mean"], r["std"]))
    query = windowed_stats(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").count() == windowed_stats(rows).count()
