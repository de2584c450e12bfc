"""The engine's operators over the driver's tables: sequences are the base letters of documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from motifold.functions import sql
from motifold.functions.flexibility import feature_names, features, features_from, lookup_frame, vocabulary_frame
from motifold.functions.hashing import unit
from motifold.functions.sequences import file_factor, file_family, gc_share, kmer_gc, kmer_list, kmers, longest_tokens, one_hot, only_bases, positional_counts, positional_places, sorted_families, told_number, token_id
from motifold.operators import collate, encoder, finetune, krylov, metrics, normalization, ridge, sparse_gram, splits
from motifold.operators.features import feature_matrix, per_feature, placed, pooled, token_targets, track_profile
from motifold.session import dealt, shared_path
from motifold.sources.checkpoints import Store
from motifold.sources.fasta import fasta_index, read_fasta
from motifold.sources.text import file_profile, judged_pairs, lenient_pairs, numbered_lines, one_per_line
from motifold.streaming.running_stats import batch_moments, run_stateful, windowed_stats

WINDOW = 36
TOP = 20
#: Added before rounding where exact halves are common, so that both engines round them alike.
NUDGE = 1.3e-7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents for work on each text."""
    return dealt(table(spark, sf_dir, "documents").select(*columns))


def sequences(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", only_bases(F.col("text"), letters).alias("seq"))


def windows(spark: SparkSession, sf_dir: str, width: int = WINDOW) -> DataFrame:
    """Consecutive windows of each sequence, the last of them as long as what is left: doc_id, source, j, seq."""
    parts = F.regexp_extract_all(only_bases(F.col("text")), F.lit(f".{{1,{width}}}"), F.lit(0))
    return documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", F.posexplode(parts).alias("j", "seq"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sequence and score, some of them faulty, in files named by source, with a number (line): all letters of a
    document, 8 to 14 of them a line by its id."""
    pattern = F.concat(F.lit(".{1,"), (8 + F.col("doc_id") % 7).cast("string"), F.lit("}"))
    pieces = F.posexplode(F.regexp_extract_all(only_bases(F.col("text")), pattern, F.lit(0))).alias("j", "seq")
    docs = documents(spark, sf_dir, "doc_id", "source", "n_chars", "text").select("doc_id", "source", "n_chars", pieces)
    turn = (F.col("doc_id") + F.col("j")) % 5
    fine = F.concat("seq", F.lit("\t"), (F.col("n_chars") / 4 + F.col("j")).cast("decimal(12,2)").cast("string"), F.lit(" "), F.col("doc_id").cast("string"))
    value = F.when(turn == 0, "  ").when(turn == 1, F.col("seq")).when(turn == 2, F.concat("seq", F.lit(" x1"))).otherwise(fine)
    return docs.select(F.col("source").alias("file"), value.alias("value"), F.struct("doc_id", "j").alias("line"))


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def kmer_tokens(spark, sf_dir):
    return kmers(sequences(spark, sf_dir))


def kmer_token_ids(spark, sf_dir):
    return kmers(sequences(spark, sf_dir, "ACGTN")).select("doc_id", "pos", token_id(F.col("kmer")).alias("token_id"))


def kmer_token_ids_cls(spark, sf_dir):
    ids = kmers(sequences(spark, sf_dir, "ACGTN")).select("doc_id", (F.col("pos") + 1).alias("pos"), token_id(F.col("kmer")).alias("token_id"))
    return ids.union(sequences(spark, sf_dir).select("doc_id", F.lit(0), F.lit(1)))


def kmer_vocab(spark, sf_dir):
    """The vocabulary, with how often each token occurs in documents."""
    counts = normalization.kmer_counts(sequences(spark, sf_dir)).withColumnRenamed("kmer", "token")
    return vocabulary_frame(spark).join(counts, "token", "left").select("token", "token_id", F.coalesce("n", F.lit(0)).alias("n"))


def kmer_counts_topk(spark, sf_dir):
    return normalization.kmer_counts(sequences(spark, sf_dir)).orderBy(F.desc("n"), "kmer").limit(TOP)


def _occurring(spark, sf_dir):
    """(width, word, seen): how often each pair and triple of bases occurs in documents; 80 rows at most."""
    seqs = sequences(spark, sf_dir)
    parts = [normalization.kmer_counts(seqs, k).select(F.lit(k).alias("width"), F.col("kmer").alias("word"), F.col("n").alias("seen")) for k in (2, 3)]
    return F.broadcast(parts[0].unionByName(parts[1]))


def flex_lookup_profile(spark, sf_dir):
    """Of each feature its words, their values, and the mean of its values over the words that occur in documents."""
    rows = lookup_frame(spark).join(_occurring(spark, sf_dir), ["width", "word"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    mean = F.try_divide(F.sum(F.col("value") * F.col("seen")), F.sum("seen"))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("seen").alias("seen"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(mean, 6).alias("mean_seen"))


def _told_targets(rows: DataFrame) -> DataFrame:
    """Of each document its tokens, their ids added up, and each feature's mean, plain and weighted by place from 1."""
    place = F.col("pos") + 1
    values = [F.get("flex", F.lit(i)) for i in range(len(feature_names()))]
    plain = [(F.round(F.avg(v) + NUDGE, 4) + 0.0).alias(n) for n, v in zip(feature_names(), values, strict=True)]
    weighted = [(F.round(F.sum(v * place) / F.sum(place) + NUDGE, 4) + 0.0).alias(f"{n}_by_place") for n, v in zip(feature_names(), values, strict=True)]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_id").cast("long").alias("ids"), *plain, *weighted)


def flex_token_targets(spark, sf_dir):
    return _told_targets(token_targets(sequences(spark, sf_dir)))


def flex_token_targets_lenient(spark, sf_dir):
    return _told_targets(token_targets(sequences(spark, sf_dir, "ACGTN"), strict=False))


def flex_track_profile(spark, sf_dir):
    return track_profile(windows(spark, sf_dir)).select("feature", "pos", "place", "n", (F.round(F.col("mean") + NUDGE, 6) + 0.0).alias("mean"))


def flex_norm_stats(spark, sf_dir):
    return normalization.flexibility_stats(sequences(spark, sf_dir)).select("feature", "n_tokens", *rounded("mean", "std"))


def _per_document(spark, sf_dir, **parts):
    """A row for each document, with what each of parts makes of every feature's token values, as columns part_i."""
    made = [make(F.get("flex", F.lit(i))).alias(f"{name}_{i}") for i in range(len(feature_names())) for name, make in parts.items()]
    return token_targets(sequences(spark, sf_dir)).groupBy("doc_id").agg(*made)


def flex_normalized_global(spark, sf_dir):
    stats = normalization.flexibility_stats(sequences(spark, sf_dir)).select("feature", "mean", "std")
    rows = per_feature(_per_document(spark, sf_dir, own=F.avg), "doc_id", ["own"])
    return rows.join(F.broadcast(stats), "feature").select("doc_id", "feature", (F.round((F.col("own") - F.col("mean")) / F.col("std"), 6) + 0.0).alias("z"))


def flex_normalized_tokens(spark, sf_dir):
    """Every token's values, scaled by the statistics of all; of each document the sums, plain and by position."""
    stats = {r["feature"]: r for r in normalization.flexibility_stats(sequences(spark, sf_dir)).collect()}  # twelve rows
    scaled = normalization.normalized(F.col("flex"), *([stats[n][k] for n in feature_names()] for k in ("mean", "std")))
    rows = token_targets(sequences(spark, sf_dir)).withColumn("z", scaled)
    parts = [(F.round(F.avg(F.get("z", F.lit(i)) * w) + NUDGE, 4) + 0.0).alias(f"{n}_{i}") for i in range(len(feature_names())) for n, w in (("z", F.lit(1)), ("z_by_place", F.col("pos") % 7))]
    return per_feature(rows.groupBy("doc_id").agg(*parts), "doc_id", ["z", "z_by_place"])


def flex_zscore_per_seq(spark, sf_dir):
    place = F.col("pos") + 1
    parts = {"mean": F.avg, "s": F.stddev_pop, "low": F.min, "high": F.max, "first": lambda v: F.min_by(v, "pos"), "by_place": lambda v: F.sum(v * place) / F.sum(place)}
    own = per_feature(_per_document(spark, sf_dir, **parts), "doc_id", list(parts))
    std = F.when(F.round("s", 9) == 0, 1.0).otherwise(F.col("s"))
    z = [(F.round((F.col(c) - F.col("mean")) / std, 5) + 0.0).alias(f"z_{c}") for c in ("low", "high", "first")]
    return own.select("doc_id", "feature", *z, (F.round((F.col("by_place") - F.col("mean")) / std + NUDGE, 4) + 0.0).alias("z_by_place"))


def onehot_profile(spark, sf_dir):
    """How often each place of the tokens' one-hots is taken, from counts of distinct tokens."""
    counts = normalization.kmer_counts(sequences(spark, sf_dir, "ACGTN"))
    rows = counts.select("n", F.posexplode(one_hot(F.col("kmer"))).alias("place", "hot"))
    return rows.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("hot") * F.col("n")).cast("long").alias("hits"))


def _positional(n):
    def run(spark, sf_dir):
        return positional_counts(windows(spark, sf_dir), n)

    return run


def valid_acgt_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.upper("text"), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("word").rlike("^[ACGT]*$")).alias("n_valid"))


def scan_rejects(spark, sf_dir):
    told = judged_pairs(scored_lines(spark, sf_dir).drop("line"))
    return told.groupBy("file", F.coalesce("reason", F.lit("row")).alias("reason")).agg(F.count("*").alias("n"))


def dominant_length(spark, sf_dir):
    return splits.dominant_length(lenient_pairs(scored_lines(spark, sf_dir)), "file", "seq", "line")


def dominant_rows(spark, sf_dir):
    rows = splits.of_dominant_length(lenient_pairs(scored_lines(spark, sf_dir)), "file", "seq", "line")
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("length"), F.sum(F.col("line.doc_id") * 100_000 + F.col("line.j")).alias("lines"), F.round(F.avg("score"), 4).alias("score"))


def file_summaries(spark, sf_dir):
    return file_profile(scored_lines(spark, sf_dir).drop("line"))


def min_rows_files(spark, sf_dir):
    return splits.large_groups(lenient_pairs(scored_lines(spark, sf_dir).drop("line")), "file", 10, 2, 20)


def genome_windows_sampled(spark, sf_dir):
    chunks = sequences(spark, sf_dir, "ACGTN").select(F.col("doc_id").cast("string").alias("chrom"), F.lit(0).cast("long").alias("start"), "seq")
    return splits.sampled_windows(chunks.where(F.length("seq") > 0), 1000, WINDOW)


def split_train_val_test(spark, sf_dir):
    return splits.split_by_share(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def split_bankers(spark, sf_dir):
    return splits.split_by_share(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 0.7, 0.15, "bankers")


def kfold_assign(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)


def kfold_within(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 5, 43, "source")


def nested_subsets(spark, sf_dir):
    return splits.nested_subsets(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [1, 5, 10, 25, 50, 100])


def row_cap(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 10, "source")


def independent_subsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return metrics.labelled_union({str(n): splits.subset(docs, "doc_id", n, 1042) for n in (50, 100, 10**9)}, "size")


def _masks(spark, sf_dir, seed):
    seqs = sequences(spark, sf_dir).withColumn("forced", splits.forced_position("doc_id", F.length("seq") - 5, seed=seed))
    masked = splits.masked("doc_id", "forced", seed=seed)
    return kmers(seqs).select("doc_id", "pos", masked.alias("masked"), F.when(masked, token_id(F.col("kmer"))).alias("label"))


def mlm_mask(spark, sf_dir):
    return _masks(spark, sf_dir, 42)


def eval_mask(spark, sf_dir):
    """Masks of an evaluation, which are the same each time."""
    return _masks(spark, sf_dir, 12345).groupBy("doc_id").agg(F.count_if("masked").alias("n"), F.sum("label").alias("labels"), F.sum(F.when(F.col("masked"), F.col("pos"))).alias("places"))


def fixed_mask(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", splits.fixed_position(F.length("seq") - 5).alias("pos"))


def masked_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3).alias("mask"), F.col("embedding").cast("array<double>").alias("x"))
    return pooled(rows, "x", "mask", ["label"]).select("label", "place", *rounded("mean", "max"))


def _scaled(drop):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.array(F.lit(1.0)), F.col("embedding").cast("array<double>")).alias("x"))
        train = unit(42, "vec_id") < 0.8
        out = normalization.standardized(rows, "x", train, first=0, drop=drop)
        return out.select("vec_id", F.posexplode("x").alias("place", "value")).select("vec_id", "place", (F.round("value", 5) + 0.0).alias("value"))

    return run


def _predicted(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


def metrics_by_group(spark, sf_dir):
    out = _predicted(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), metrics.r2("y", "p").alias("r2"), metrics.pearson("y", "p").alias("pearson"), metrics.pearson_added("y", "p").alias("pearson_added"), metrics.rmse("y", "p").alias("rmse"), metrics.r2("y", "p", "add").alias("r2_add"))
    return out.select("l_returnflag", "n", *rounded("r2", "r2_add", "pearson", "pearson_added"), F.round("rmse", 3).alias("rmse"))


def metrics_zero_variance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.lit(2.0).alias("y"), F.lit(3.0).alias("p"), F.lit(2.0).alias("same"))
    r2 = [metrics.r2("y", p, policy).alias(f"r2_{policy}_{p}") for p in ("p", "same") for policy in ("null", "exact")]
    return rows.groupBy("event_type").agg(*r2, metrics.pearson("y", "p").alias("pearson"), metrics.pearson("y", "p", None).alias("pearson_null"), metrics.rmse("y", "p").alias("rmse"))


def affine_calibration(spark, sf_dir):
    slope, intercept = metrics.calibration("y", "p")
    flat, through = metrics.calibration("y", "one", True)
    out = _predicted(spark, sf_dir).withColumn("one", F.lit(1.0)).groupBy("l_linestatus").agg(slope.alias("slope"), intercept.alias("intercept"), flat.alias("flat_slope"), through.alias("flat_intercept"))
    return out.select("l_linestatus", *rounded("slope", "flat_slope"), *rounded("intercept", "flat_intercept", digits=3))


def calibrated_test(spark, sf_dir):
    """A line fitted on validation rows of each status, applied to test rows."""
    rows = _split_rows(spark, sf_dir).select("l_returnflag", "split", F.get("features", F.lit(0)).alias("p"), "y")
    told = metrics.calibrated(rows, ["l_returnflag"], "y", "p", F.col("split") == "val").where("split = 'test'")
    out = told.groupBy("l_returnflag").agg(F.count("*").alias("n"), metrics.r2("y", "calibrated").alias("r2"), metrics.rmse("y", "calibrated").alias("rmse"))
    return out.select("l_returnflag", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"))


def scatter_fit_line(spark, sf_dir):
    return _predicted(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.regr_slope("p", "y"), 6).alias("slope"), F.round(F.regr_intercept("p", "y"), 3).alias("intercept"))


def _split_rows(spark, sf_dir, scale=1.0):
    id_ = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", id_, F.array(F.col("l_quantity") * scale).alias("features"), F.col("l_extendedprice").alias("y"))
    rows = splits.folds(rows, "id", 10, 42, ties=("l_returnflag", "features", "y"))  # a few ids occur twice
    split = F.when(F.col("fold") < 8, "train").when(F.col("fold") == 8, "val").otherwise("test")
    return rows.withColumn("split", split)


def ridge_1d_alpha_sweep(spark, sf_dir):
    sums = ridge.gram_sums(_split_rows(spark, sf_dir), ["l_returnflag", "split"])
    alphas = (0.1, 100.0, 10000.0, 1000000.0)

    def fit(cells):
        fits = [ridge.solve(cells["train"], a) for a in alphas]
        return {f"{k}_{i}": v for i, f in enumerate(fits) for k, v in (("slope", float(f.weights[0])), ("r2", ridge.scores(cells["val"], f)["r2"]))}

    names = [f"{k}_{i}" for i in range(len(alphas)) for k in ("slope", "r2")]
    out = ridge.solved(sums, ["l_returnflag"], ["split"], fit, ", ".join(f"{n} double" for n in names))
    return out.select("l_returnflag", *(F.round(n, 6 if n[0] == "r" else 3).alias(n) for n in names), "status")


def ridge_val_select(spark, sf_dir):
    sums = ridge.gram_sums(_split_rows(spark, sf_dir, 0.001), ["l_returnflag", "split"])
    out = ridge.solved(sums, ["l_returnflag"], ["split"], ridge.validated, ridge.VALIDATED)
    return out.select("l_returnflag", "alpha", *rounded("val_r2", "test_r2", "test_pearson"), F.round("test_rmse", 3).alias("test_rmse"), "status")


def ridge_iterative_select(spark, sf_dir):
    """ridge_val_select without a matrix of features: all penalties of all groups from Krylov spaces."""
    out = krylov.validated(_split_rows(spark, sf_dir, 0.001), ["l_returnflag"], 1)
    return out.select("l_returnflag", "alpha", *rounded("val_r2", "test_r2", "test_pearson"), F.round("test_rmse", 3).alias("test_rmse"), "status")


#: Letters of wide windows, whose 3-letter words have 6,336 places.
WIDE = 101


def ridge_iterative_3mer(spark, sf_dir):
    """Windows of 101 letters by their words of three at each place, against their share of C and G: 6,336 features, matrix-free."""
    made = _scored_windows(spark, sf_dir, WIDE).drop("source").persist(StorageLevel.DISK_ONLY)
    rows = splits.split_by_share(made, "id").persist(StorageLevel.DISK_ONLY)
    out = krylov.validated(placed(rows.select("seq", "split", "y"), 3, WIDE, "features"), [], (WIDE - 2) * 64, tolerance=1e-4, most_rounds=300)
    rows.unpersist()
    made.unpersist()
    return out


def onehot_cooccurrence(spark, sf_dir):
    """In how many windows two letters at their places occur together."""
    return sparse_gram.cooccurrence(windows(spark, sf_dir).select(positional_places(F.col("seq"), 1).alias("places")), [])


def nested_cv_sparse(spark, sf_dir):
    """Nested folds of each source's windows by letters, and pairs of letters, at each place, from counts in coordinates."""
    plain = _scored_windows(spark, sf_dir).withColumnRenamed("source", "file")
    rows = splits.inner_folds(plain, "id", 5, 3, 42, "file").persist(StorageLevel.DISK_ONLY)
    counted = plain.groupBy("file").agg(F.count("*").alias("n")).persist()  # a row a file
    out = []
    for n in (1, 2):
        found = sparse_gram.nested_folds(rows.withColumn("places", positional_places(F.col("seq"), n)), ["file"], "outer", "inner", (WINDOW - n + 1) * 4**n, counted=counted)
        out.append(found.withColumn("kind", F.lit(f"{n}mer")))
    return reduce(DataFrame.unionByName, out)


def _vectors(spark, sf_dir, size=None):
    """Embeddings as features of their label; of the first so many numbers, if size is given."""
    x = F.col("embedding") if size is None else F.slice("embedding", 1, size)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit("label").alias("target"), x.cast("array<double>").alias("features"), F.col("label").cast("double").alias("y"))


def _nested(spark, sf_dir, size, width):
    rows = splits.inner_folds(_vectors(spark, sf_dir, size), "vec_id", 10, 5)
    out = ridge.nested_folds(rows, ["target"], "outer", "inner", width)
    return out.select("target", "n", "alpha", *rounded("r2", "pearson", "rmse"), "status")


def nested_cv_ridge(spark, sf_dir):
    return _nested(spark, sf_dir, None, 64)


def nested_cv_ridge_1d(spark, sf_dir):
    return _nested(spark, sf_dir, 1, 1)


def _left_out(spark, sf_dir, size):
    rows = _vectors(spark, sf_dir, size)
    gram = ridge.matrix(ridge.gram_sums(rows, []).toPandas())
    return ridge.leave_one_out(rows, gram).select("alpha", *rounded("mean_square"))


def ridge_loo(spark, sf_dir):
    return _left_out(spark, sf_dir, None)


def ridge_loo_1d(spark, sf_dir):
    return _left_out(spark, sf_dir, 1)


def _scored_windows(spark, sf_dir, width=WINDOW):
    return windows(spark, sf_dir, width).select("source", F.concat_ws("-", "doc_id", "j").alias("id"), "seq", (gc_share(F.col("seq")) + unit(5, "doc_id", "j") * 0.05).alias("y"))


#: Kinds of words by position, by their letters: a few ones among many places.
PLACED = {"1mer": 1, "2mer": 2, "3mer": 3}


def _kinds(rows):
    """Feature tables of rows by kind, with their widths: words by position (as places), tracks, and an untrained encoder's states,
    which are made once for both kinds of them and kept on disk."""
    out = {kind: (placed(rows, n, WINDOW), (WINDOW - n + 1) * 4**n) for kind, n in PLACED.items()}
    out |= {kind: (feature_matrix(rows, kind, WINDOW), width) for kind, width in (("1mer_flex", 282), ("1mer12flex", 560))}
    shape = encoder.Shape()
    states = encoder.encoded(encoder.alike(rows), encoder.random_weights(10042, shape), shape, "hidden_flex").persist(StorageLevel.DISK_ONLY)
    hidden = states.withColumn("features", F.slice("features", 1, shape.width))
    return out | {"hidden": (hidden, shape.width), "hidden_flex": (states, shape.width + shape.targets)}


def _placed_folds(rows, kind, width):
    """Nested folds of each file's words by position: of few rows from the rows, of many by counts of places."""
    small, large = ridge._by_size(rows, ["file"], width, rows)
    few = ridge.nested_folds(feature_matrix(small, kind, WINDOW), ["file"], "outer", "inner", width, counted=small)
    if large is None:
        return few
    listed = placed(large, PLACED[kind], WINDOW)
    return few.unionByName(sparse_gram.nested_folds(listed, ["file"], "outer", "inner", width, counted=large.groupBy("file").agg(F.count("*").alias("n"))))


def benchmark_by_file(spark, sf_dir):
    """Each source a file: nested folds of windows against their share of C and G, for each kind of features over all letters."""
    plain = _scored_windows(spark, sf_dir).withColumnRenamed("source", "file")
    # A task has rows of one file, or of two that follow each other, so that it makes sums of few cells.
    slots = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = splits.inner_folds(plain, "id", 5, 3, 42, "file").repartitionByRange(slots, "file", F.xxhash64("id")).persist(StorageLevel.DISK_ONLY)
    out = []
    for kind, (table_, width) in _kinds(rows).items():
        if kind in PLACED:
            found = _placed_folds(rows, kind, width)
        else:
            found = ridge.nested_folds(table_, ["file"], "outer", "inner", width, scale=kind.startswith("hidden"), counted=rows)
        out.append(found.withColumns({"kind": F.lit(kind), "family": file_family(F.col("file")), "factor": file_factor(F.col("file")), "seq_len": F.lit(WINDOW)}))
    return reduce(DataFrame.unionByName, out)


def sample_efficiency(spark, sf_dir):
    """Nested shares of training rows by feature kind: penalty by validation, no refit, scores on test."""
    percents = [0.3, 1, 3, 10, 30, 100]
    marked = splits.split_by_share(_scored_windows(spark, sf_dir), "id").persist(StorageLevel.DISK_ONLY)
    train = splits.subset_bands(marked.where("split = 'train'"), "id", percents)
    every = train.unionByName(marked.where("split <> 'train'").withColumn("band", F.lit(-1))).persist(StorageLevel.DISK_ONLY)
    counted = every.agg(F.count("*").alias("n")).persist()
    fit, schema = lambda cells: ridge.subset_scores(cells, percents), f"percent double, n_train long, {ridge.VALIDATED}"
    out = []
    for kind, (table_, width) in _kinds(every).items():
        rows = table_.withColumn("model", F.lit(kind))
        if kind in PLACED:
            out.append(sparse_gram.solved(rows, ["model"], ["split", "band"], width, fit, schema, counted=counted))
        else:
            out.append(ridge.fitted(rows, ["model"], ["split", "band"], fit, schema, width, counted=every.withColumn("model", F.lit(kind))))
    return reduce(DataFrame.unionByName, out)


def checkpoint_scores(spark, sf_dir):
    """Two checkpoints of the encoder, an untrained one and one trained on masked words of all windows, loaded from their
    stores, and compared by a head on its mean states and targets."""
    rows = _scored_windows(spark, sf_dir).persist(StorageLevel.DISK_ONLY)
    split = F.when(unit(3, "id") < 0.9, "train").otherwise("val")
    start, stores = encoder.random_weights(10042), {name: Store(spark, shared_path(spark)) for name in ("random", "trained")}
    tuned = finetune.pretrained(rows.select(F.xxhash64("id").alias("key"), "seq", split.alias("split")), start, epochs=1, batches=2, precision=np.float32)
    for name, weights in (("random", start), ("trained", tuned.weights)):
        stores[name].save(0, weights, tuned.scores)
    loaded = {name: encoder.fitting(store.load()[1]) for name, store in stores.items()}
    out = encoder.compared(rows, loaded, pool="mean", tolerance=1e-6)
    rows.unpersist()
    return out


#: Epochs of training a head and the last layer, all of which are run, as where this was first done.
EPOCHS = 30


def unfrozen_layer_scores(spark, sf_dir):
    """A head on the mean targets of an untrained encoder over windows, with the encoder frozen, and with its last layer trained too."""
    rows = splits.split_by_share(_scored_windows(spark, sf_dir), "id").withColumn("key", F.xxhash64("id")).persist(StorageLevel.DISK_ONLY)
    out = []
    for name, rate in (("frozen", 0.0), ("last layer", 1e-4)):
        scores = finetune.fine_tuned(rows, encoder.random_weights(10042), encoder_rate=rate, rate=3e-3, epochs=EPOCHS, patience=EPOCHS, precision=np.float32).scores
        out.append((name, *(scores[k] for k in ("n", "val_r2", "test_r2", "epochs"))))
    rows.unpersist()
    return spark.createDataFrame(out, "encoder string, n long, val_r2 double, test_r2 double, epochs int")


def _results(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seed", F.col("l_orderkey") % 3)
    return rows.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("pct"), "seed").agg(F.round(F.avg("l_discount"), 9).alias("test_r2"))


def summary_by_model(spark, sf_dir):
    return metrics.summary(_results(spark, sf_dir), ["model", "pct"], "test_r2", fill=0.0).select("model", "pct", "n", *rounded("mean", "median", "std", "min", "max"))


#: Values of a group that a task sorts in summary_of_one_group, so few that ranks are narrowed at any size.
FEW = 1000


def summary_of_one_group(spark, sf_dir):
    """All rows in one group, whose median no task sorts."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit("all").alias("key"), "l_extendedprice")
    return metrics.summary(rows, ["key"], "l_extendedprice", most=FEW).select("key", "n", *rounded("mean", "median", "std", "min", "max", digits=2))


def first_physical_lines(spark, sf_dir):
    """Windows written as lines of several files, of which the first 5,000 are read, in their order."""
    path = shared_path(spark)
    windows(spark, sf_dir).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "j").select("seq").write.text(path)
    return one_per_line(numbered_lines(spark, path, 5000)).select("line", "seq")


def fasta_records(spark, sf_dir):
    """Documents' letters written as FASTA records of lines of 60, indexed, and read in rows by the data source."""
    path, index = shared_path(spark), shared_path(spark)
    lines = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), "\n")
    sequences(spark, sf_dir, "ACGTN").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" letters\n"), lines)).write.text(path)
    fasta_index(spark, path, index)
    rows = read_fasta(spark, path, index, row_letters=1000)
    return rows.groupBy("chrom").agg(F.count("*").alias("n_rows"), F.sum(F.length("seq")).alias("n"), F.sum(F.length("seq") - F.length(F.translate("seq", "GC", ""))).alias("gc"))


def stateful_windows(spark, sf_dir):
    """events as a stream in two parts, the second after a restart: each window of a day once the watermark has closed it."""
    path, out, checkpoint = (shared_path(spark) for _ in range(3))
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    middle = F.lit(rows.agg(F.percentile_approx(F.unix_millis(F.col("ts").cast("timestamp")), 0.5)).first()[0])
    earlier = F.unix_millis(F.col("ts").cast("timestamp")) <= middle
    for part in (rows.where(earlier | earlier.isNull()), rows.where(~earlier)):
        part.write.mode("append").parquet(path)
        run_stateful(spark.readStream.schema(rows.schema).parquet(path), out, checkpoint)
    return spark.read.parquet(out).select("starts", "event_type", "n", *rounded("mean", "std"))


def sql_kmers(spark, sf_dir):
    """Of each document its 4-letter words, by the SQL functions alone. Which of the 625 words of five letters occur are bits of
    ten numbers, so a document is one row of sums of fixed size, in a task and in the shuffle."""
    sql.register(spark)
    documents(spark, sf_dir, "doc_id", "text").createOrReplaceTempView("motifold_documents")
    distinct = " + ".join(f"bit_count(bit_or(if(code DIV 64 = {i}, shiftleft(1L, code % 64), 0L)))" for i in range(10))
    return spark.sql(f"""SELECT doc_id, count(*) AS n, CAST({distinct} AS BIGINT) AS n_distinct, sum(motifold_token_id(kmer, 4)) AS ids, round(avg(motifold_gc_share(kmer)), 6) AS gc,
      count_if(kmer = motifold_reverse_complement(kmer)) AS palindromes, max(pos) AS last
      FROM (SELECT doc_id, pos, kmer, CAST(conv(translate(kmer, 'ACGTN', '01234'), 5, 10) AS INT) AS code
        FROM (SELECT doc_id, motifold_kmers(start, letters, 4) AS words
          FROM (SELECT doc_id, motifold_chunks(motifold_only_bases(text, 'ACGTN'), 4) AS chunks FROM motifold_documents) LATERAL VIEW inline(chunks) c)
        LATERAL VIEW inline(words) t) GROUP BY doc_id""")


def summary_population(spark, sf_dir):
    return metrics.summary(_results(spark, sf_dir), ["model"], "test_r2", sample=False).select("model", "n", *rounded("mean", "std"))


def summary_ordered(spark, sf_dir):
    found = metrics.in_order(metrics.summary(_results(spark, sf_dir), ["model"], "test_r2"), "model", ["R", "missing", "A", "N"])
    return found.select("turn", "model", "n", *rounded("mean", "median", "std", "min", "max"))


def best_alpha_first(spark, sf_dir):
    return metrics.best_choice(_results(spark, sf_dir).withColumn("score", F.round("test_r2", 3)).select("model", "seed", "pct", "score"), ["model", "seed"], "score", "pct")


def union_labelled(spark, sf_dir):
    parts = {name: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key")) for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"))}
    return metrics.labelled_union(parts, "part").groupBy("part").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


def resume_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    done = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "NaN").otherwise("0.5").alias("r2"))
    return metrics.unfinished(docs.select("doc_id"), done, "doc_id", "r2")


def resumed_results(spark, sf_dir):
    """Results of which a third is there, half of that incomplete: the rest is worked out, what is complete stays."""
    docs = table(spark, sf_dir, "documents")
    done = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "NaN").otherwise("kept").alias("r2"))
    return metrics.resumed(docs.select("doc_id"), done, "doc_id", "r2", lambda left: left.withColumn("r2", F.lit("made")))


def append_metric_leftjoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    return metrics.with_metric(counts, docs.where("lang = 'fr'").groupBy("source").agg(F.max("n_chars").alias("metric")), "source")


def grid_crossjoin(spark, sf_dir):
    seeds, percents = spark.createDataFrame([(0,), (1,), (2,)], "seed int"), spark.createDataFrame([(5,), (30,), (100,)], "pct int")
    return metrics.grid(table(spark, sf_dir, "region").select("r_name"), seeds, percents)


def parse_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_x.txt")).alias("file")).union(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(".txt"))))
    return names.groupBy("file").agg(F.count("*").alias("n")).select("file", file_family(F.col("file")).alias("family"), file_factor(F.col("file")).alias("factor"), "n")


def families(spark, sf_dir):
    return sorted_families(table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("file")))


def told_numbers(spark, sf_dir):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", told_number(x).alias("told"))


def kmer_gc_profile(spark, sf_dir):
    rows = kmer_gc(sequences(spark, sf_dir)).groupBy("doc_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("gc"), 6).alias("mean"), F.round(F.sum(F.col("gc") * F.col("pos")), 4).alias("by_place"))


def most_tokens(spark, sf_dir):
    return longest_tokens(sequences(spark, sf_dir))


def lookup_file_order(spark, sf_dir):
    """The tables as a parsed file has them, triples first, and in a config's order, over the words of documents."""
    groups = {f"{n}nucleotide": {f.name: f.values for f in features() if f.width == w} for n, w in (("tri", 3), ("di", 2))}
    config = {"dinucleotide": ["twistDisp", "wedge"], "trinucleotide": ["NPP"]}
    rows = {"file": features_from(groups, in_file_order=True), "config": features_from(groups, config), "plain": features_from(groups)}
    listed = metrics.labelled_union({name: lookup_frame(spark, used) for name, used in rows.items()}, "order")
    met = listed.join(_occurring(spark, sf_dir), ["width", "word"])
    return met.groupBy("order", "feature_index", "feature", "width").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("seen")), 3).alias("total_seen"))


def gc_by_document(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(gc_share(F.col("seq")), 6).alias("gc"))


def losses(spark, sf_dir):
    left = F.col("value") - 1.5
    mask = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.round(metrics.masked_loss(metrics.huber(left), mask), 6).alias("huber"), F.round(metrics.masked_loss(left**2, mask), 6).alias("mse"), F.round(metrics.masked_loss(left**2, F.lit(0)), 6).alias("none"))


def weighted_losses(spark, sf_dir):
    """Two objectives by their weights, and one of weight 0 that has no value."""
    left, mask = F.col("value") - 1.5, F.col("event_id") % 4
    parts = {"flex": (0.7, metrics.masked_loss(metrics.huber(left), mask)), "bend": (0.2, F.avg(left**2)), "mlm": (0.0, F.lit(float("nan")))}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.weighted_total(parts), 6).alias("total"))


def mean_results(spark, sf_dir):
    """Means over seeds, of raw results and of ones that come with their means."""
    raw = _results(spark, sf_dir)
    means = metrics.mean_over(raw, ["model", "pct"], "test_r2", "mean_r2")
    both = {"raw": means, "aggregated": metrics.mean_over(means.withColumnRenamed("mean_r2", "test_r2_mean"), ["model", "pct"], "test_r2", "mean_r2")}
    return metrics.labelled_union(both, "given").select("given", "model", "pct", *rounded("mean_r2"))


def token_cross_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("vec_id") % 6 == 0, F.col("label")).alias("told"))
    return rows.groupBy("label").agg(F.round(F.avg(metrics.cross_entropy(F.col("x"), F.col("told"))), 6).alias("loss"))


def encode_hidden_flex(spark, sf_dir):
    rows = encoder.encoded(encoder.alike(windows(spark, sf_dir).drop("source")), encoder.random_weights(10042), kind="hidden_flex")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    by_place = total(F.transform("features", lambda x, i: x * (i + 1)))
    return rows.select("doc_id", "j", F.size("features").alias("width"), F.round(F.get("features", F.lit(0)), 4).alias("first"), F.round(total("features"), 3).alias("total"), F.round(by_place, 2).alias("by_place"))


#: An encoder of two states, whose weights are told by a rule, so that SQL can follow it.
TINY = encoder.Shape(width=2, heads=1, layers=1, hidden=2, positions=64, tokens=4, targets=2)


def ruled_weights(shape: encoder.Shape = TINY) -> encoder.Weights:
    """Tenths from -0.5 to 0.5 by the number of the weight and the place in it; norms have weight 1 and bias 0."""
    out = {}
    for k, (name, size) in enumerate(encoder.expected(shape).items()):
        rule = ((np.arange(np.prod(size)) * 7 + k * 3) % 11 - 5) / 10
        out[name] = np.full(size, float(name.endswith("weight"))) if ".norm" in name else rule.reshape(size)
    return out


def encode_attention(spark, sf_dir):
    rows = encoder.encoded(windows(spark, sf_dir).drop("source"), ruled_weights(), TINY, "hidden_flex", precision=np.float64)
    return rows.select("doc_id", "j", *((F.round(F.get("features", F.lit(i)) + NUDGE, 5) + 0.0).alias(f"f{i}") for i in range(4)))


#: The tiny encoder over pairs of letters, whose vocabulary is of 20 tokens.
PAIRS = TINY._replace(k=2, tokens=20)


def masked_token_loss(spark, sf_dir):
    """Cross-entropy of the tokens that a tiny ruled encoder doesn't see, by window."""
    rows = windows(spark, sf_dir).select(F.concat_ws("-", "doc_id", "j").alias("id"), "seq")
    return encoder.token_losses(rows, ruled_weights(PAIRS), PAIRS).select("id", F.coalesce("n_masked", F.lit(0)).alias("n_masked"), F.round(F.col("loss") + NUDGE, 5).alias("loss"))


def collated_batches(spark, sf_dir):
    """Documents' words of six letters, with labels where a draw masks them, in padded batches of like length."""
    seqs = sequences(spark, sf_dir, "ACGTN").withColumn("size", F.length("seq") - 5).where("size > 0")
    # Letters are put into batches, and words are listed there, so that ranks and their shuffles carry a letter a token.
    placed = collate.length_batches(seqs, "size", "doc_id")
    hidden = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: unit(12345, "doc_id", i) < 0.15)
    rows = placed.select("doc_id", "size", "bucket", "batch", kmer_list(F.col("seq"), 6, token_id).alias("ids"), hidden.alias("hidden"))
    rows = rows.select("doc_id", "size", "bucket", "batch", "ids", F.zip_with("ids", "hidden", lambda x, h: F.when(h, x).otherwise(-100)).alias("labels"))
    batches = collate.collated(rows, "size", "doc_id", {"ids": F.lit(0), "labels": F.lit(-100)})
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, b: a + b)
    cells = F.size(F.flatten("ids"))
    return batches.select("bucket", "batch", "n", "longest", total("mask").alias("tokens"), (cells - total("mask")).alias("padding"), total("ids").alias("ids"), total("labels").alias("labels"))


def pooled_head_eval(spark, sf_dir):
    """Heads on an encoder's states over a window, their greatest (two hidden layers and dropout) or their mean, and on its targets alone."""
    rows = splits.split_by_share(_scored_windows(spark, sf_dir), "id")
    shape = encoder.Shape()
    both = shape.width + shape.targets
    # One forward pass for all heads: means of states and targets, then their greatest.
    states = encoder.encoded(encoder.alike(rows), encoder.random_weights(10042, shape), shape, "hidden_flex", "mean_max").persist(StorageLevel.DISK_ONLY)
    parts = {"max_hidden": (both, shape.width, 0.2), "mean_hidden": (0, shape.width, 0.0), "max_flex": (both + shape.width, shape.targets, 0.0)}
    out = []
    for head, (first, size, dropout) in parts.items():
        features = states.withColumns({"features": F.slice("features", first + 1, size), "head": F.lit(head)})
        out.append(encoder.head_scores(features, ["head"], (128, 64), dropout=dropout, epochs=5, rate=3e-3))
    states.unpersist()
    return reduce(DataFrame.unionByName, out)


def linear_head_eval(spark, sf_dir):
    rows = splits.split_by_share(_vectors(spark, sf_dir), "vec_id")
    return encoder.head_scores(rows, ["target"]).select("target", "n", *rounded("val_r2", "test_r2", "test_rmse"), "status")


def hidden_head_eval(spark, sf_dir):
    rows = splits.split_by_share(_vectors(spark, sf_dir), "vec_id")
    return encoder.head_scores(rows, ["target"], (64,), rate=1e-2, epochs=15)


def running_stats_windows(spark, sf_dir):
    return windowed_stats(table(spark, sf_dir, "events")).select("starts", "event_type", "n", *rounded("mean", "std"))


def merged_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    parts = [batch_moments(rows.where(f"event_id % 3 = {i}"), "event_type", "value") for i in range(3)]
    merged = normalization.merged_moments(parts[0].union(parts[1]).union(parts[2]), "event_type")
    return merged.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 6).alias("std"))


NAMED = [
    kmer_tokens, kmer_token_ids, kmer_token_ids_cls, kmer_vocab, kmer_counts_topk, flex_lookup_profile, lookup_file_order, flex_token_targets, flex_token_targets_lenient, flex_track_profile,
    flex_norm_stats, flex_normalized_global, flex_normalized_tokens, flex_zscore_per_seq, onehot_profile, valid_acgt_words, scan_rejects, dominant_length, dominant_rows, file_summaries,
    min_rows_files, genome_windows_sampled, split_train_val_test, split_bankers, kfold_assign, kfold_within, nested_subsets, independent_subsets, row_cap, mlm_mask, eval_mask, fixed_mask,
    masked_pool, metrics_by_group, metrics_zero_variance, affine_calibration, calibrated_test, scatter_fit_line, ridge_1d_alpha_sweep, ridge_val_select, ridge_iterative_select, ridge_iterative_3mer, onehot_cooccurrence, nested_cv_sparse, nested_cv_ridge, nested_cv_ridge_1d,
    ridge_loo, ridge_loo_1d, benchmark_by_file, sample_efficiency, checkpoint_scores, unfrozen_layer_scores, summary_by_model, summary_population, summary_of_one_group, first_physical_lines, fasta_records, stateful_windows, sql_kmers, summary_ordered, mean_results, best_alpha_first, union_labelled,
    resume_antijoin, resumed_results, append_metric_leftjoin, grid_crossjoin, parse_names, families, told_numbers, gc_by_document, kmer_gc_profile, most_tokens, losses, weighted_losses,
    token_cross_entropy, encode_hidden_flex, encode_attention, masked_token_loss, collated_batches, pooled_head_eval, linear_head_eval, hidden_head_eval, running_stats_windows, merged_batches,
]
QUERIES = {f.__name__: f for f in NAMED}
QUERIES |= {f"positional_nmer_{n}": _positional(n) for n in (1, 2, 3)}
QUERIES |= {"standardize_train_apply": _scaled(False), "standardize_drop_zero_var": _scaled(True)}
