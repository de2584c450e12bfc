"""Batches of like length: sizes, padding, the same for any partitioning."""

from collections import defaultdict

from pyspark.sql import functions as F

from motifold.operators import collate


def batches_of(spark, lengths, parts=3, **limits):
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, size int").repartition(parts)
    return collate.length_batches(rows, "size", "id", **limits)


def test_buckets(spark):
    rows = spark.range(0, 5000).select(F.col("id").cast("int").alias("n")).withColumn("bucket", collate.length_bucket(F.col("n")))
    found = defaultdict(list)
    for r in rows.withColumn("most", collate.longest_of(F.col("bucket"))).collect():
        if r.n < 1:
            assert r.bucket is None
        else:
            found[r.bucket].append((r.n, r.most))
    for own in found.values():
        sizes = [n for n, _ in own]
        assert sizes == list(range(sizes[0], sizes[-1] + 1)) and 1 - sizes[0] / sizes[-1] < 1 / (collate.STEPS + 1)
        assert all(most == sizes[-1] for _, most in own) or sizes[-1] == 4999
    assert sorted(found) == sorted(found, key=lambda b: found[b][0])


def test_batches(spark):
    lengths = [7] * 700 + [i % 300 + 1 for i in range(1000)] + [5000, 0, None]
    found = batches_of(spark, lengths, most_tokens=1000).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.bucket, r.batch].append(r)
    assert sorted(r.id for r in found) == list(range(len(lengths)))
    assert sorted(r.id for r in groups.pop((None, None))) == [len(lengths) - 2, len(lengths) - 1]
    for own in groups.values():
        longest = max(r["size"] for r in own)
        assert len(own) * longest <= 1000 or len(own) == 1
        assert sum(longest - r["size"] for r in own) < len(own) * longest / (collate.STEPS + 1)
    # All but the last batch of a bucket are full.
    for bucket in {b for b, _ in groups}:
        sizes = [len(groups[bucket, k]) for k in range(sum(b == bucket for b, _ in groups))]
        assert sizes[:-1] == [max(sizes)] * (len(sizes) - 1)
    again = batches_of(spark, lengths, parts=1, most_tokens=1000).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    other = batches_of(spark, lengths, most_tokens=1000, seed=1).collect()
    assert sorted(map(tuple, found), key=repr) != sorted(map(tuple, other), key=repr)


def test_collated(spark):
    rows = spark.createDataFrame([(1, 3, [1, 2, 3]), (2, 2, [4, 5]), (3, 1, None), (4, 0, []), (5, 2, [6, 7])], "id long, size int, ids array<int>")
    found = collate.collated(collate.length_batches(rows, "size", "id"), "size", "id", {"ids": F.lit(-100)}).collect()
    told = {tuple(r.keys): r for r in found}
    assert sorted(told) == [(1,), (2, 5), (3,)]
    assert told[2, 5].ids == [[4, 5], [6, 7]] and told[2, 5].mask == [[1, 1], [1, 1]] and told[3,].ids == [[-100]]
    wide = spark.createDataFrame([(1, 17, [1] * 17), (2, 16, [2] * 16)], "id long, size int, ids array<int>")
    one = collate.collated(collate.length_batches(wide, "size", "id"), "size", "id", {"ids": F.lit(0)}).first()
    assert (one.n, one.longest, one.lengths) == (2, 17, [17, 16]) and one.ids == [[1] * 17, [2] * 16 + [0]] and one.mask[1] == [1] * 16 + [0]
    assert collate.collated(collate.length_batches(rows.where("id > 9"), "size", "id"), "size", "id", {}).count() == 0
