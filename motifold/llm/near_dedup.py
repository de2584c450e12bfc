"""Near duplicates by bottom-k sketches: inverted lists, union-sketch estimates, exact verification.

Every document becomes its set of distinct 64-bit shingle hashes; equal sets are one class, so exact copies never meet
as pairs. A class keeps its `sketch` smallest hashes (one hash function). Two sets with similarity of at least
`threshold` share at least `need` retained values but for a chance under `miss` (binomial tail), so it is enough to list
each class under its rarest `size - need + 1` retained values (the rest are the values that many documents share).

Lists are never expanded into all pairs. A class whose full set has too many shingles that no other listed class has
cannot be linked and leaves. Each class is tried against the one member of its lists that has least of its own, and
against one neighbour in lists that are range-partitioned by (value, set size, class). Links found so merge classes.
Last come the members of one list that are still in different components. Those whose size and own shingles allow no link
to the sizes in the list leave it; a very long list is split by a second retained value, as linked sets share several;
what still meets is dealt in blocks, and must allow the similarity by sizes, what only they hold, and counts of the rest by
part of the hash range (bounds that lose no link). All candidates pass the union-sketch estimate, then the exact similarity
of full sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motifold.llm.components import components
from motifold.llm.shared import spread_join, stored, tidied
from motifold.llm.textbatch import SPACED, mixed, pieces, ragged, words

SHINGLE_WORDS = 5
SKETCH = 64
MISS = 1e-9
#: Parts of the hash range in which shingles of a class are counted, as bits of words: those with one at least, those with two.
PARTS = 512
#: Members from which a list is split by a second value, and members of one block of those that meet.
LONG_LIST = 1 << 15
BLOCK = 4096
_MASKS = [f"m{i}" for i in range(2 * PARTS // 64)]

_PART_SHIFT = 64 - (PARTS - 1).bit_length()
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def least_shared(sketch: int, percent: int, miss: float) -> int:
    """So many values two sketches share at least if the sets reach the similarity, but for a chance under miss."""
    p, total = percent / 100, 0.0
    for x in range(sketch + 1):
        total += math.comb(sketch, x) * p**x * (1 - p) ** (sketch - x)
        if total > miss:
            return max(1, x)
    return sketch


def shingle_sets(column: pa.Array, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending, as signed 64-bit numbers."""
    for piece in pieces(column):
        found = words(piece, SPACED)
        h, rows = found.hashes, found.rows
        n = max(0, len(h) - width + 1)
        runs = np.zeros(n, np.uint64)
        for i in range(width):
            runs += h[i : i + n] * _STEPS[i % 5] + np.uint64(i)
            runs = mixed(runs) if i % 5 == 4 and i + 1 < width else runs
        runs = mixed(runs).view(np.int64)
        for first, last in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if last - first >= width:
                yield np.unique(runs[first : last - width + 1])
            elif last > first:
                whole = np.uint64(last - first)
                for x in h[first:last]:
                    whole = mixed(np.array([whole ^ x]))[0]
                yield np.array([whole], np.uint64).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _sketches(width: int, sketch: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            sizes, ones, twos, kept = [], [], [], []
            for each in shingle_sets(batch.column(1), width):
                sizes.append(len(each))
                spread = mixed(each.view(np.uint64) + np.uint64(1))
                ones.append(spread.sum(dtype=np.uint64))
                twos.append(np.bitwise_xor.reduce(mixed(spread)) if len(each) else np.uint64(0))
                kept.append(each[:sketch])
            lengths = np.array([len(x) for x in kept], np.int64)
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            numbers = [np.array(x, np.uint64).view(np.int64) for x in (ones, twos)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), ragged(values, lengths, pa.int64())], schema=schema)

    return run


def _full_sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            held, at = [], 0
            for each in shingle_sets(batch.column(1), width):
                held.append(each)
                at += 1
                if sum(map(len, held[-64:])) > 1 << 19 or len(held) >= 512:
                    yield _sets(batch.column(0).slice(at - len(held), len(held)), held, schema)
                    held = []
            if held:
                yield _sets(batch.column(0).slice(at - len(held), len(held)), held, schema)

    return run


def _sets(nodes: pa.Array, held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([nodes, ragged(np.concatenate(held), np.array([len(x) for x in held]), pa.int64())], schema=schema)


def _masks(batches):
    """(node, n, own, shingles, alone) to (node, n, own, masks of the shingles that aren't alone, those beyond two of a part)."""
    names = ["node", "n", "own", *_MASKS, "beyond"]
    for batch in batches:
        masks, beyond = np.zeros((batch.num_rows, 2, PARTS), bool), np.zeros(batch.num_rows, np.int64)
        for row in range(batch.num_rows):
            own = batch.column(4)[row].values
            every = batch.column(3)[row].values.to_numpy()
            common = every if own is None else np.setdiff1d(every, own.to_numpy(), assume_unique=True)
            counts = np.bincount((common >> _PART_SHIFT) + PARTS // 2, minlength=PARTS)
            masks[row] = counts >= 1, counts >= 2
            beyond[row] = np.maximum(counts - 2, 0).sum()
        packed = np.packbits(masks.reshape(batch.num_rows, -1), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(_MASKS))), pa.array(beyond)], names=names)


def _neighbours(percent: int):
    """Neighbours within a list, of rows (v, n, node) in order."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if last is not None:
                rows = [np.concatenate([[x], y]) for x, y in zip(last, rows, strict=True)]
            v, n, node = rows
            if len(v):
                last = [x[-1] for x in rows]
                near = (v[1:] == v[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (node[1:] != node[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(node[:-1][near]), pa.array(node[1:][near])], schema=schema)

    return run


def row_key() -> Column:
    """What tells rows (doc_id, text) apart: equal for equal rows only. A null text counts as empty."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = SHINGLE_WORDS, sketch: int = SKETCH, miss: float = MISS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), cut at white space into words, and become sets of `width`-word shingles; fewer words
    make one shingle; none (null, empty, blank) make an empty set that is linked with nothing, itself included. Documents
    are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id reachable; kept says that
    this is the row's own. Links are between texts: rows that repeat a doc_id share a component only if their texts do.
    Rows with a null doc_id are linked like others; a component of such rows alone has a null id, and kept holds for all of
    them. Other columns are ignored. An empty table gives no rows.
    """
    rows = near_duplicate_heads(docs, percent, width, sketch, miss)
    return rows.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("head.doc_id")).alias("kept"))


def near_duplicate_heads(docs: DataFrame, percent: int = 75, width: int = SHINGLE_WORDS, sketch: int = SKETCH, miss: float = MISS) -> DataFrame:
    """Per row of docs: doc_id, key (row_key), n_shingles, head; head (unnamed, doc_id, key) is the first row of the
    component by doc_id, nulls last, then by key."""
    need = least_shared(sketch, percent, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("key"))
    sets = stored(texts.mapInArrow(tidied(_sketches(width, sketch)), "doc_id long, key binary, n long, s1 long, s2 long, sketch array<long>"))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    classes = stored(sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(own).alias("lead")).withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select("node", F.col("lead.key").alias("key"))
    nodes = stored(sets.where("n > 0").select("key", "n", "sketch").dropDuplicates(["key"]).join(keys, "key").select("node", "n", "sketch"))
    listed = stored(_lists(nodes, percent, need))
    full = texts.select("key", "text").dropDuplicates(["key"]).join(keys.join(listed.select("node").distinct(), "node"), "key").select("node", "text")
    full = stored(full.mapInArrow(tidied(_full_sets(width)), "node long, shingles array<long>"))
    about = stored(_own_shares(nodes, full, percent))
    open_lists = stored(listed.join(about.select("node", "n", "own"), "node").select("v", "node", "n", "own"))

    verified = lambda pairs: stored(_verified(pairs, nodes, full, percent, need, sketch))
    links = verified(_with_hubs(open_lists, percent).union(_with_neighbours(open_lists, percent)).select("a", "b").distinct())
    members = _split(_narrowed(_labelled(open_lists, links), percent), nodes, percent, need).join(about.drop("n", "own"), "node")
    left, right = (members.select("v", "w", "r" if x == "a" else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r"), *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "own", "label", "beyond", *_MASKS))) for x in "ab")
    rest = left.join(right, ["v", "w", "r"]).where((F.col("label_a") < F.col("label_b")) & _may_link(percent) & _may_link_by_parts(percent))
    links = stored(links.union(verified(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())))

    joined = stored(components(links))
    heads = joined.join(classes, "node").groupBy("component").agg(F.min("lead").alias("head"))
    headed = stored(joined.join(heads, "component").select("node", "head"))
    of_class = classes.join(headed, "node", "left").select("n", "s1", "s2", F.coalesce("head", "lead").alias("head"))
    linked = sets.where("n > 0").select("doc_id", "key", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"])
    alone = sets.where("n = 0").select("doc_id", "key", "n", own.alias("head"))
    return linked.select("doc_id", "key", "n", "head").union(alone).withColumnRenamed("n", "n_shingles")


def _may_link(percent: int) -> Column:
    """Whether two sets can reach the similarity, given their sizes and what only they hold."""
    most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _may_link_by_parts(percent: int) -> Column:
    """The same from what others hold too in each part of the hash range: of each part, they share at most the smaller count."""
    most = F.least("beyond_a", "beyond_b")
    for m in _MASKS:
        most = most + F.bit_count(F.col(f"{m}_a").bitwiseAND(F.col(f"{m}_b")))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _own_shares(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(node, n, own, masks, beyond): own counts the shingles that no other listed class has; the rest are counted by part of
    the hash range. Classes of which too many are their own to be linked at all are left out."""
    holders = full.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    alone = holders.where("holders = 1").groupBy("node").agg(F.collect_list("s").alias("alone"))
    counted = nodes.select("node", "n").join(full, "node").join(alone, "node", "left").withColumn("own", F.coalesce(F.size("alone"), F.lit(0)).cast("long"))
    counted = counted.withColumn("own", F.greatest("own", F.lit(0))).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    masks = ", ".join(f"{m} long" for m in _MASKS)
    return counted.select("node", "n", "own", "shingles", "alone").mapInArrow(tidied(_masks), f"node long, n long, own long, {masks}, beyond long")


def _best(pairs: DataFrame) -> DataFrame:
    """For each b the a with which it shares most lists."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("lists")).groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a"))


def _with_hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Each class with the member of its lists that has least of its own: among copies of a text, the text itself."""
    hub = F.min_by(F.struct("node", "n", "own"), F.struct(F.col("own") / F.col("n"), "node")).alias("hub")
    met = spread_join(lists, lists.groupBy("v").agg(hub, F.count("*").alias("_n")), ["v"], lists.count())
    sides = met.select(*(F.col(f"hub.{c}").alias(f"{c}_a") for c in ("node", "n", "own")), *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "own")))
    return _best(sides.where((F.col("node_a") != F.col("node_b")) & _may_link(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _with_neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """Each class with a neighbour in lists ordered by set size; a list may span partitions."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["v", "n", "node"]
    ordered = lists.select(columns).repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return _best(ordered.mapInArrow(tidied(_neighbours(percent)), "a long, b long"))


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists, each member with its component as label."""
    found = stored(components(links))
    return stored(lists.join(found, "node", "left").select("v", "node", "n", "own", F.coalesce("component", "node").alias("label")))


def _narrowed(lists: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Lists with members of different components only, and without members that can be linked to no size in their list.

    Two sets can be linked only if the size of each is within the other's reach, which its own size and own shingles give.
    A column size has a list's members, before the last round.
    """
    reach = (100 + percent) * (F.col("n") - F.col("own")) - percent * F.col("n")  # of percent * the other's size
    for _ in range(rounds):
        ends = [F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n"), F.max(reach).alias("most_reach")]
        keyed = lists.groupBy("v").agg(*ends, F.count("*").alias("_n")).withColumn("size", F.col("_n"))
        may = (F.col("low") < F.col("high")) & (reach >= percent * F.col("least_n")) & (percent * F.col("n") <= F.col("most_reach"))
        met = spread_join(lists.select("v", "node", "n", "own", "label"), keyed, ["v"], lists.count())
        lists = stored(met.where(may).select("v", "node", "n", "own", "label", "size"))
    return lists


def _split(lists: DataFrame, nodes: DataFrame, percent: int, need: int) -> DataFrame:
    """Members of lists with what they meet by: v, w, and block r of `blocks`.

    Lists of up to LONG_LIST members stay whole (w is v). In a longer one, two linked members share further retained values,
    so each is listed under its rarest others, w, as in _lists; that lists a member up to `sketch` times, which is less work
    than meeting all. A set of one shingle is linked with no other set, and leaves a long list.
    """
    own = ["v", "node", "n", "own", "label"]
    long = F.col("size") > LONG_LIST if percent > 50 else F.lit(False)  # under half, one value may be all that is shared
    whole = lists.where(~long).select(*own, F.col("v").alias("w"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    if not lists.where(long).isEmpty():
        least = F.least(F.lit(need), F.ceil(F.col("n") * percent / 100))
        held = lists.where(long).where(least > 1).join(nodes.select("node", "sketch"), "node")
        others = stored(held.select(*own, F.size("sketch").alias("held"), F.explode("sketch").alias("w")).where("w <> v"))
        counts = others.groupBy("v", "w").agg(F.count("*").alias("_n")).withColumn("lists", F.col("_n")).where("lists > 1")
        by_node = Window.partitionBy("v", "node")
        ranked = spread_join(others, counts, ["v", "w"], others.count())
        ranked = ranked.withColumn("rank", F.row_number().over(by_node.orderBy("lists", "w"))).withColumn("shared", F.count("*").over(by_node))
        ranked = ranked.where(F.col("rank") + F.col("held") - 1 - F.col("shared") <= F.col("held") - least + 1)
        whole = whole.union(ranked.select(*own, "w", F.ceil(F.col("lists") / BLOCK).cast("int").alias("blocks")))
    return whole.withColumn("r", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _lists(nodes: DataFrame, percent: int, need: int) -> DataFrame:
    """(v, node): each class under its rarest retained values; values of one class only have no list."""
    postings = nodes.select("node", F.explode("sketch").alias("v"))
    shared = postings.join(postings.groupBy("v").agg(F.count("*").alias("lists")).where("lists > 1"), "v")
    sizes = nodes.select("node", "n", F.size("sketch").alias("held"))
    own = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("lists", "v"))).withColumn("shared", F.count("*").over(own)).join(sizes, "node")
    least = F.least(F.lit(need), F.ceil(F.col("n") * percent / 100))
    return ranked.where(F.col("rank") + F.col("held") - F.col("shared") <= F.col("held") - least + 1).select("v", "node")


def _verified(pairs: DataFrame, nodes: DataFrame, full: DataFrame, percent: int, need: int, sketch: int) -> DataFrame:
    """Of pairs (a, b) those whose union sketch allows the similarity and whose full sets have it."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, sketch)
    shared = F.size(F.array_intersect(F.array_intersect("union", "sketch_a"), "sketch_b"))
    # A union of fewer values than a sketch holds is known whole.
    likely = shared >= F.least(F.lit(need), F.ceil(F.size("union") * percent / 100))
    hopeful = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("union", union).where(likely).select("a", "b")
    side = lambda x: full.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    compared = hopeful.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return compared.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both")))
