"""Cross-entropy difference: a target and a background language model of one kind score every document.

Both are interpolated byte n-gram models of the same order, smoothing and vocabulary (the 256 bytes, so nothing is ever
out of vocabulary in either, whatever the script). Counts are taken over all documents. Rows are stored once in blocks of
bounded size; a block's distinct n-grams are counted where it lies, summed over blocks, and given both losses in joins by
n-gram. The losses of a block's n-grams then meet its rows, in one group for each block. No table of n-grams goes through
the driver or is broadcast, however many there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import stored, tidied
from motifold.llm.textbatch import Piece, pieces, text_buffer

ORDER = 5
#: Weight of the next shorter n-gram's probability, in counts.
PRIOR = 4.0
#: Bytes of text in a block, and what a row counts for besides; a longer text makes a block of its own.
BLOCK_BYTES = 16 << 20
ROW_BYTES = 64
#: Target documents whose ids are broadcast to the counting tasks (about 20 MB); more are joined, which moves the texts.
SENT_TARGETS = 1_000_000


def piece_grams(piece: Piece, order: int = ORDER) -> np.ndarray:
    """For each byte of the piece, it and the bytes before it in its text, packed; zeros stand before a text."""
    lengths = np.diff(piece.bounds)
    pad = order - 1
    places = np.arange(len(piece.data)) + pad * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    line = np.zeros(len(piece.data) + pad * len(lengths), np.int64)
    line[places] = piece.data
    packed = line.copy()
    for i in range(1, order):
        packed[i:] |= line[:-i] << 8 * i
    return packed[places]


def _number_blocks(most: int):
    def run(batches):
        first, block, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks = np.empty(batch.num_rows, np.int64)
            for row, length in enumerate((np.diff(text_buffer(batch.column(1))[1]) + ROW_BYTES).tolist()):
                if size and size + length > most:
                    block, size = block + 1, 0
                size += length
                blocks[row] = first + block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks)], names=[*batch.schema.names, "block"])

    return run


def in_blocks(rows: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """rows (doc_id, text, ...) stored with a number for each run of them that holds about `most` bytes of text."""
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return stored(rows.mapInArrow(tidied(_number_blocks(most)), f"{fields}, block long"))


def _count(order: int):
    schema = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("background", pa.int64()), ("target", pa.int64())])

    def merged(parts: list) -> tuple:
        keys, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
        return keys, *(np.bincount(place, np.concatenate([x[i] for x in parts]), len(keys)).astype(np.int64) for i in (1, 2))

    def out(block: int, held: list):
        keys, background, target = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys), pa.array(background), pa.array(target)], schema=schema)

    def run(batches):
        now, held = None, []
        for batch in batches:
            numbers = batch.column(2).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and numbers[a] != now:
                    yield out(now, held)
                    held = []
                now = int(numbers[a])
                chosen = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)
                for piece in pieces(batch.column(0).slice(a, b - a)):
                    grams = piece_grams(piece, order)
                    lengths = np.diff(piece.bounds)
                    wanted = np.repeat(chosen[piece.first : piece.first + len(lengths)].astype(bool), lengths)
                    keys, counts = np.unique(grams, return_counts=True)
                    own, some = np.unique(grams[wanted], return_counts=True)
                    target = np.zeros(len(keys), np.int64)
                    target[np.searchsorted(keys, own)] = some
                    held.append((keys, counts, target))
                    held = [merged(held)] if len(held) > 8 else held
        if held:
            yield out(now, held)

    return run


def gram_counts(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram, background, target) over all rows of blocks (block, text, target: boolean); the background is all rows.

    A block that is read in parts has several rows for an n-gram, which are to be added.
    """
    rows = blocks.select("text", "target", "block")
    return rows.mapInArrow(tidied(_count(order)), "block long, gram long, background long, target long")


def gram_losses(counts: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(gram, loss_background, loss_target) for each n-gram of counts (gram, background, target): -ln of the interpolated probability."""
    models = ("background", "target")
    sums = [F.sum(x).alias(x) for x in models]
    shorter = None
    for size in range(1, order + 1):
        own = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram")).agg(*sums) if size < order else counts
        own = own.withColumn("context", F.shiftright("gram", 8))
        after = own.groupBy("context").agg(*(F.sum(x).alias(f"{x}_after") for x in models))
        own = own.join(after, "context")
        if shorter is None:
            own = own.withColumns({f"{x}_less": F.lit(1 / 256) for x in models})
        else:
            less = shorter.select(F.col("gram").alias("tail"), *(F.col(f"p_{x}").alias(f"{x}_less") for x in models))
            own = own.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))).join(less, "tail")
        shorter = own.select("gram", *((((F.col(x) + prior * F.col(f"{x}_less")) / (F.col(f"{x}_after") + prior))).alias(f"p_{x}") for x in models))
    return shorter.select("gram", *((-F.ln(f"p_{x}")).alias(f"loss_{x}") for x in models))


class LossTable(NamedTuple):
    """Losses by n-gram of one block: an open hash table that has every n-gram of the block."""

    keys: np.ndarray
    losses: np.ndarray  #: slots x 2

    @staticmethod
    def of(grams: np.ndarray, losses: np.ndarray) -> LossTable:
        size = 1 << max(4, int(2 * len(grams)).bit_length())
        keys, values = np.full(size, -1, np.int64), np.zeros((size, 2))
        slots, left = _slots(grams, size), np.arange(len(grams))
        while len(left):
            free = keys[slots[left]] == -1
            keys[slots[left[free]]] = grams[left[free]]
            placed = keys[slots[left]] == grams[left]
            values[slots[left[placed]]] = losses[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & (size - 1)
        return LossTable(keys, values)

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """n-grams x 2."""
        size = len(self.keys)
        slots = _slots(grams, size)
        left = np.flatnonzero(self.keys[slots] != grams)
        while len(left):
            slots[left] = (slots[left] + 1) & (size - 1)
            left = left[self.keys[slots[left]] != grams[left]]
        return self.losses[slots]


def _slots(grams: np.ndarray, size: int) -> np.ndarray:
    spread = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(65 - int(size).bit_length())).astype(np.int64)


def _score(order: int):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        table = LossTable.of(found.column("gram").to_numpy(), np.stack([found.column(x).to_numpy() for x in ("loss_background", "loss_target")], 1))
        ids, texts = rows.column("doc_id"), rows.column("text").combine_chunks()
        counts, sums = np.zeros(rows.num_rows, np.int64), np.zeros((rows.num_rows, 2))
        for piece in pieces(texts):
            lengths = np.diff(piece.bounds)
            full = np.flatnonzero(lengths)
            counts[piece.first : piece.first + len(lengths)] = lengths
            if len(full):
                sums[piece.first + full] = np.add.reduceat(table.look_up(piece_grams(piece, order)), piece.bounds[full], axis=0)
        return pa.Table.from_arrays([ids, pa.array(counts), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["doc_id", "n_tokens", "background", "target"])

    return run


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens (bytes), loss_target, loss_background, score.

    targets has the doc_ids of the target's documents (repeats count once; ids without a document are ignored); the
    background is all of docs. Losses are means over a document's bytes, in nats; score is loss_target less
    loss_background: the lower, the more like the target. Null and empty texts have 0 tokens and null losses. Without
    targets, the target's model is uniform. Rows with a null or repeated doc_id keep a row each, with the losses of their
    own text, whatever the blocks. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = targets.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    chosen = F.broadcast(chosen) if chosen.count() <= SENT_TARGETS else chosen
    blocks = in_blocks(texts.join(chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")), block_bytes)
    counts = stored(gram_counts(blocks, order))
    totals = stored(counts.groupBy("gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    found = counts.select("block", "gram").join(gram_losses(totals, order, prior), "gram").select("block", "gram", "loss_background", "loss_target")
    kind = blocks.schema["doc_id"].dataType.simpleString()
    sides = blocks.select("block", "doc_id", "text").groupBy("block").cogroup(found.groupBy("block"))
    sums = sides.applyInArrow(_score(order), f"doc_id {kind}, n_tokens long, background double, target double")
    mean = lambda x: F.when(F.col("n_tokens") > 0, F.col(x) / F.col("n_tokens"))
    return sums.select("doc_id", "n_tokens", mean("target").alias("loss_target"), mean("background").alias("loss_background"), (mean("target") - mean("background")).alias("score"))
