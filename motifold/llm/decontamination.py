"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items are lower-cased (A-Z) and cut into words; their word sequences make one automaton, which each task walks with the
words of its documents, tracking the longest suffix that occurs in an item. A word that occurs in no item sends the walk
back to its root, so only runs of known words of at least the shortest window are walked one by one; finding those runs
is array work over whole batches. Documents never move: there is no shuffle. Items beyond `BLOCK_WORDS` words are dealt
into several automata, each with a walk of its own, so what is broadcast stays bounded. A text is judged and cut by the
hits of all of them together.

Several automata are files in the shared folder that Spark hands to executors once each. One Python process a task scans with them: it keeps some
texts, loads one automaton after another, and lets go of each before the next, so it holds one at a time, however many items
there are.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifold.llm.shared import stored, tidied
from motifold.llm.textbatch import LOWER, WORDY, Piece, Words, pieces, spread, words

WINDOW = 10
#: Words of items in one automaton, which takes a few hundred bytes for each.
BLOCK_WORDS = 100_000
#: Bytes of texts that a task scans with one automaton of several before it loads the next.
SCAN_BYTES = 32 << 20
#: Share of hit words from which on a document goes as a whole.
MOST_COVERAGE = 0.5


_ITEM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class ItemAutomaton:
    """All factors of the items' word sequences. Built on the driver from one bounded block, then broadcast."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        #: By state: lengths of whole short items that end there, with their ids.
        self.whole: dict[int, dict[int, set[str]]] = {}
        items = [(name, raw) for name, text in items if (raw := (text or "").encode())]
        different = len({word for _, raw in items for word in _item_words(raw)})
        self.seed = -1
        self.vocabulary = np.zeros(0, np.uint64)
        while self.seed < 0 or len(self.vocabulary) < different:  # until no two words of items have one hash
            self.seed += 1
            sequences = [words(Piece(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), WORDY, seed=self.seed) for _, raw in items]
            self.vocabulary, first = np.unique(np.concatenate([x.hashes for x in sequences] or [self.vocabulary]), return_index=True)
        #: The words' bytes, by place in the vocabulary.
        every = [word for _, raw in items for word in _item_words(raw)]
        self.bytes = np.frombuffer(b"".join(every[i] for i in first.tolist()), np.uint8)
        self.sizes = np.array([len(every[i]) for i in first.tolist()], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        some = [i for i, x in enumerate(sequences) if len(x.hashes)]
        found, ids = [sequences[i].hashes for i in some], [items[i][0] for i in some]
        coded = [np.searchsorted(self.vocabulary, x).tolist() for x in found]
        self.shortest = min([window, *map(len, coded)])
        for name, sequence in zip(ids, coded, strict=True):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                self.items[last].add(name)
        for name, sequence in zip(ids, coded, strict=True):
            if len(sequence) < window:
                at = 0
                for word in sequence:
                    at = self.next[at][word]
                self.whole.setdefault(at, {}).setdefault(len(sequence), set()).add(name)
        self.above = [-1] * len(self.link)  # the nearest state, itself included, that ends a short item
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                self.items[self.link[s]] |= self.items[s]
        for s in order:
            self.above[s] = s if s in self.whole else self.above[self.link[s]]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state below parent by word, made to be no longer than one word more than parent."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        twin = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = twin
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = twin
            parent = self.link[parent]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def walk(self, run: list[int], hits: list[tuple[int, int]], found: set[str], base: int) -> int:
        """Add each occurrence of a window in a run of known words to hits (first, end), its items to found; the longest match."""
        step, link, length, window = self.next, self.link, self.length, self.window
        state = matched = longest = 0
        for i, word in enumerate(run, base + 1):
            while word not in step[state]:  # a known word is below the root
                state = link[state]
                matched = length[state]
            state = step[state][word]
            matched += 1
            longest = max(longest, matched)
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                hits.append((i - window, i))
                found |= self.items[at]
            at = self.above[state]
            while at > 0:
                for size, ids in self.whole[at].items():
                    if size <= matched:
                        hits.append((i - size, i))
                        found |= ids
                at = self.above[link[at]] if link[at] > 0 else -1
        return longest


def _item_words(raw: bytes) -> list[bytes]:
    return _ITEM_BYTES.findall(raw.lower())


def _confirmed(piece: Piece, found: Words, automaton: ItemAutomaton, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the piece's words (their places) are, letter by letter, the automaton's (theirs in the vocabulary)."""
    sizes = found.ends[at] - found.starts[at]
    fine = sizes == automaton.sizes[ids]
    own = LOWER[piece.data[spread(found.starts[at[fine]], sizes[fine])]] != automaton.bytes[spread(automaton.starts[ids[fine]], sizes[fine])]
    edges = np.cumsum(sizes[fine]) - sizes[fine]
    fine[fine] = np.add.reduceat(own, edges) == 0 if len(edges) else True
    return fine


def matches(piece: Piece, automaton: ItemAutomaton):
    """Words of the piece, and for each row with an occurrence: row -> (hits, items, longest match)."""
    found = words(piece, WORDY, seed=automaton.seed)
    vocabulary, h = automaton.vocabulary, found.hashes
    out: dict[int, tuple[list[tuple[int, int]], set[str], int]] = {}
    if not len(vocabulary) or not len(h):
        return found, out
    ids = np.searchsorted(vocabulary, h)
    ids[ids == len(vocabulary)] = 0
    known = vocabulary[ids] == h
    known[known] = _confirmed(piece, found, automaton, np.flatnonzero(known), ids[known])
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~known[:-1]
    ends[:-1] &= ~known[1:]
    inner = found.rows[(found.rows > 0) & (found.rows < len(h))]
    begins[inner] = known[inner]
    ends[inner - 1] = known[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = last - first >= automaton.shortest
    first, last = first[long], last[long]
    rows = np.searchsorted(found.rows, first, "right") - 1
    for row, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
        hits, items, longest = out.get(row, ([], set(), 0))
        longest = max(longest, automaton.walk(ids[a:b].tolist(), hits, items, a - int(found.rows[row])))
        out[row] = hits, items, longest
    return found, out


def _merged(hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _automata(benchmark: DataFrame, window: int, block_words: int):
    """One automaton after another; the driver holds the items of one block.

    Blocks are measured in item words. An item of more words than a block comes in stretches that overlap by a window less
    a word, so every window of it lies in one; items that repeat id and text count once.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words_of = items.select("item_id", F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(_ITEM_WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    first = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(block_words))
    stretches = words_of.select("item_id", F.explode(F.transform(first, lambda i: F.slice("words", i + 1, block_words + window - 1))).alias("words"))
    parts = stretches.select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("text")).distinct()
    blocks = max(1, math.ceil((parts.agg(F.sum("n")).first()[0] or 0) / block_words))
    for k in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        yield ItemAutomaton([(r["item_id"] or "", r["text"]) for r in rows], window)


_FOUND = "hits array<int>, items array<string>, n_words long, longest int"


class Automata:
    """One automaton, broadcast, or several, as files in the shared folder, of which a task loads one at a time."""

    def __init__(self, spark: SparkSession, made: Iterable[ItemAutomaton]) -> None:
        every = iter(made)
        first, second = next(every), next(every, None)
        self.shared, self.names = None, []
        if second is None:
            self.shared = spark.sparkContext.broadcast(first)
            return
        for automaton in chain([first, second], every):
            table = stored(spark.createDataFrame([(pickle.dumps(automaton),)], "automaton binary").coalesce(1))
            path = table.select(F.input_file_name()).first()[0]
            spark.sparkContext.addFile(path)  # an executor fetches it once, a new one after a loss too
            self.names.append(path.rsplit("/", 1)[1])

    def __iter__(self) -> Iterator[ItemAutomaton]:
        if self.shared is not None:
            yield self.shared.value
        for name in self.names:
            yield pickle.loads(parquet.read_table(SparkFiles.get(name))["automaton"][0].as_py())


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, of up to SCAN_BYTES and the batch that goes beyond."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > SCAN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(automata: Automata, names: list[str]):
    """Rows with a column text to `names`, among them what occurs of the items of all automata."""

    def run(batches):
        for held in [[x] for x in batches] if not automata.names else _held(batches):
            found = [{} for _ in held]
            counts = [np.zeros(0, np.int64)] * len(held)
            for automaton in automata:
                for k, batch in enumerate(held):
                    sizes = []
                    for piece in pieces(batch.column("text")):
                        words_, out = matches(piece, automaton)
                        sizes.append(np.diff(words_.rows))
                        for row, (new, ids, most) in out.items():
                            hits, items, longest = found[k].get(piece.first + row, ([], set(), 0))
                            found[k][piece.first + row] = _merged([*hits, *new]), items | ids, max(longest, most)
                    counts[k] = np.concatenate(sizes) if sizes else counts[k]
            for k, batch in enumerate(held):
                rows = [found[k].get(i, ((), (), 0)) for i in range(batch.num_rows)]
                made = {
                    "hits": pa.array([[x for span in hits for x in span] for hits, _, _ in rows], pa.list_(pa.int32())),
                    "items": pa.array([sorted(items) for _, items, _ in rows], pa.list_(pa.string())),
                    "n_words": pa.array(counts[k], pa.int64()),
                    "longest": pa.array([longest for _, _, longest in rows], pa.int32()),
                }
                own = dict(zip(batch.schema.names, batch.columns, strict=True))
                yield pa.RecordBatch.from_arrays([made[x] if x in made else own[x] for x in names], names=names)

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, hits (word positions: first, end, first, end, ... merged), items (sorted), longest.

    A window is `window` consecutive words of an item, or a whole item of fewer words; hits are the document's words
    within any occurrence. longest is the longest stretch of words that occurs in an item (in one of its stretches, if it
    has more than block_words words), of those in runs of known words of at least a window. Null and wordless texts have no words; items that are null or wordless have no windows; a null
    item_id counts as an empty one. An empty benchmark hits nothing. Other columns are ignored.
    """
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    automata = Automata(docs.sparkSession, _automata(benchmark, window, block_words))
    return out.mapInArrow(tidied(_scan(automata, ["doc_id", "hits", "items", "n_words", "longest"])), f"doc_id {kind}, {_FOUND}")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item_ids, comma-joined), contaminated, longest.

    Null, empty and repeated rows: see contaminated_spans.
    """
    found = contaminated_spans(docs, benchmark, window, block_words)
    ends = F.aggregate("hits", F.lit(0), lambda total, x: x - total)  # the sum of ends less firsts, as there are pairs
    return found.select(
        "doc_id",
        "n_words",
        ends.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest",
    )


def clean_text(text: str, automaton: ItemAutomaton) -> tuple[str, float]:
    """The text without hit spans, and the share of its words that were hit. Cutting repeats until no window is left."""
    share = None
    while True:
        data = np.frombuffer(text.encode(), np.uint8)
        found, out = matches(Piece(0, data, np.array([0, len(data)])), automaton)
        spans = _merged(out[0][0]) if out else []
        if share is None:
            share = sum(b - a for a, b in spans) / max(1, len(found.starts))
        if not spans:
            return text, share
        text = _without(data, found, spans)


def _without(data: np.ndarray, found: Words, spans: list[tuple[int, int]]) -> str:
    """The text of data, whose words are found, without merged spans of words."""
    raw, kept, at = data.tobytes(), [], 0
    for a, b in spans:
        kept.append(raw[at : found.starts[a]])
        at = int(found.ends[b - 1])
    return b" ".join([*kept, raw[at:]]).decode()


def _clean(automata: Automata):
    def run(batches):
        (automaton,) = automata
        for batch in batches:
            texts, place = batch.column("text"), batch.schema.get_field_index("text")
            hit, changed, shares = set(), {}, {}
            for piece in pieces(texts):
                hit |= {piece.first + row for row, (spans, _, _) in matches(piece, automaton)[1].items() if spans}
            for row in hit:
                changed[row], shares[row] = clean_text(texts[row].as_py(), automaton)
            if changed:
                texts = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], pa.string())
            columns = [*batch.columns[:place], texts, *batch.columns[place + 1 :]]
            keep = pa.array([shares.get(i, 0.0) <= MOST_COVERAGE for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return run


def _cut(first: bool):
    """(row, text, hits, ...) to (row, text, changed), the text without its hits; at first, without rows that are mostly hits."""

    def run(batches):
        for batch in batches:
            table = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts, keep, changed = table["text"].to_pylist(), [], []
            for i, (flat, n) in enumerate(zip(table["hits"].to_pylist(), table["n_words"].to_pylist(), strict=True)):
                spans = [*zip(flat[::2], flat[1::2], strict=True)]
                keep.append(not first or sum(b - a for a, b in spans) / max(1, n) <= MOST_COVERAGE)
                changed.append(bool(spans))
                if spans and keep[-1]:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    texts[i] = _without(data, words(Piece(0, data, np.array([0, len(data)])), WORDY), spans)
            made = [table["row"], pa.array(texts, pa.string()), pa.array(changed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=["row", "text", "changed"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cut_by_all(docs: DataFrame, automata: Automata) -> DataFrame:
    """docs cut by several automata: each round finds the hits of all, cuts them, and goes on with the rows it changed."""
    row, text = T.StructField("row", docs.schema), T.StructField("text", T.StringType())
    names = ["row", "text", "hits", "items", "n_words", "longest"]
    scanned = T.StructType([row, text, *T.StructType.fromDDL(_FOUND).fields])
    left, done = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text")), []
    while not done or left.take(1):
        found = left.mapInArrow(tidied(_scan(automata, names)), scanned)
        step = stored(found.mapInArrow(tidied(_cut(not done)), T.StructType([row, text, T.StructField("changed", T.BooleanType())])))
        done.append(step.where("not changed"))
        left = step.where("changed").select("row", "text")
    out = reduce(DataFrame.union, done)
    return out.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with every hit span cut out of text; documents with more than MOST_COVERAGE of their words hit go as a whole.

    All columns stay, n_chars (if there is one) is counted anew for all rows. Clean rows, null and empty texts included,
    are unchanged. A cut can bring words together that make a window; cutting repeats until none is left. All items count
    together, in one automaton or several, which are scanned in turn and whose rounds are stored.
    """
    out = docs
    automata = Automata(docs.sparkSession, _automata(benchmark, window, block_words))
    out = _cut_by_all(out, automata) if automata.names else out.mapInArrow(tidied(_clean(automata)), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)
