"""SentencePiece encoding and decoding by suffix-array matching.

A task cuts its texts into words where no piece can reach across (before a space, around bytes that no piece has), and
encodes each distinct word once. New words of a batch make one text, which is indexed by a suffix array; every piece's
occurrences are a range of it, found by binary search for all pieces at once; the ranges give the edges of a lattice,
which are sorted by the position where they end and relaxed in that order, all words side by side.

With a unigram model, an edge is relaxed if it gives its end a higher sum of scores; of equal ones the longest piece counts.
Sums start anew at each word, so where two ways are equal but for rounding, a library that adds up a whole text may differ.
With a model that merges pairs (byte-pair encoding), a best path by scores would be wrong. There an edge is relaxed if the
piece before it and its own piece stay apart when merging their joined text; a text's encoding is the one path of such
pairs, so one edge per position succeeds. Which pairs do is worked out once per pair.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import tidied
from motifold.llm.textbatch import Piece, pieces, ragged, span_hashes, spread

SPACE = "▁"
#: Bytes of text that a task cuts into words at once.
PIECE_BYTES = 1 << 20
#: Distinct words, their tokens, and pairs of pieces that a worker keeps; beyond, it starts anew.
KEPT_WORDS = 400_000
KEPT_TOKENS = 4_000_000
KEPT_PAIRS = 1_000_000
#: Characters of new words that are indexed at once.
INDEX_CHARS = 1 << 18
WIDEST = 16


class PieceModel(NamedTuple):
    """What tasks need of a model file; broadcast, about 10 MB for 32,000 pieces."""

    texts: list[str]  #: by id; empty for control and byte pieces
    ranks: dict[str, int]  #: of pieces of several characters, in the order of merging
    ids: dict[str, int]
    byte_ids: np.ndarray
    symbols: np.ndarray  #: by code point; 0xFFFE: in no piece
    absent: np.ndarray  #: bytes below 128 that no piece has
    usable: np.ndarray  #: ids of pieces that merging their own text gives
    lengths: np.ndarray  #: their characters
    low: np.ndarray  #: their symbols, 16 bits each, then zeros
    high: np.ndarray  #: likewise, then ones
    raw: np.ndarray  #: bytes that ids decode to
    raw_starts: np.ndarray
    scores: np.ndarray | None  #: of a unigram model, by id, then that of a character that is no piece; else None
    single: np.ndarray  #: by symbol: whether the character is a piece


_UNKNOWN = 0xFFFE


def load_model(path: str) -> PieceModel:
    """Read a model file on the driver. ValueError if it isn't a byte-pair or unigram model with byte fallback and no normalisation."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    with open(path, "rb") as f:
        content = f.read()
    proto, own = ModelProto(), SentencePieceProcessor(model_proto=content)
    proto.ParseFromString(content)
    norm = proto.normalizer_spec
    unigram = proto.trainer_spec.model_type == 1
    if proto.trainer_spec.model_type not in (1, 2) or any(p.type == 4 for p in proto.pieces) or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only byte-pair and unigram models with byte fallback, a dummy prefix, unchanged text and no pieces of a user are read")
    n = own.get_piece_size()
    plain = [i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
    texts = [""] * n
    for i in plain:
        texts[i] = own.id_to_piece(i)
    if any(SPACE in x.lstrip(SPACE) for x in texts) or max(map(len, texts)) > WIDEST:
        raise ValueError("a piece has a space after other characters, or is too long")
    ids = {texts[i]: i for i in plain}
    order = sorted((i for i in plain if len(texts[i]) > 1), key=lambda i: -own.get_score(i))
    ranks = {texts[i]: k for k, i in enumerate(order)}
    byte_ids = np.array([own.piece_to_id(f"<0x{i:02X}>") for i in range(256)], np.int32)
    chars = sorted(set("".join(texts)))
    symbols = np.full(0x110000, _UNKNOWN, np.uint16)
    single = np.zeros(1 << 16, bool)
    for k, x in enumerate(chars):
        single[k + 1] = x in ids
        if unigram or x in ids:
            symbols[ord(x)] = k + 1
    symbols[32] = symbols[ord(SPACE)]
    absent = np.zeros(256, bool)
    absent[:128] = symbols[:128] == _UNKNOWN
    usable = np.array([i for i in plain if unigram or merged(texts[i], ranks) == [texts[i]] and all(x in ids for x in texts[i])], np.int64)
    low, high = np.zeros((len(usable), WIDEST), np.uint16), np.full((len(usable), WIDEST), 0xFFFF, np.uint16)
    for row, i in enumerate(usable):
        low[row, : len(texts[i])] = high[row, : len(texts[i])] = [symbols[ord(x)] for x in texts[i]]
    value = {int(x): bytes([k]) for k, x in enumerate(byte_ids)}
    raw = [value.get(i, texts[i].replace(SPACE, " ").encode()) for i in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    lengths = np.array([len(texts[i]) for i in usable], np.int64)
    scores = np.array([own.get_score(i) for i in range(n)], np.float32)
    scores = np.append(scores, scores[plain].min() - np.float32(10)) if unigram else None  # 10: a fixed value of the format
    return PieceModel(texts, ranks, ids, byte_ids, symbols, absent, usable, lengths, _packed(low), _packed(high), np.frombuffer(b"".join(raw), np.uint8), starts, scores, single)


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """A short text after merging: again and again the pair of the first rank, the leftmost such."""
    parts = list(text)
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _packed(symbols: np.ndarray) -> np.ndarray:
    """Rows of 16 symbols as four numbers that compare like them."""
    s = symbols.astype(np.uint64)
    return np.stack([s[:, i] << np.uint64(48) | s[:, i + 1] << np.uint64(32) | s[:, i + 2] << np.uint64(16) | s[:, i + 3] for i in range(0, WIDEST, 4)], 1)


def _bound(index: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted row, how many rows of the sorted index are smaller (or, if after, not larger)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(index), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        rows = index[np.minimum(middle, len(index) - 1)]
        before, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for i in range(index.shape[1]):
            before |= equal & (rows[:, i] < wanted[:, i])
            equal &= rows[:, i] == wanted[:, i]
        right = open_ & (before | (equal if after else False))
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


class Encoder:
    """The state of one worker: words and pairs that it has met."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.size = len(model.texts) + 1  # the last id stands for a character of no piece
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.places: dict[int, int] = {}
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def stay_apart(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces gives the two; a character of no piece never merges."""
        wanted = before * self.size + after
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.pairs, wanted), max(0, len(self.pairs) - 1))
            missing = wanted[self.pairs[at] != wanted] if len(self.pairs) else wanted
            if not len(missing):
                break
            fresh = np.unique(missing)
            model, texts = self.model, self.model.texts
            answers = []
            for a, b in zip((fresh // self.size).tolist(), (fresh % self.size).tolist(), strict=True):
                answers.append(self.size - 1 in (a, b) or merged(texts[a] + texts[b], model.ranks) == [texts[a], texts[b]])
            pairs, apart = np.concatenate([self.pairs, fresh]), np.concatenate([self.apart, np.array(answers, bool)])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.apart = pairs[order], apart[order]
        return self.apart[at]

    def index(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words (code points, and characters of each), and how many each has."""
        model, words = self.model, len(lengths)
        base = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.zeros(len(codes) + words + WIDEST, np.uint16)
        places = spread(base, lengths)
        symbols[places] = model.symbols[codes]
        n = len(codes) + words
        packed = _packed(np.lib.stride_tricks.sliding_window_view(symbols, WIDEST)[:n])
        suffixes = np.lexsort(packed.T[::-1])
        index = packed[suffixes]
        first, last = _bound(index, model.low, False), _bound(index, model.high, True)
        found = last - first
        start = suffixes[spread(first, found)]
        piece, length = np.repeat(model.usable, found), np.repeat(model.lengths, found)
        lone = places[~model.single[symbols[places]]]
        start, piece, length = np.concatenate([start, lone]), np.concatenate([piece, np.full(len(lone), self.size - 1)]), np.concatenate([length, np.ones(len(lone), np.int64)])
        end = start + length
        # Edges by the position in their word where they end, there the longest first.
        order = np.argsort(end * 32 + (WIDEST - length), kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        turn = np.arange(len(end)) - np.searchsorted(end, end)
        word_of = np.zeros(n, np.int64)
        word_of[base[1:]] = 1
        word_of = np.cumsum(word_of)
        level = (end - base[word_of[start]]) * 32 + turn
        order = np.argsort(level, kind="stable")
        level, start, piece, end = level[order], start[order], piece[order], end[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
        token, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        token[base] = -2
        best = np.full(n + 1, -np.inf, np.float32)
        best[base] = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if model.scores is not None:
                score = best[start[a:b]] + model.scores[piece[a:b]]
                own = np.arange(a, b)[score > best[end[a:b]]]
                best[end[own]] = score[own - a]
                token[end[own]], back[end[own]] = piece[own], start[own]
                continue
            own = np.arange(a, b)[token[end[a:b]] == -1]
            before = token[start[own]]
            own = own[(before == -2) | ((before >= 0) & self.stay_apart(np.maximum(before, 0), piece[own]))] if len(own) else own
            token[end[own]], back[end[own]] = piece[own], start[own]
        # Back from each word's end, all words at once.
        at, word, steps = base + lengths, np.arange(words), []
        while len(word):
            steps.append((word, at))
            at = back[at]
            more = at > base[word]
            word, at = word[more], at[more]
        counts = np.zeros(words, np.int64)
        for word, _ in steps:
            counts[word] += 1
        ends = np.cumsum(counts)
        out, source = np.zeros(int(ends[-1]) if words else 0, np.int64), np.zeros(int(ends[-1]) if words else 0, np.int64)
        for k, (word, at) in enumerate(steps):
            out[ends[word] - 1 - k], source[ends[word] - 1 - k] = token[at], back[at]
        return self._with_bytes(out, codes_at=source, places=places, codes=codes, counts=counts)

    def _with_bytes(self, out, codes_at, places, codes, counts) -> tuple[np.ndarray, np.ndarray]:
        """Characters of no piece become the pieces of their bytes."""
        lone = np.flatnonzero(out == self.size - 1)
        if not len(lone):
            return out.astype(np.int32), counts
        which = codes[np.searchsorted(places, codes_at[lone])]
        raw = [chr(x).encode("utf-8", "surrogatepass") for x in which.tolist()]
        widths = np.ones(len(out), np.int64)
        widths[lone] = [len(x) for x in raw]
        word = np.repeat(np.arange(len(counts)), counts)
        wide = np.repeat(out, widths)
        mark = np.repeat(np.isin(np.arange(len(out)), lone), widths)
        wide[mark] = self.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return wide.astype(np.int32), np.bincount(word, widths, len(counts)).astype(np.int64)

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new words: bytes data[starts:ends] of each."""
        lengths = ends - starts
        a = 0
        while a < len(hashes):
            b = max(a + 1, int(np.searchsorted(np.cumsum(lengths[a:]), INDEX_CHARS, "right")) + a)
            raw = data[spread(starts[a:b], lengths[a:b])]
            chars = np.add.reduceat((raw & 0xC0) != 0x80, np.cumsum(lengths[a:b]) - lengths[a:b]).astype(np.int64)
            codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            tokens, counts = self.index(codes, chars)
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(counts) - counts])
            self.counts, self.tokens = np.concatenate([self.counts, counts]), np.concatenate([self.tokens, tokens])
            self.places.update(zip(hashes[a:b].tolist(), range(len(self.places), len(self.places) + b - a), strict=True))
            a = b

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all rows, how many each row has, and whether each decodes to its own text."""
        sizes = np.diff(piece.bounds)
        full = np.flatnonzero(sizes)
        data = np.full(len(piece.data) + len(full), 32, np.uint8)  # the dummy prefix of each text
        begins = piece.bounds[full] + np.arange(len(full))
        place = np.ones(len(data), bool)
        place[begins] = False
        data[place] = piece.data
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool)
        blank, odd = data == 32, self.model.absent[data]
        cut = np.ones(len(data), bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.places) > KEPT_WORDS or len(self.tokens) > KEPT_TOKENS:
            self.forget()
        known = np.fromiter((self.places.get(x, -1) for x in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.places), len(self.places) + len(new))
            self.learn(keys[new], data, starts[first[new]], ends[first[new]])
        word = known[which]
        counts = self.counts[word]
        tokens = self.tokens[spread(self.starts[word], counts)]
        rows = np.zeros(len(sizes), np.int64)
        rows[full] = np.add.reduceat(counts, np.searchsorted(starts, begins))
        decoded, widths = self.decode(tokens)
        same = np.ones(len(sizes), bool)
        if not np.array_equal(decoded, data):
            own = np.cumsum(np.concatenate([[0], widths]))[np.cumsum(rows) - rows]
            for k, row in enumerate(full.tolist()):
                end = begins[k] + sizes[row] + 1
                same[row] = np.array_equal(decoded[own[row] : own[row] + sizes[row] + 1], data[begins[k] : end])
            if not same.all():
                tokens = self._confirmed(tokens, rows, same, data, starts, ends, np.append(np.searchsorted(starts, begins), len(starts)), full)
        return tokens, rows, same

    def _confirmed(self, tokens: np.ndarray, rows: np.ndarray, same: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, full: np.ndarray) -> np.ndarray:
        """tokens, those of rows that don't decode to their text being made anew, word by word and by content: another word
        may have had the hash of one of theirs. rows and same are brought up to date."""
        lists, known = np.split(tokens, np.cumsum(rows)[:-1]), {}
        for k, row in enumerate(full.tolist()):
            if same[row]:
                continue
            texts = [data[a:b].tobytes() for a, b in zip(starts[edges[k] : edges[k + 1]].tolist(), ends[edges[k] : edges[k + 1]].tolist(), strict=True)]
            for raw in {*texts} - known.keys():
                codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
                known[raw] = self.index(codes, np.array([len(codes)]))[0]
            lists[row] = np.concatenate([known[raw] for raw in texts])
            rows[row] = len(lists[row])
            same[row] = self.decode(lists[row])[0].tobytes() == b"".join(texts)
        return np.concatenate(lists)

    def decode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens, and how many each has."""
        model = self.model
        widths = np.diff(model.raw_starts)[tokens]
        return model.raw[spread(model.raw_starts[tokens], widths)], widths


class Shared:
    """A model and, on a worker, its encoder: later tasks know the words of earlier ones, until Spark drops the broadcast."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.encoder: Encoder | None = None

    def own(self) -> Encoder:
        if self.encoder is None:
            self.encoder = Encoder(self.model)
        return self.encoder


def _spaced(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.replace_substring(column, SPACE, " ") if pc.any(pc.match_substring(column, SPACE)).as_py() else column


def _rows(batch: pa.RecordBatch, place: int, encoder: Encoder):
    for piece in pieces(_spaced(batch.column(place)), PIECE_BYTES):
        yield batch.slice(piece.first, len(piece.bounds) - 1), *encoder.encode(piece)


def encoded(docs: DataFrame, model: PieceModel) -> DataFrame:
    """docs with a further column ids (array<int>). A null text has null ids, an empty one none.

    A character U+2581 in a text counts as a space, as in the model. A column ids of docs is replaced.
    """
    rows = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(Shared(model))
    place = rows.columns.index("text")

    def run(batches):
        encoder = shared.value.own()
        for batch in batches:
            for part, tokens, counts, _ in _rows(batch, place, encoder):
                ids = ragged(tokens, counts, pa.int32())
                if part.column(place).null_count:
                    ids = pa.compute.if_else(part.column(place).is_valid(), ids, pa.scalar(None, ids.type))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(tidied(run), f"{fields}, ids array<int>")


def decoded(docs: DataFrame, model: PieceModel) -> DataFrame:
    """docs (with ids) and a further column text: what the ids decode to, without the dummy prefix. Null ids: null.

    Bytes that are no UTF-8 become U+FFFD; a column text of docs is replaced.
    """
    rows = docs.drop("text")
    shared = docs.sparkSession.sparkContext.broadcast(Shared(model))
    place = rows.columns.index("ids")

    def run(batches):
        encoder = shared.value.own()
        for batch in batches:
            lists = batch.column(place)
            sizes = np.diff(lists.offsets.to_numpy())
            data, widths = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            edges = np.cumsum(np.concatenate([[0], widths]))[np.concatenate([[0], np.cumsum(sizes)])]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            texts = [x.removeprefix(" ") if ok else None for x, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(tidied(run), f"{fields}, text string")


def encoding_report(docs: DataFrame, model: PieceModel) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_pieces, ids_sha256 (of the ids, little-endian, 4 bytes each), round_trip.

    round_trip says that the ids decode to the text (a U+2581 in it: a space). A null text counts as empty. Repeated rows
    get equal answers; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Shared(model))

    def run(batches):
        encoder = shared.value.own()
        for batch in batches:
            for part, tokens, counts, same in _rows(batch, 1, encoder):
                ends = np.cumsum(counts)
                raw = memoryview(tokens.astype("<i4").tobytes())
                sums = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(sums, pa.string()), pa.array(same)], names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")
