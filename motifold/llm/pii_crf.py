"""Personal data: base patterns, and a skip-chain conditional random field that keeps labels consistent in a document.

Nodes are the tokens with a digit or an at sign, of every document that has one. Edges join tokens that stand side by
side, tokens that repeat each other (same text, same last digits, same local part of an address) and tokens that are alike
(same shape, same beginning, same word before), each to the one before with that trait and to the first, so edges grow
with the tokens, not with their square. Potentials of nodes and edges are learned together, by pseudo-likelihood, from
what the base patterns label in a bounded sample of rows. Loopy message passing over a document, with base labels held,
gives marginals; runs of tokens that reach `SURE` for a kind become further spans, whether a base span is near or not.
Documents are worked on one by one where they lie: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import hashed_share, tidied
from motifold.llm.textbatch import byte_set, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Rows that potentials are learned from: those of the smallest hashes.
SAMPLE_ROWS = 2000
#: Of each, the characters that reach the driver (a stretch of the text); of all, the tokens.
SAMPLE_CHARS = 20_000
SAMPLE_TOKENS = 20_000
SURE = 0.9
#: Rounds of message passing at most, and the change of a message under which it stops.
ROUNDS = 50
STILL = 1e-6
#: Kinds of edges.
EDGES = ("beside", "repeats", "alike")
#: What the potential of an edge between repeated tokens is drawn to, if both have one kind's label: without other evidence they agree.
AGREE = 5.0
#: Weights of the squares of node and edge potentials (of edges: less what they are drawn to) beside a node's mean loss.
NODE_DECAY, EDGE_DECAY = 1e-5, 1e-3
#: Shapes and words before a token that are features, the commonest of the sample, and how often they must occur there.
MOST_SHAPES, MOST_WORDS, LEAST_SEEN = 256, 64, 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = ".,;:!?\"'*#%&$|[]<>"
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(map(int, reversed(digits))):
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each at sign to the left and the right; one pass, however long a run of letters is."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _LOCAL_SET:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            out.append(("email", first, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[Span]:
    """Numbers joined by dots, four at a time."""
    out = []
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + len(".".join(four))
            if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as in KINDS, then by start."""
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += addresses(text)
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", found.start(), found.end()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(found.group())) <= 15:
                out.append(("phone", found.start(), found.end()))
    return out


def unsure_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the card and phone patterns that are dropped for too many digits: they may hold one beside another number."""
    out = []
    for pattern, most in ((_CARD, 19), (_PHONE, 15)):
        out += [x.span() for x in pattern.finditer(text) if len(_DIGIT.findall(x.group())) > most]
    return sorted(out)


class Nodes(NamedTuple):
    spans: list[tuple[int, int]]
    cores: list[str]
    before: list[str]  #: the word before each, lower-cased
    base: np.ndarray  #: label of the base span that a token overlaps, else 0
    edges: np.ndarray  #: rows (node, node, place in EDGES)


def shape(core: str) -> str:
    """Digits as 9 and runs of letters as a; longer runs of digits, or mixtures, by their beginning."""
    return _LETTERS.sub("a", _DIGIT.sub("9", core))[:24]


def nodes_of(text: str, base: list[Span]) -> Nodes:
    spans, cores, before, last_end = [], [], [], -2
    edges: set[tuple[int, int, int]] = set()
    for found in _TOKEN.finditer(text):
        word = found.group()
        core = word.strip(_EDGES)
        if not core:
            continue
        start = found.start() + word.index(core)
        if spans and last_end >= 0 and text[last_end : found.start()].isspace():
            edges.add((len(spans) - 1, len(spans), 0))
        last_end = found.end()
        spans.append((start, start + len(core)))
        cores.append(core.lower())
        words = _LETTERS.findall(text[max(0, found.start() - 40) : found.start()].lower())
        before.append(words[-1] if words else "")
    label = np.zeros(len(spans), np.int64)
    for kind, start, end in sorted(base, key=lambda x: x[1]):
        for i in range(_first_after(spans, start), len(spans)):
            if spans[i][0] >= end:
                break
            label[i] = LABELS.index(kind)
    keys: dict[tuple, list[int]] = {}
    for i, core in enumerate(cores):
        digits = "".join(_DIGIT.findall(core))
        own = {(2, "shape", shape(core)), (2, "word", before[i])}
        if len(core) >= 6:
            own |= {(1, "text", core), (2, "start", core[:4])}
        if len(digits) >= 7:
            own.add((1, "digits", digits[-7:]))
        if len(core) >= 4:
            own.add((1, "local", core.split("@")[0]))
        for key in own:
            keys.setdefault(key, []).append(i)
    # Of several reasons to join two tokens the strongest counts.
    strong = {(a, b, 1) for key, own in keys.items() if key[0] == 1 for i, b in enumerate(own[1:]) for a in (own[0], own[i])}
    alike = {(a, b, 2) for key, own in keys.items() if key[0] == 2 for i, b in enumerate(own[1:]) for a in (own[0], own[i])}
    alike = {x for x in alike if (*x[:2], 1) not in strong and (*x[:2], 0) not in edges}
    return Nodes(spans, cores, before, label, np.array(sorted(edges | strong | alike), np.int64).reshape(-1, 3))


def _first_after(spans: list[tuple[int, int]], start: int) -> int:
    low, high = 0, len(spans)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if spans[mid][1] <= start else (low, mid)
    return low


def _features(core: str) -> list[float]:
    digits = "".join(_DIGIT.findall(core))
    n, dots = len(digits), core.count(".")
    parts = core.split(".")
    return [
        1.0,
        "@" in core,
        "@" in core and "." in core.split("@")[-1],
        n >= 1,
        13 <= n <= 19,
        13 <= n <= 19 and luhn(digits),
        n == len(core),
        dots == 3 and n + 3 == len(core),
        dots == 3 and n + 3 == len(core) and all(x and len(x) < 4 and int(x) < 256 for x in parts),
        core.startswith("+"),
        core.startswith("+") and 9 <= n <= 15,
        core.startswith("(") and core.endswith(")"),
        "-" in core and n + core.count("-") == len(core),
        n == 7,
        n > 19,
        any(x.isalpha() for x in core),
        min(len(core), 40) / 40,
    ]


class Field(NamedTuple):
    """Learned potentials; broadcast. A few hundred kilobytes at most, however large the input."""

    shapes: dict[str, int]  #: places of shapes among the features
    words: dict[str, int]
    weights: np.ndarray  #: features x labels
    edges: np.ndarray  #: EDGES x labels x labels, each symmetric

    def values(self, nodes: Nodes) -> np.ndarray:
        """Features of the nodes."""
        out = np.zeros((len(nodes.cores), len(self.weights)), np.float32)
        plain = len(_features("0"))
        for i, core in enumerate(nodes.cores):
            out[i, :plain] = _features(core)
            for place in (self.shapes.get(shape(core)), self.words.get(nodes.before[i])):
                if place is not None:
                    out[i, plain + place] = 1.0
        return out


def _common(values: Iterable[str], most: int, first: int) -> dict[str, int]:
    counts = sorted(((n, x) for x, n in Counter(values).items() if n >= LEAST_SEEN and x), key=lambda x: (-x[0], x[1]))
    return {x: first + i for i, (_, x) in enumerate(counts[:most])}


def _both_ways(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]]), np.concatenate([edges[:, 2], edges[:, 2]])


def fit(texts: list[str], rounds: int = 600) -> Field:
    """Potentials that make what the base patterns label in some texts likely, node by node, given the nodes around.

    Tokens without a base label that repeat a labelled one, or lie in unsure_spans, are unknown, not `other`: they and
    their edges are left out. Every node counts once with its features and once without any, so that edges learn what they tell of a token whose own
    form tells nothing. No text with tokens: all zero.
    """
    rows: list[Nodes] = []
    unsure: list[int] = []
    tokens = 0
    for text in texts:
        if tokens < SAMPLE_TOKENS and len((own := nodes_of(text, base_spans(text))).base):
            rows.append(own)
            for start, end in unsure_spans(text):
                first = _first_after(own.spans, start)
                unsure += [tokens + i for i in range(first, len(own.spans)) if own.spans[i][0] < end and not own.base[i]]
            tokens += len(own.base)
    labels, plain = len(LABELS), len(_features("0"))
    shapes = _common((shape(c) for r in rows for c in r.cores), MOST_SHAPES, 0)
    words = _common((w for r in rows for w in r.before), MOST_WORDS, len(shapes))
    drawn_to = np.zeros((len(EDGES), labels, labels))
    drawn_to[1, range(1, labels), range(1, labels)] = AGREE
    field = Field(shapes, words, np.zeros((plain + len(shapes) + len(words), labels)), drawn_to)
    if not rows:
        return field
    x, y = np.concatenate([field.values(r) for r in rows]), np.concatenate([r.base for r in rows])
    starts = np.cumsum([0, *(len(r.base) for r in rows)])
    joined = np.concatenate([r.edges + np.array([s, s, 0]) for r, s in zip(rows, starts, strict=False)])
    repeats = joined[joined[:, 2] == 1]
    known = np.ones(len(y), bool)
    known[unsure] = False
    for a, b in ((0, 1), (1, 0)):
        known[repeats[(y[repeats[:, a]] == 0) & (y[repeats[:, b]] > 0), a]] = False
    source, target, kind = _both_ways(joined[known[joined[:, 0]] & known[joined[:, 1]]])
    # What surrounds a node: for each kind of edge, how many neighbours have each label.
    around = np.zeros((len(y), len(EDGES), labels), np.float32)
    np.add.at(around, (target, kind, y[source]), 1.0)
    x, y, around = x[known], y[known], around[known].reshape(int(known.sum()), -1)
    # Rows of equal features, surroundings and label are one, with a weight.
    every, count = np.unique(np.concatenate([np.concatenate([x, np.zeros_like(x)]), np.tile(np.column_stack([around, y]).astype(np.float32), (2, 1))], 1), axis=0, return_counts=True)
    inputs, wanted = every[:, :-1], np.eye(labels)[every[:, -1].astype(int)]
    share = (count / count.sum())[:, None]
    centre = np.concatenate([field.weights, drawn_to.reshape(-1, labels)])
    decay = np.repeat([NODE_DECAY, EDGE_DECAY], [len(field.weights), len(EDGES) * labels])[:, None]
    both = centre.copy()
    step, moments = 0.1, [np.zeros_like(both), np.zeros_like(both)]
    for turn in range(1, rounds + 1):
        scores = inputs @ both
        chance = np.exp(scores - scores.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        slope = inputs.T @ ((chance - wanted) * share) + decay * (both - centre)
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        both -= step * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
    tables = both[x.shape[1] :].reshape(len(EDGES), labels, labels)
    return field._replace(weights=both[: x.shape[1]], edges=(tables + tables.transpose(0, 2, 1)) / 2)


def marginals(nodes: Nodes, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Of each token's labels, by damped loopy message passing; tokens of base spans are held to their label."""
    own = (field.values(nodes) @ field.weights).astype(float)
    held = nodes.base > 0
    own[held] = np.where(np.eye(len(LABELS))[nodes.base[held]] > 0, 0.0, -50.0)
    belief = own
    if n := len(nodes.edges):
        source, target, kind = _both_ways(nodes.edges)
        tables = field.edges[kind]
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        messages = np.zeros((2 * n, len(LABELS)))
        for _ in range(rounds):
            sent = (belief[source] - messages[back])[:, :, None] + tables
            top = sent.max(1, keepdims=True)
            new = np.log(np.exp(sent - top).sum(1)) + top[:, 0]
            new = 0.5 * messages + 0.5 * (new - new.max(1, keepdims=True))
            moved, messages = np.abs(new - messages).max(), new
            belief = own.copy()
            np.add.at(belief, target, messages)
            if moved < STILL:
                break
    chance = np.exp(belief - belief.max(1, keepdims=True))
    return chance / chance.sum(1, keepdims=True)


def _begins(kind: str, core: str) -> bool:
    """Whether a token begins a new span after another of its kind: only phone numbers, and cards in short groups, have several."""
    return core.startswith("+") if kind == "phone" else kind != "card" or len(_DIGIT.findall(core)) >= 13


def spans_of(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by kind, then start. Sure tokens side by side make one span if they are parts of one."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    if not (nodes.base == 0).any():
        return base, base
    chance = marginals(nodes, field)
    best = np.where(chance.max(1) >= SURE, chance.argmax(1), 0)
    best[nodes.base > 0] = 0
    beside = {(a, b) for a, b, kind in nodes.edges.tolist() if kind == 0}
    more: list[Span] = []
    for i in np.flatnonzero(best).tolist():
        kind, (start, end) = LABELS[best[i]], nodes.spans[i]
        if more and (i - 1, i) in beside and best[i - 1] == best[i] and not _begins(kind, nodes.cores[i]):
            start = more.pop()[1]
        more.append((kind, start, end))
    return base, sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_MARKS = byte_set((0x30, 0x39), (0x40, 0x40))


def _marked(column: pa.Array) -> np.ndarray:
    """Rows whose text holds a digit or an at sign."""
    found = [np.zeros(0, np.int64)]
    for piece in pieces(column):
        places = np.flatnonzero(_MARKS[piece.data])
        found.append(np.unique(np.searchsorted(piece.bounds, places, "right") - 1) + piece.first)
    return np.concatenate(found)


def learned_field(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """fit() on at most `rows` rows with personal-looking text, of about ten times as many with the smallest hashes.

    Of a text of more than `SAMPLE_CHARS` characters, one stretch of so many is learned from, chosen by hash of those that look
    personal, so what reaches the driver is bounded.
    """
    some = hashed_share(docs.select("doc_id", F.col("text").cast("string").alias("text")), 10 * rows)
    some = some.where(F.col("text").rlike("[0-9@]")).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(rows)
    first = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SAMPLE_CHARS).cast("int"))
    stretches = F.transform(first, lambda i: F.substring("text", i * SAMPLE_CHARS + 1, SAMPLE_CHARS))
    personal = some.select(F.filter(stretches, lambda x: x.rlike("[0-9@]")).alias("parts"), F.xxhash64("doc_id", "text").alias("mark"))
    return fit([x["text"] for x in personal.select(F.get("parts", F.pmod("mark", F.size("parts")).cast("int")).alias("text")).collect()])


def found_spans(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    A null or empty text has no spans. Repeated rows get equal answers; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, sums, told = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n
            for i in _marked(batch.column(1)).tolist():
                base, spans = spans_of(batch.column(1)[i].as_py(), shared.value)
                for kind, count in Counter(x[0] for x in base).items():
                    counts[KINDS.index(kind), i] = count
                sums[i], told[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(sums, pa.string()), pa.array(told, pa.string())], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, {', '.join(f'n_{x} long' for x in KINDS)}, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span in text replaced by its kind; all columns stay, n_chars (if any) is counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place)
            changed = {}
            for i in _marked(texts).tolist():
                text = texts[i].as_py()
                if spans := spans_of(text, shared.value)[1]:
                    changed[i] = redacted(text, spans)
            if changed:
                texts = pa.array([changed.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 :]], names=batch.schema.names)

    out = docs.mapInArrow(tidied(run), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def personal_data(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """found_spans() with a field learned from docs themselves."""
    return found_spans(docs, learned_field(docs, rows))
