"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, repeated rows, extra columns."""

import gzip
import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifold.llm import decontamination as deco
from motifold.llm import hilbert_ann as ann
from motifold.llm import language_id as lid
from motifold.llm import lm_scoring as lm
from motifold.llm import near_dedup as near
from motifold.llm import pii_crf as pii
from motifold.llm import sentencepiece_lattice as sp
from motifold.llm import shared, textbatch, tool_calls, url_trust, warc
from motifold.llm.components import components

SCHEMA = "doc_id long, text string, lang string, n long, v long, label string, word string"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, texts, langs=None):
    """Documents with further columns, some of whose names operators use inside."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, x, 1, 2, "l", "w") for i, (t, x) in enumerate(zip(texts, langs, strict=True))], SCHEMA)


def odd_table(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "  \n", None), (None, "one two three", "en"), (5, "a b c d e f g h i j " * 3000, "en"), (5, "a b c d e f g h i j " * 3000, "en"), (6, "é中𝔘" * 5, "fr"), (7, "x" * 200_000, "en")]
    return spark.createDataFrame([(a, b, c, 1, 2, "l", "w") for a, b, c in rows], SCHEMA)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, words, vocabulary=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(vocabulary)}" for _ in range(words))


# -- words -----------------------------------------------------------------------------------------------------------


def test_words_of_batches():
    own = random.Random(1)
    texts = ["", None, "A b", " x ", "a b\x0bc", *("".join(own.choice("aB é\n\t.𝔘") for _ in range(own.randrange(30))) for _ in range(500))]
    for kind, pattern in ((textbatch.SPACED, r"[^\x20\x09-\x0D]+"), (textbatch.WORDY, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen: dict = {}
        at = 0
        for piece in textbatch.pieces(pa.array(texts), 200):
            found = textbatch.words(piece, kind)
            for row, (a, b) in enumerate(zip(found.rows[:-1], found.rows[1:], strict=True)):
                plain = re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[at + row] or ""))
                assert len(plain) == b - a
                for word, h in zip(plain, found.hashes[a:b].tolist(), strict=True):
                    assert seen.setdefault(word, h) == h
            at += len(found.rows) - 1
        assert at == len(texts) and len(set(seen.values())) == len(seen)


# -- 1 ---------------------------------------------------------------------------------------------------------------


def brute_losses(texts, chosen, order=lm.ORDER, prior=lm.PRIOR):
    counts = [[Counter() for _ in range(order + 1)] for _ in "bt"]
    split = lambda t: [(b"\0" * (order - 1) + t.encode())[i : i + order] for i in range(len(t.encode()))]
    for i, t in enumerate(texts):
        for gram in split(t or ""):
            for m in (0, 1) if i in chosen else (0,):
                for k in range(1, order + 1):
                    counts[m][k][gram[order - k :]] += 1
    after = [[Counter() for _ in range(order + 1)] for _ in "bt"]
    for m in (0, 1):
        for k in range(1, order + 1):
            for gram, n in counts[m][k].items():
                after[m][k][gram[:-1]] += n

    def loss(m, gram):
        p = 1 / 256
        for k in range(1, order + 1):
            own = gram[order - k :]
            p = (counts[m][k][own] + prior * p) / (after[m][k][own[:-1]] + prior)
        return -math.log(p)

    return [[sum(loss(m, g) for g in split(t or "")) / max(1, len(split(t or ""))) for m in (0, 1)] for t in texts]


@pytest.mark.parametrize("block", [lm.BLOCK_BYTES, 1, 400])
def test_cross_entropy_difference(spark, block):
    texts = [prose(i, 20, 30) for i in range(12)] + ["", None, "é中𝔘"]
    targets = spark.createDataFrame([(1,), (1,), (3,), (99,), (None,)], "doc_id long")
    found = {r.doc_id: r for r in lm.cross_entropy_difference(table(spark, texts), targets, block_bytes=block).collect()}
    for i, (b, t) in enumerate(brute_losses(texts, {1, 3})):
        if texts[i]:
            assert (found[i].loss_background, found[i].loss_target, found[i].score) == pytest.approx((b, t, t - b), abs=1e-9)
        else:
            assert found[i].n_tokens == 0 and found[i].score is None


@pytest.mark.parametrize("block", [lm.BLOCK_BYTES, 1, 400])
def test_cross_entropy_null_and_repeated_ids(spark, block):
    texts = [prose(i, 20, 30) for i in range(12)]
    texts = [*texts, texts[4], texts[4], texts[5][::-1], texts[6], texts[7], texts[7][::-1], "", None]
    ids = [*range(12), 4, 4, 5, *[None] * 5]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1,), (4,)], "doc_id long")
    found = lm.cross_entropy_difference(docs, targets, block_bytes=block).collect()
    losses = brute_losses(texts, {i for i, x in enumerate(ids) if x in (1, 4)})
    order = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    wanted = sorted(((i, len((x or "").encode()), *((t, b) if x else (-1, -1))) for i, x, (b, t) in zip(ids, texts, losses, strict=True)), key=order)
    got = sorted(((r.doc_id, r.n_tokens, *((r.loss_target, r.loss_background) if r.n_tokens else (-1, -1))) for r in found), key=order)
    assert len(got) == len(wanted) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9) for a, b in zip(got, wanted, strict=True))
    assert all((r.score is None) == (r.n_tokens == 0) for r in found)


def test_cross_entropy_odd(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm.cross_entropy_difference(odd_table(spark), none).count() == 8
    assert lm.cross_entropy_difference(empty_table(spark), none).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------------


def made_up(language, seed, words):
    own = random.Random(f"{language}{seed}")
    parts = {"en": ["th", "ing", "and", "er", "on"], "fr": ["é", "eau", "ou", "que", "ai"], "ru": ["ст", "но", "ен", "ов", "пр"]}[language]
    return " ".join("".join(own.choice(parts) for _ in range(own.randrange(1, 4))) for _ in range(words))


def test_language_held_out(spark):
    langs = ["en", "fr", "ru"] * 60
    docs = table(spark, [made_up(x, i, 8) for i, x in enumerate(langs)], langs)
    found = lid.language_predictions(docs).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    # held-out labels are not looked at
    other = docs.withColumn("lang", F.when(lid.held_out(), "zz").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in lid.language_predictions(other).collect()} == {(r.doc_id, r.lang_pred) for r in found}


def test_language_grams_by_hand():
    plain = Counter()
    for word in re.findall(r"[^\W\d_]+", "Ab, aß 1é".lower()):
        marked = f"_{word}_"
        plain.update([word[i : i + 1] for i in range(len(word))] + [marked[i : i + 2] for i in range(len(word) + 1)] + [marked[i : i + 3] for i in range(len(word))])
    keys, counts = np.unique(lid.grams("Ab, aß 1é"), return_counts=True)
    assert sorted(counts) == sorted(plain.values()) and len(keys) == len(plain)


def brute_language(text, learned, ranks):
    """Language and score by the definitions: learned has texts by language."""

    def ordered(texts):
        keys, counts = np.unique(np.concatenate([lid.grams(x) for x in texts]), return_counts=True)
        return [int(k) for _, k in sorted(zip(-counts, keys, strict=True))][:ranks]

    own = ordered([text])
    best = None
    for language in sorted(learned):
        profile = {k: i for i, k in enumerate(ordered(learned[language]))}
        away = sum(abs(i - profile[k]) if k in profile else ranks for i, k in enumerate(own))
        if best is None or away < best[0]:
            best = away, language
    return best[1], 1 - best[0] / (ranks * len(own))


@pytest.mark.parametrize("ranks", [5, 40, lid.RANKS])
def test_language_distances(spark, ranks):
    langs = ["en", "fr", "ru"] * 40
    texts = [made_up(x, i, 5) for i, x in enumerate(langs)]
    docs = table(spark, [*texts, "x", "th", "漢字", "thing eau", "Ab ab"], [*langs, *[None] * 5]).repartition(3)
    # Two languages with the same texts: ties.
    docs = docs.union(docs.where("lang = 'en' and doc_id % 2 = 0").withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit("aa")}))
    given = docs.collect()
    learned = defaultdict(list)
    for r in given:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            learned[r.lang].append(r.text)
    found = {r.doc_id: (r.lang_pred, r.score) for r in lid.language_predictions(docs, ranks).collect()}
    assert len(found) == len(given)
    for r in given:
        language, score = brute_language(r.text, learned, ranks)
        assert found[r.doc_id] == (language, pytest.approx(score, abs=1e-12))


def test_language_ties_go_to_the_first_name(spark):
    docs = table(spark, ["one two", "one two", "one"], ["zz", "aa", None])
    assert {r.lang_pred for r in lid.identified(docs, lid.learn(docs)).collect()} == {"aa"}


def test_language_of_foreign_letters(spark):
    langs = ["en", "fr", "ru"] * 20
    profiles = lid.learn(table(spark, [made_up(x, i, 8) for i, x in enumerate(langs)], langs))
    found = [(r.lang_pred, r.score) for r in lid.identified(table(spark, ["漢字", "ж́ 12", "12 !", "", None]), profiles).sort("doc_id").collect()]
    assert found[0] == ("en", 0) and found[1][0] != lid.UNKNOWN and found[2:] == [(lid.UNKNOWN, 0)] * 3


def test_language_odd(spark):
    found = {r.doc_id: r for r in lid.language_predictions(odd_table(spark)).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == lid.UNKNOWN and found[1].score == 0
    assert lid.language_predictions(empty_table(spark)).count() == 0
    assert {r.lang_pred for r in lid.language_predictions(table(spark, ["abc"] * 3, [None] * 3)).collect()} == {lid.UNKNOWN}


# -- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sp.load_model(MODEL)


def test_encoding_is_the_library_s(spark, model):
    from sentencepiece import SentencePieceProcessor

    own = random.Random(4)
    texts = ["", " ", "  a b", "a\n\nb\tc", "x ", "日本語 𝔘", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x00a", "of the" * 40]
    texts += ["".join(own.choice("abcdeé \n日𝔘的 the.,!") for _ in range(own.randrange(60))) for _ in range(400)]
    docs = table(spark, texts)
    ids = {r.doc_id: r.ids for r in sp.encoded(docs, model).collect()}
    library = SentencePieceProcessor(model_file=MODEL)
    assert all(ids[i] == library.encode(t) for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sp.decoded(sp.encoded(docs, model), model).collect()}
    assert all(back[i] == t for i, t in enumerate(texts))
    told = {r.doc_id: r for r in sp.encoding_report(docs, model).collect()}
    for i in ids:
        assert told[i].n_pieces == len(ids[i]) and told[i].round_trip
        assert told[i].ids_sha256 == hashlib.sha256(np.array(ids[i], "<i4").tobytes()).hexdigest()


def test_encoding_by_a_unigram_model(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    own, proto = random.Random(14), ModelProto()
    for i, name in enumerate(["<unk>", "<s>", "</s>"]):
        proto.pieces.add(piece=name, score=0, type=2 if i == 0 else 3)
    for i in range(256):
        proto.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    words = ["▁", "a", "b", "d", "ab", "ba", "▁a", "▁ab", "abc", "abab", "bab", "▁ba", "cd", "dé"]  # c and é are no pieces alone
    for i, x in enumerate(words):
        proto.pieces.add(piece=x, score=-1.0 - own.random() * len(x) - i * 0.01)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, True
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = "identity", False, True
    (tmp_path / "toy.model").write_bytes(proto.SerializeToString())
    library, toy = SentencePieceProcessor(model_file=str(tmp_path / "toy.model")), sp.load_model(str(tmp_path / "toy.model"))
    texts = ["", " ", "abcab", "ccc", "dé dé", *("".join(own.choice("aabbcd  é日") for _ in range(own.randrange(40))) for _ in range(400))]
    ids = {r.doc_id: r.ids for r in sp.encoded(table(spark, texts), toy).collect()}
    assert all(ids[i] == library.encode(t) for i, t in enumerate(texts))


def test_encoding_odd(spark, model):
    rows = sp.encoded(odd_table(spark), model).collect()
    assert [r.ids for r in rows if r.text is None] == [None] and [r.ids for r in rows if r.text == ""] == [[]]
    assert sp.encoding_report(odd_table(spark), model).where("round_trip").count() == 8
    assert sp.encoded(empty_table(spark), model).count() == 0
    assert sp.encoding_report(table(spark, ["a▁b"]), model).first().ids_sha256 == sp.encoding_report(table(spark, ["a b"]), model).first().ids_sha256


# -- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(16, 2), (8, 3)])
def test_hilbert_curve_has_unit_steps(shape):
    side, dimensions = shape
    grid = np.array(np.meshgrid(*[range(side)] * dimensions)).reshape(dimensions, -1).T
    keys = ann.hilbert_keys(grid, side.bit_length() - 1)
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert sorted(keys) == list(range(side**dimensions)) and set(steps) == {1}


def brute_nearest(vectors, query, k=10):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    away = np.sqrt(((x - np.array(vectors[query], float)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, away)) if ids[i] != query][:k]
    return [(int(ids[i]), float(away[i])) for i in order]


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall(spark, kind):
    own = np.random.default_rng(2)
    x = own.standard_normal((1500, 16)) * (1 if kind == "even" else 0.05)
    if kind == "clustered":
        x += own.standard_normal((30, 16))[own.integers(0, 30, 1500)]
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    found = defaultdict(list)
    for r in ann.nearest(vector_frame(spark, vectors.items()), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert len(found) == 15 and all(len(v) == 10 for v in found.values())
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in brute_nearest(vectors, q)}) for q in found)
    assert hits >= 0.9 * 150
    for q, rows in found.items():
        true = dict(brute_nearest(vectors, q, 1500))
        assert all(s == pytest.approx(true[v], abs=1e-12) for v, s in rows)


@pytest.mark.parametrize("bytes_", [2000, 20_000, ann.BLOCK_BYTES])
def test_runs_of_cells(spark, monkeypatch, bytes_):
    """Many cells, in runs and blocks of any size: whole windows find all, others most of it."""
    monkeypatch.setattr(ann, "CELL_ROWS", 8)
    x = np.random.default_rng(5).standard_normal((1200, 6)).astype(np.float32)
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    asks = F.col("vec_id") % 30 == 0
    whole = defaultdict(list)
    for r in ann.nearest(vector_frame(spark, vectors.items()), asks, target=2.0, block_bytes=bytes_).orderBy("query_id", "rank").collect():
        whole[r.query_id].append(r.vec_id)
    assert {q: [v for v, _ in brute_nearest(vectors, q)] for q in range(0, 1200, 30)} == whole
    some = ann.nearest(vector_frame(spark, vectors.items()), asks, block_bytes=bytes_).collect()
    assert sum(r.vec_id in whole[r.query_id] for r in some) >= 0.9 * 400


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (100, [0.0, 2.0]), (None, [1.0, 1.0])]
    found = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(vector_frame(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 2), (100, 2, 0), (100, 3, 1)]
    assert ann.nearest(vector_frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(vector_frame(spark, [(3, [1.0]), (5, [2.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(6000)] + [(10_000, [1.0, 2.0, 3.5])]
    found = ann.nearest(vector_frame(spark, rows), F.col("vec_id") == 10_000).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(10))


def test_one_id_of_most_rows(spark):
    for rows in ([(1, [float(i), 1.0, 0.0]) for i in range(9000)], [(1, [5.0, 1.0, 0.0])] * 9000):
        found = ann.nearest(vector_frame(spark, [*rows, (100, [5.25, 1.0, 0.0])]), F.col("vec_id") % 100 == 0).collect()
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(100, 1, 1, 0.25)]


# -- 5 ---------------------------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and double % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]


def test_base_patterns():
    own = random.Random(5)
    for _ in range(20_000):
        text = "".join(own.choice("ab@@..+-1234567890 ()_%0é") for _ in range(own.randrange(50)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4539 1488 0343 6467 x") == [("card", 0, 19)]
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}1.2.3.{zeros}") == [("ip", 0, 10006)] and pii.base_spans(f"{zeros}256.2.3.4") == []


def test_field_spreads_labels(spark):
    text = "mail that.30@mail1.example.com or +1 (377) 555-0271 now. Later that.30 and 377-555-0271. An order 1234567890123456 twice 1234567890123456."
    plain = [f"write to u{i}@mail.example.com or call +1 (377) 555-0{100 + i}; also 10.0.0.{i}, item {i}, number {10**15 + i}" for i in range(200)]
    found = {r.doc_id: r for r in pii.personal_data(table(spark, [*plain, text, None, ""])).collect()}
    row = found[200]
    base = brute_spans(text)
    assert (row.n_email, row.n_phone, row.n_card) == (1, 1, 0)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    more = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in row.spans.split(",")) if (k, int(a), int(b)) not in base]
    assert "377-555-0271" in more and not any("1234567890123456" in x for x in more)
    assert found[201].spans == found[202].spans == "" and found[201].base_sha256 == hashlib.sha256(b"").hexdigest()


def enumerated(own, edges, tables):
    """Marginals by all labellings."""
    labels = own.shape[1]
    out = np.zeros_like(own)
    for y in itertools.product(range(labels), repeat=len(own)):
        weight = math.exp(sum(own[i, y[i]] for i in range(len(own))) + sum(tables[k, y[a], y[b]] for a, b, k in edges))
        for i, x in enumerate(y):
            out[i, x] += weight
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("loop", [False, True])
def test_marginals_are_those_of_all_labellings(loop):
    random = np.random.default_rng(8)
    labels, plain = len(pii.LABELS), len(pii._features("0"))
    for _ in range(10):
        edges = [(0, 1, 0), (1, 2, 1), (1, 3, 2), (3, 4, 0)] + ([(0, 2, 1)] if loop else [])
        tables = random.standard_normal((3, labels, labels)) * (0.3 if loop else 1.5)
        tables = (tables + tables.transpose(0, 2, 1)) / 2
        base = np.array([0, 0, random.integers(0, labels), 0, 0])
        nodes = pii.Nodes([(i, i + 1) for i in range(5)], [str(10**i) for i in range(5)], [""] * 5, base, np.array(edges))
        field = pii.Field({}, {}, random.standard_normal((plain, labels)), tables)
        own = (field.values(nodes) @ field.weights).astype(float)
        own[base > 0] = np.where(np.eye(labels)[base[base > 0]] > 0, 0.0, -50.0)
        assert pii.marginals(nodes, field, 500) == pytest.approx(enumerated(own, edges, tables), abs=0.03 if loop else 1e-4)


def test_field_finds_what_patterns_drop(spark):
    own = random.Random(9)
    number = lambda ok: next(str(n) for n in iter(lambda: own.randrange(10**15, 10**16), None) if pii.luhn(str(n)) == ok)
    phone = lambda: f"+1 ({own.randrange(100, 999)}) 555-{own.randrange(1000, 9999)}"
    plain = [f"{prose(i, 3)} {number(True)} {prose(i, 3)} {number(False)} or {phone()} {prose(i, 2)} 10.{i}.3.4 end" for i in range(200)]
    plain = [re.sub("w([0-9]+)", lambda m: "w" + "abcdefghij"[int(m[1]) % 10] * (1 + int(m[1]) % 7), x) for x in plain]
    lost = [f"pay {number(True)} {number(True)} now", f"call {phone()} 190.137.223.204 now", f"two {number(False)} {number(False)} here"]
    texts = [*plain, *lost]
    found = {r.doc_id: r for r in pii.personal_data(table(spark, texts)).collect()}
    spans = lambda i: [(k, texts[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in found[i].spans.split(",") if x)]
    assert [found[200 + i].n_card for i in range(3)] == [0, 0, 0] and found[201].n_phone == 0
    assert spans(200) == [("card", x) for x in lost[0].split()[1:3]]
    assert spans(201) == [("ip", "190.137.223.204"), ("phone", lost[1][5:22])] and spans(202) == []
    assert all(len(spans(i)) == 3 for i in range(200))


def test_redaction(spark):
    docs = table(spark, ["a b@c.de f", "clean 12", None]).withColumn("n_chars", F.length("text"))
    found = {r.doc_id: r for r in pii.redact(docs, pii.learned_field(docs)).collect()}
    assert found[0].text == "a <EMAIL> f" and found[0].n_chars == 11 and found[1].text == "clean 12" and found[2].text is None
    assert pii.personal_data(odd_table(spark)).count() == 8 and pii.personal_data(empty_table(spark)).count() == 0


# -- 6 ---------------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_report(texts, items, window=10):
    out = []
    for text in texts:
        own, hit, ids = plain_words(text), set(), set()
        for name, item in items:
            words = plain_words(item)
            for i in range(max(1, len(words) - window + 1)) if words else ():
                part = words[i : i + window]
                for at in range(len(own) - len(part) + 1):
                    if own[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        ids.add(str(name))
        out.append((len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [deco.BLOCK_WORDS, 40, 7])
def test_contamination(spark, block):
    own = random.Random(6)
    items = [(70, prose(1, 90, 12).replace(" ", ".")), (70, prose(1, 90, 12).replace(" ", ".")), (71, "W1, w2.W3")]
    items += [(i, prose(i, own.choice([1, 3, 9, 10, 11, 30]), 12)) for i in range(12)] + [(50, None), (51, " . "), (52, prose(1, 30, 12))]
    texts = [prose(100 + i, 60, 12) for i in range(25)] + [items[5][1].upper() + "! x", prose(1, 30, 12) + " " + prose(2, 200, 5000), None, "", "w1"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: tuple(r)[1:6] for r in deco.contamination_report(table(spark, texts), benchmark, block_words=block).collect()}
    assert [found[i] for i in range(len(texts))] == brute_report(texts, items)


def test_cutting(spark):
    item, other = prose(7, 30, 10_000), prose(8, 200, 10_000)
    half = other.split()
    texts = [" ".join([*half[:100], item, *half[100:]]), item, other, None, " ".join([*item.split()[:12], "z", *half])]
    docs = table(spark, texts).withColumn("n_chars", F.length("text"))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r for r in deco.decontaminated(docs, benchmark).collect()}
    assert sorted(found) == [0, 2, 3, 4] and found[2].text == other and found[3].text is None
    assert plain_words(found[0].text) == half and found[0].n_chars == len(found[0].text)
    assert plain_words(found[4].text) == ["z", *half]
    assert not any(r.contaminated for r in deco.contamination_report(spark.createDataFrame(list(found.values()), docs.schema), benchmark).collect())


def test_cutting_by_several_automata(spark):
    items = [prose(300 + i, 30, 10_000) for i in range(8)]
    pairs = [(a, b) for a in range(8) for b in range(8) if a != b]
    mostly = [f"{items[a]} {items[b]} {prose(400 + 10 * a + b, 40, 10_000)}" for a, b in pairs]  # 0.3 and 0.3 hit
    within = lambda a, b: " ".join([*items[a].split()[:5], items[b], *items[a].split()[5:10]])
    texts = mostly + [f"{within(a, b)} {prose(500 + 10 * a + b, 100, 10_000)}" for a, b in pairs] + [None, "", "clean"]
    docs = table(spark, texts).withColumn("hits", F.lit("own"))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r.doc_id: r for r in deco.decontaminated(docs, benchmark, block_words=40).collect()}
    assert sorted(found) == [*range(len(pairs), len(texts))]
    assert all(plain_words(found[len(pairs) + i].text) == prose(500 + 10 * a + b, 100, 10_000).split() for i, (a, b) in enumerate(pairs))
    whole = {r.doc_id: r for r in deco.decontaminated(docs, benchmark).collect()}
    assert found == whole


def test_field_learns_from_any_stretch(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", seen.extend)
    monkeypatch.setattr(pii, "SAMPLE_CHARS", 50)
    texts = ["x" * 120 + " write to a@b.cd " + "y" * 100, "z" * 500, "short 12", None, " ".join(f"{i:04d}" for i in range(100))]
    pii.learned_field(table(spark, texts))
    assert len(seen) == 3 and all(len(x) <= 50 for x in seen) and "short 12" in seen and any("a@b.cd" in x for x in seen)


def test_forty_automata(spark, monkeypatch):
    """One Python node scans with all, of which a task holds one; so it does when texts come in several lots."""
    items = [prose(700 + i, 12, 10_000) for i in range(40)]
    texts = [f"{prose(800 + i, 30, 10_000)} {items[i % 40]} {items[(i + 7) % 40]}" for i in range(60)] + [None, "", "clean"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(deco, "SCAN_BYTES", 2000)
    found = deco.contamination_report(table(spark, texts), benchmark, block_words=12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert len(deco.Automata(spark, deco._automata(benchmark, deco.WINDOW, 12)).names) == 40
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, deco.contamination_report(table(spark, texts), benchmark).collect()))
    assert found.where("n_hit = 24 AND n_items = 2").count() == 60


def test_contamination_odd(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert deco.contamination_report(odd_table(spark), none).where("n_hit = 0").count() == 8
    assert deco.contamination_report(empty_table(spark), none).count() == 0
    one = spark.createDataFrame([(None, "one two three")], "item_id long, text string")
    assert deco.contamination_report(odd_table(spark), one).where("n_hit = 3").count() == 1


# -- 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("version", ["1", "2"])
def test_archived_pages(spark, version):
    rows = [(5, "http://a b/\n", "<p>é</p>"), (3, "http://x/", "<p>é</p>"), (4, None, None), (9, "", ""), (9, "", ""), (7, "http://y/", "WARC/1.0\r\n\r\n\r\n\r\nContent-Length: 3"), (None, "u", "<p>é</p>"), (None, "u", "only")]
    pages = spark.createDataFrame([(a, b, c, "k") for a, b, c in rows], "page_id long, url string, html string, mark string")
    found = sorted((tuple(r) for r in warc.archived_pages(pages, version).collect()), key=str)
    plain = lambda x: ((x or "").encode(), __import__("base64").b32encode(hashlib.sha1((x or "").encode()).digest()).decode())
    first: dict = {}
    for a, _, c in rows:
        if a is not None:
            first[c or ""] = min(a, first.get(c or "", a))
    expected = []
    for a, _, c in rows:
        body, told = plain(c)
        revisit = (c or "") in first and first[c or ""] != a
        expected.append((a, len(body), told, "revisit" if revisit else "response", first[c or ""] if revisit else None))
    assert found == sorted(expected, key=str)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_archives_are_bounded(spark, tmp_path):
    pages = [(str(i), None, b"http://h/%d 0.0.0.0 2001 text/html %d\n" % (i, n) + b"x" * n) for i, n in enumerate([10, 5000, 20, 30, 9000, 40, 50, 60])]
    arcs = spark.createDataFrame(pages, "key string, refers_to string, content binary").coalesce(1)
    warc.write_warc(arcs, str(tmp_path / "w"), 2000)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")]
    assert sorted(len(list(warc.warc_records(f))) for f in files) == [2, 3, 3] and all(f.endswith(b"\r\n\r\n") for f in files)
    back = {r.key: r.payload_bytes for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {k: len(c) - c.index(b"\n") - 1 for k, _, c in pages}


def test_arc_versions():
    one = b"filedesc://a.arc 0.0.0.0 2001 text/plain 9\n1 0 Org\nx\nhttp://h/a b 1.2.3.4 20010203 text/html 5\nhello\nhttp://h/2 1.2.3.4 20010203040506 text/plain 0\n\n"
    found = list(warc.arc_records(one))
    assert [(r.url, r.block) for r in found] == [("http://h/a b", b"hello"), ("http://h/2", b"")]
    two = b"filedesc://a.arc 0.0.0.0 2001 text/plain 200 - - 0 a.arc 8\n2 0 Org\nhttp://h/ 1.2.3.4 2001 text/html 200 - - 0 a.arc 5\nhello\n"
    with pytest.raises(ValueError):
        list(warc.arc_records(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"no header\n"))
    assert [r.block for r in warc.arc_records(gzip.compress(one[:50]) + gzip.compress(one[50:]))] == [b"hello", b""]
    assert two and warc.warc_date("200102") == "2001-02-01T00:00:00Z"
    record = next(warc.warc_records(warc.warc_record(found[0], "k") + b"\r\n\r\n"))
    assert record.headers["warc-type"] == "resource" and record.block == b"hello" and record.headers["warc-date"] == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.warc_records(warc.warc_record(found[0], "k")))


# -- 8 ---------------------------------------------------------------------------------------------------------------


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def edited(text, seed, share):
    own = random.Random(seed)
    return " ".join(f"e{seed}x{own.random()}" if own.random() < share else w for w in text.split())


def test_near_duplicates(spark):
    base = [prose(900 + i, 120, 10_000) for i in range(5)]
    texts = [edited(base[i % 5], i, (i % 9) * 0.01) for i in range(150)]  # similarities around the threshold
    passage = prose(77, 60, 10_000)
    texts += [passage + " " + prose(2000 + i, 15 + i % 20, 10_000) for i in range(60)]  # a passage that many share
    texts += [base[0], base[0].upper(), "a b", "A  b", "a b c", "", None, " ", prose(5, 3000), prose(5, 3000) + " z"]
    found = sorted(tuple(r) for r in near.near_duplicates(table(spark, texts).repartition(3)).collect())
    assert found == brute_components(texts)


def test_near_duplicates_odd(spark):
    found = near.near_duplicates(odd_table(spark)).collect()
    assert len(found) == 8 and all(r.component_id == r.doc_id for r in found if r.doc_id is not None)
    alone = next(r for r in found if r.doc_id is None)
    assert alone.component_id is None and alone.kept and alone.n_shingles == 1
    assert near.near_duplicates(empty_table(spark)).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d = (prose(600 + i, 60, 10_000) for i in range(4))
    rows = [(5, a), (5, b), (3, b), (5, a), (None, c), (None, c), (None, c + " z"), (None, a), (None, ""), (None, ""), (7, d), (7, d + " z"), (9, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    found = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    kept_c, kept_d = [x for x in found if x[1] in (c, c + " z")], [x for x in found if x[0] == 7]
    assert len(kept_c) == len(kept_d) == 1
    assert found == Counter([(5, a), (3, b), (None, ""), (None, ""), (9, ""), (8, None), *kept_c, *kept_d])
    told = Counter((r.doc_id, r.component_id, r.kept) for r in near.near_duplicates(docs).collect())
    assert told == Counter([(5, 5, True), (5, 5, True), (5, 3, False), (3, 3, True), (None, 5, False), *[(None, None, True)] * 5, *[(7, 7, True)] * 2, (9, 9, True), (8, 8, True)])


def test_long_lists_of_unlinked_classes(spark, monkeypatch):
    """Long lists are split and dealt; links within them stay."""
    monkeypatch.setattr(shared, "FEW_ROWS", 100)
    monkeypatch.setattr(near, "LONG_LIST", 8)
    monkeypatch.setattr(near, "BLOCK", 16)
    own = random.Random(12)
    slots = [[f"s{i}x{k}" for k in range(3)] for i in range(40)]
    texts = [" ".join(own.choice(x) if own.random() < 0.5 else x[0] for x in slots) for _ in range(120)]  # alike, most of them unlinked
    passage = prose(78, 50, 10_000)
    texts += [f"{passage} {prose(3000 + i // 2, 12 + i % 2, 10_000)}" for i in range(80)]  # a passage of all, pairs nearly equal
    texts += [texts[0], texts[130] + " end"]
    found = sorted(tuple(r) for r in near.near_duplicates(table(spark, texts).repartition(3)).collect())
    assert found == brute_components(texts)


@pytest.mark.parametrize("few", [shared.FEW_ROWS, 10])
def test_components_of_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "FEW_ROWS", few)
    monkeypatch.setattr("motifold.llm.components.FEW_ROWS", few)
    # A hub with the largest number, one with the smallest, and a chain between them.
    edges = [(i, 10_000) for i in range(2000, 4000)] + [(0, i) for i in range(5000, 7000)] + [(2500, 5500), (8000, 8001), (8001, 8001)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {**dict.fromkeys([*range(2000, 4000), *range(5000, 7000), 10_000, 0], 0), 8000: 8000, 8001: 8000}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------------------------


def brute_ranks(links, seeds, rounds=url_trust.ROUNDS):
    rank = {s: 1 / len(seeds) for s in seeds}
    base = {s: 0.15 / len(seeds) for s in seeds}
    out = Counter(a for a, _ in links)
    for _ in range(rounds):
        new = Counter(base)
        for a, b in links:
            new[b] += 0.85 * rank.get(a, 0) / out[a]
        rank = new
    return rank


def test_url_verdicts(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [
        (1, "https://Good.ORG/a?b", link("m.net", "n.net", "good.org")), (2, "http://m.net/p", link("N.net")), (3, "http://spam.example.org/es/1", link("x.net")),
        (4, "http://x.net/", link("spam.example.org")), (5, "http://y.net", link("x.net")), (6, None, None), (7, "no scheme", None), (8, "http://z.net/?q", None),
        (9, "http://a.example.org/en/12", None), (10, "http://shop.com/de/1", None), (11, "http://shop.com/fr/1#x", None), (12, "http://notorg/es/", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    found = {r.page_id: r for r in url_trust.judged_urls(pages, domains=False).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("good.org", "/a", "org/", "allow")
    assert (found[3].rule, found[9].rule, found[10].rule, found[11].rule) == ("example.org/es/", "example.org/en/1", "com/de/", "com/fr/")
    assert [found[i].verdict for i in (3, 9, 10, 11)] == ["block", "block", "block", "allow"]
    links = {("good.org", "m.net"), ("good.org", "n.net"), ("m.net", "n.net"), ("spam.example.org", "x.net"), ("x.net", "spam.example.org"), ("y.net", "x.net")}
    trust = brute_ranks(links, ["good.org", "shop.com"])
    distrust = brute_ranks({(b, a) for a, b in links}, ["spam.example.org", "a.example.org", "shop.com"])
    for i in (2, 4, 5, 8, 12):
        host = found[i].host
        assert found[i].rule is None and found[i].verdict == ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow")
    assert found[5].verdict == "block" and found[2].verdict == "allow"
    assert (found[6].host, found[6].path, found[6].verdict) == ("", "", "allow") == (found[7].host, found[7].path, found[7].verdict)
    assert url_trust.judged_urls(pages.limit(0)).count() == 0


def test_url_verdicts_of_small_ranks(spark):
    # Twelve hops from a seed, each to a host among ten: ranks around 1e-13.
    link = lambda host: f'<a href="http://{host}/">'
    to_bad = [(f"side{i}x{k}.net" if k else f"h{i}.net", "bad.example.org" if i == 1 else f"h{i - 1}.net") for i in range(1, 13) for k in range(10)]
    from_good = [("good.org" if i == 1 else f"g{i - 1}.net", f"fork{i}x{k}.net" if k else f"g{i}.net") for i in range(1, 13) for k in range(10)]
    seeds = [("http://bad.example.org/es/", ""), ("http://good.org/", "")]
    rows = seeds + [(f"http://{a}/", link(b)) for a, b in to_bad] + [(f"http://{a}/", link(b)) for a, b in from_good] + [("http://g12.net/", ""), ("http://far.net/", "")]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    found = {r.host: r.verdict for r in url_trust.judged_urls(pages, domains=False).collect() if r.rule is None}
    blocked = {a for a, _ in to_bad}
    assert blocked == {host for host, verdict in found.items() if verdict == "block"} and found["g12.net"] == found["far.net"] == "allow"


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False)}}
    rows = [
        (1, 0, "assistant", "call", "c1", "add", '{"b": 2.5, "a": 1}', None), (1, 1, "tool", "result", "c1", None, None, "3"), (1, 2, "tool", "result", "c2", None, None, "early"),
        (1, 3, "assistant", "call", "c2", "add", '{"a": "x"}', None), (1, 4, "assistant", "call", "c3", "add", '{"a": 1, "z": 0}', None), (1, 5, "assistant", "call", "c4", "add", "{bad", None),
        (1, 6, "assistant", "call", "c5", "other", "{}", None), (2, 0, "tool", "result", "c1", None, None, "other conversation"), (1, 7, "user", "message", None, None, None, None), (1, 8, "tool", "result", None, None, None, "x"),
        (1, 9, "assistant", "call", "c6", "add", '{"a": null}', None), (1, 10, "assistant", "call", "c7", "add", None, None), (1, 11, "assistant", "call", "c1", "add", '{"a": 2}', None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, turn long, role string, kind string, call_id string, tool string, arguments string, content string")
    found = {(r.conv_id, r.turn): r for r in tool_calls.linked(events, schemas).collect()}
    assert len(found) == len(rows)
    assert [found[1, t].linked for t in (0, 1, 2, 3, 4, 8, 11)] == [True, True, True, True, False, False, False] and not found[2, 0].linked
    assert json.loads(found[1, 5].message)["arguments"] == "{bad" and "arguments" not in json.loads(found[1, 10].message)
    assert [found[1, t].valid for t in (0, 3, 4, 5, 6, 9, 10)] == [True, False, False, False, False, False, False] and found[1, 1].valid is None
    order = sorted(found.values(), key=lambda r: (r.conv_id, r.order_turn, r.order_phase, r.turn))
    places = {(r.conv_id, r.turn): i for i, r in enumerate(order)}
    assert places[1, 0] < places[1, 1] and places[1, 3] < places[1, 2]
    told = json.loads(found[1, 0].message)
    assert told["arguments"] == {"a": 1, "b": 2.5} and found[1, 0].message.startswith('{"arguments":{"a":1,"b":2.5},"call_id":"c1"')


def test_tool_call_levels(spark):
    """A chain, a fork, a cycle, what waits for a cycle, and a parent that isn't there; nested arguments."""
    schemas = {"f": {"x": ({"y": ("array<integer>", True), "z": ("string", False)}, True)}}
    fine, long = '{"x": {"y": [1, 2]}}', 40
    calls = [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("t", "t"), ("u", "gone"), *((f"n{i}", f"n{i - 1}" if i else None) for i in range(long))]
    rows = [(1, 100 - i, "call", name, parent, "f", fine) for i, (name, parent) in enumerate(calls)]
    rows += [(1, 200 - i, "result", name, None, None, None) for i, (name, _) in enumerate(calls)] + [(2, 1, "call", "b", "a", "f", fine), (1, 7, "message", None, None, None, None)]
    events = spark.createDataFrame(rows, "conv_id long, turn long, kind string, call_id string, parent_id string, tool string, arguments string").withColumns({"role": F.lit("x"), "content": F.lit(None).cast("string")})
    found = tool_calls.linked(events.repartition(3), schemas).collect()
    assert len(found) == len(rows)
    level = {(r.conv_id, r.call_id): r.level for r in found if r.kind == "call"}
    assert level == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 1, **{(1, x): -1 for x in "pqrst"}, (1, "u"): 0, (2, "b"): 0, **{(1, f"n{i}"): i for i in range(long)}}
    assert all(r.valid == (r.level >= 0) for r in found if r.kind == "call") and all(r.linked for r in found if r.conv_id == 1 and r.call_id)
    order = sorted(found, key=lambda r: (r.conv_id, r.order_turn, r.level, r.order_phase, r.turn))
    place = {(r.conv_id, r.kind, r.call_id): i for i, r in enumerate(order)}
    for name, parent in calls:
        assert place[1, "call", name] < place[1, "result", name]
        if parent and level[1, name] > 0:
            assert place[1, "result", parent] < place[1, "call", name]
    odd = ['{"x": {"y": [1, "2"]}}', '{"x": {"y": 1}}', '{"x": {"y": [], "z": 3}}', '{"x": {"y": [], "w": 3}}', '{"x": [1]}', '{"x": {"z": "a"}}', '[1]', '{"x": {"y": []}}', '{"x": {"y": [3], "z": null}}']
    events = spark.createDataFrame([(1, i, "r", "call", str(i), "f", a, None) for i, a in enumerate(odd)], "conv_id long, turn long, role string, kind string, call_id string, tool string, arguments string, content string")
    assert {r.turn: r.valid for r in tool_calls.linked(events, schemas).collect()} == {i: i >= 7 for i in range(len(odd))}


def test_hot_payload_and_host(spark, monkeypatch):
    """Most pages share one payload and one host; joins by hot and other keys give what a plain join gives."""
    rows = [(i, f"http://{'a.example.org' if i % 10 else f'h{i}.com'}/de/{i}", "same" if i % 4 else f"page {i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    wanted = [sorted(map(tuple, f(pages).collect())) for f in (warc.archived_pages, url_trust.judged_urls)]
    plain = shared.spread_join
    for module in (warc, url_trust):
        monkeypatch.setattr(module, "spread_join", lambda rows, keyed, by, total, few=None: plain(rows, keyed, by, total, 10**9))
    assert [sorted(map(tuple, f(pages).collect())) for f in (warc.archived_pages, url_trust.judged_urls)] == wanted
    assert sum(r[3] == "revisit" and r[4] == 1 for r in wanted[0]) == 149


def test_share_of_few_different_rows(spark):
    rows = spark.createDataFrame([(i % 3 if i % 100 else 7,) for i in range(6000)], "v int")
    found = [sorted(r.v for r in shared.hashed_share(rows.repartition(n), 300).collect()) for n in (1, 5)]
    assert found[0] == found[1] and 295 <= len(found[0]) <= 305 and {0, 1, 2} <= set(found[0])


def test_conversations_odd(spark):
    rows = [(1, 0, "user", 'é "x"\n', 1), (1, 1, "assistant", None, 1), (1, 1, "assistant", None, 1), (1, 5, None, "t", 1), (None, 0, "user", "", 1), (2, None, "user", None, 1)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind long")
    found = tool_calls.formatted_conversations(docs).collect()
    assert len(found) == 6 and [r.linked for r in found if r.kind == "result"] == [True, True]
    assert json.loads(next(r for r in found if r.conv_id == 1 and r.kind == "call").message)["arguments"] == {"chars": 6, "prompt": 'é "x"\n', "turn": 0}
    assert [r.valid for r in found if r.conv_id == 2] == [False]
    assert tool_calls.formatted_conversations(docs.limit(0)).count() == 0
    plan = tool_calls.formatted_conversations(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- words that are alike ----------------------------------------------------------------------------------------------


def twin_words(size):
    """Two words of two letters, the Thue-Morse word and its complement, which sums of letters times powers don't tell apart."""
    turns = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[t] for t in turns), "".join("ba"[t] for t in turns)


@pytest.mark.parametrize("size", [1024, 2048])
def test_twin_words_stay_apart(spark, size):
    x, y = twin_words(size)
    hashes = textbatch.words(next(textbatch.pieces(pa.array([f"{x} {y}"]))), textbatch.SPACED).hashes
    assert hashes[0] != hashes[1]
    texts = [x, y, f"one two three four five {x}", f"one two three four five {y}"]
    found = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, texts)).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3}
    items = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in deco.contamination_report(table(spark, texts), items).collect()} == {0: True, 1: False, 2: True, 3: False}
    model = sp.load_model(MODEL)
    back = {r.doc_id: r.text for r in sp.decoded(sp.encoded(table(spark, texts).coalesce(1), model).drop("text"), model).collect()}
    assert back == dict(enumerate(texts))


def test_words_of_one_hash(spark, monkeypatch):
    """Encoding and decontamination compare letters: with nearly all words of one hash, results stay right."""
    plain = textbatch.span_hashes
    few = lambda *a, **k: plain(*a, **k) & np.uint64(3)
    texts = [prose(i, 12, 40) for i in range(20)] + ["", "Ab ab é"]
    model = sp.load_model(MODEL)
    piece = next(textbatch.pieces(pa.array(texts)))
    want = sp.Encoder(model).encode(piece)
    monkeypatch.setattr(sp, "span_hashes", few)
    got = sp.Encoder(model).encode(piece)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and got[2].all()
    items = [("1", texts[3]), ("2", "Ab"), ("3", " ".join(texts[5].split()[:4]))]
    monkeypatch.undo()
    automaton = deco.ItemAutomaton(items)
    want = deco.matches(piece, automaton)[1]
    # Of one hash are documents' words and items' words, which stay apart among themselves.
    monkeypatch.setattr(textbatch, "span_hashes", lambda data, starts, ends, lower=False, seed=0: np.array([automaton.vocabulary[hash(data[a:b].tobytes()) % len(automaton.vocabulary)] if not len(w := np.flatnonzero(automaton.vocabulary == h)) else h for h, a, b in zip(plain(data, starts, ends, lower, seed), starts, ends, strict=True)], np.uint64))
    assert deco.matches(piece, automaton)[1] == want and len(want) >= 2


def test_items_of_one_hash(monkeypatch):
    """Another seed is taken where two words of items have one hash."""
    plain = textbatch.span_hashes
    monkeypatch.setattr(textbatch, "span_hashes", lambda data, starts, ends, lower=False, seed=0: plain(data, starts, ends, lower, seed) & np.uint64(1 if seed < 3 else (1 << 64) - 1))
    automaton = deco.ItemAutomaton([("1", "one two three"), ("2", "two four")])
    assert automaton.seed == 3 and len(automaton.vocabulary) == 4
