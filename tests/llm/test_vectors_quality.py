"""Vector codes, centroid clusters and quality scores against brute force, and on odd tables."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from motifold.llm import centroid_clusters as clusters
from motifold.llm import quality_discriminant as quality
from motifold.llm import textbatch
from motifold.llm import vector_codes as codes
from motifold.llm import whole_vectors as whole

VECTORS = "vec_id long, embedding array<double>, label int, _n long, code string, vector string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], VECTORS).repartition(parts)


def down(x, factor):
    return math.floor(x * factor) if abs(x) < 2**53 else int(x) * factor


def fine(v, size=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (size is None or len(v) == size)


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def short(value):
    return value if value < 2**63 else None


def random_rows(seed, n, size, spread=1.0):
    own = np.random.default_rng(seed)
    return [(int(i), (own.standard_normal(size) * spread).tolist(), int(own.integers(3)) if i % 5 else None) for i in own.permutation(n)]


# -- whole numbers ---------------------------------------------------------------------------------------------------


def test_floors_are_exact():
    x = np.array([[0.1, -0.1, -0.0], [1.5, -2.25, 1e-320], [2.0**60, 1.0, -(2.0**60)], [1.7e308, -1.7e308, 0.3]])
    small, large = whole.floors(x, 64, 1 << 40)
    assert small.rows.tolist() == [0, 1] and small.values.tolist() == [[6, -7, 0], [96, -144, 0]]
    assert large.rows.tolist() == [2, 3] and large.values.tolist() == [[down(v, 64) for v in row] for row in x[2:].tolist()]


def test_sums_of_all_tasks(spark):
    rows = spark.range(1000).repartition(7).selectExpr("id * 4611686018427387 as v")
    found = whole.tree_sums(rows, lambda batch: [np.array([sum(batch.column(0).to_pylist())], object), np.array([batch.num_rows])])
    assert [x.tolist() for x in found] == [[sum(range(1000)) * 4611686018427387], [1000]]
    assert whole.tree_sums(rows.where("v < 0"), lambda batch: [np.zeros(1)]) is None


# -- 11 --------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, factor, rounds):
    usable = [(i, v, label) for i, v, label in rows if fine(v) and v and len(v) % parts == 0]
    sizes = [len(v) for _, v, _ in usable]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [(i, [down(x, factor) for x in v], label) for i, v, label in usable if len(v) == size]
    width = size // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    order = sorted(kept, key=lambda x: (x[0] is None, x[0], x[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    nearest = lambda v, p: min(range(len(books[p])), key=lambda k: (away(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        found = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            new = []
            for k, old in enumerate(books[p]):
                own = [cut(v, p) for (_, v, _), c in zip(kept, found, strict=True) if c[p] == k]
                new.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else old)
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    told = []
    for i, v, label in kept:
        own = [nearest(v, p) for p in range(parts)]
        told.append((i, "".join(f"{k:02x}" for k in own), sum(away(cut(v, p), books[p][k]) for p, k in enumerate(own)), label))
    total = {x: sum(e for _, _, e, label in told if label == x) for x in {t[3] for t in told}}
    return sorted(((i, c, short(e), short(total[label]), digest) for i, c, e, label in told), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "n", "size", "parts", "entries", "spread"), [(1, 300, 16, 4, 16, 0.1), (2, 200, 12, 3, 64, 1.0), (3, 60, 8, 8, 64, 0.01), (4, 150, 6, 2, 9, 1e6), (5, 80, 64, 16, 64, 0.2)])
def test_vector_codes(spark, seed, n, size, parts, entries, spread):
    rows = random_rows(seed, n, size, spread)
    rows += [(n + i, v, label) for i, (_, v, label) in enumerate(rows[: n // 3])]  # many copies
    assert told(codes.coded(vectors(spark, rows), parts, entries)) == brute_codes(rows, parts, entries, 256, 2)


def test_vector_codes_ties(spark):
    rows = [(i, [float(x) / 256 for x in (i % 3, i % 2, i % 3, i % 2)], 1) for i in range(40)]
    assert told(codes.coded(vectors(spark, rows), 2, 8)) == brute_codes(rows, 2, 8, 256, 2)


def test_codebook_measures_an_annulus_only():
    own = np.random.default_rng(5)
    entries = own.integers(-500, 500, (64, 4)).astype(object)
    book, parts = codes.Codebook(entries), own.integers(-600, 600, (500, 4))
    measured = []
    plain = book._away
    book._away = lambda p, at: measured.append(at.size) or plain(p, at)
    index, gaps = book.nearest(parts)
    for q, k, gap in zip(parts.tolist(), index.tolist(), gaps.tolist(), strict=True):
        assert (gap, k) == min((away(q, e), j) for j, e in enumerate(entries.tolist()))
    assert sum(measured) < 0.85 * 500 * 64


def test_vector_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(6, 50, 8)
    odd = [(100, None, 1), (101, [], 1), (102, [nan] * 8, 1), (103, [1.0] * 7 + [inf], 1), (104, [1.0] * 7 + [None], 1), (105, [1.0] * 7, 1), (106, [2.0] * 4, 1)]
    odd += [(None, [0.5] * 8, None), (3, [0.25] * 8, None), (3, [0.25] * 8, None), (107, [0.0] * 8, 2), (0, [1e300, -1e300] * 4, 2), (108, [1e15] * 8, 2)]
    assert told(codes.coded(vectors(spark, rows + odd), 4, 16)) == brute_codes(rows + odd, 4, 16, 256, 2)
    assert codes.coded(vectors(spark, odd[:4]), 4, 16).collect() == []
    assert codes.coded(vectors(spark, odd[:0]), 4, 16).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


# -- 13 --------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, size, factor, rounds):
    kept = [(i, [down(x, factor) for x in v]) for i, v, _ in rows if fine(v, size)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        found = [nearest(v) for _, v in kept]
        own = [[v for (_, v), f in zip(kept, found, strict=True) if f == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else old for vs, old in zip(own, centroids, strict=True)]
    found = [(i, nearest(v), away(v, centroids[nearest(v)])) for i, v in kept]
    total = [sum(d for _, c, d in found if c == x) for x in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, short(d), short(total[c]), short(sum(total)), digest[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize(("seed", "n", "size", "k", "spread"), [(1, 300, 6, 16, 0.3), (2, 120, 64, 16, 0.1), (3, 100, 4, 7, 1e5), (4, 10, 3, 16, 1.0), (5, 100, 3, 5, 1e10), (6, 60, 3, 4, 1e17)])
def test_centroid_clusters(spark, seed, n, size, k, spread):
    rows = random_rows(seed, n, size, spread)
    rows += [(n + i, rows[0][1], 1) for i in range(n // 3)]
    assert told(clusters.clustered(vectors(spark, rows), k, size)) == brute_clusters(rows, k, size, 64, 3)


def test_distances_by_bound():
    """Products where they are exact, integers elsewhere: on both sides of the bound, and centroids of each kind at once."""
    own = np.random.default_rng(9)
    for reach in (10, 2**25 - 1, 2**26, 2**31, 2**39):
        x = own.integers(-reach, reach, (50, 4))
        centroids = np.concatenate([own.integers(-5, 5, (3, 4)), own.integers(-reach, reach, (3, 4)), np.full((1, 4), 2**70)]).astype(object)
        plain = [[away(a, c) for c in centroids.tolist()] for a in x.tolist()]
        assert clusters.distances(x, centroids).tolist() == plain
        assert clusters.distances(x.astype(object), centroids).tolist() == plain


def test_centroid_clusters_odd(spark):
    nan = float("nan")
    rows = random_rows(7, 40, 4)
    odd = [(100, None, 1), (101, [], 1), (102, [nan] * 4, 1), (103, [1.0, None, 1.0, 1.0], 1), (104, [1.0] * 5, 1), (None, [0.5] * 4, 1), (3, [0.2] * 4, 1), (3, [0.2] * 4, 1), (105, [1e300] * 4, 1), (106, [0.0] * 4, 1)]
    assert told(clusters.clustered(vectors(spark, rows + odd), 16, 4)) == brute_clusters(rows + odd, 16, 4, 64, 3)
    assert clusters.clustered(vectors(spark, odd[:5]), 16, 4).collect() == []
    assert [r.cluster for r in clusters.clustered(vectors(spark, [(i, [1.0], 1) for i in range(5)]), 3, 1).collect()] == [0] * 5


# -- 12 --------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, features string, score string, fold int, quality string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "f", "s", 1, "q") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS).repartition(3)


def prose(seed, words, junk):
    own = np.random.default_rng(seed)
    word = lambda: "".join(own.choice(list("etaoinshrdlu"), own.integers(2, 9)))
    return " ".join(w.upper() + "!!" if junk == 1 else w + "***" if junk == 2 else f"{w} {w}" if junk == 3 else w for w in (word() for _ in range(words)))


def plain_statistics(text):
    text = text or ""
    words, lines = __import__("re").findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x]
    low = [w.lower() if w.isascii() else w for w in words]
    symbols = set("!#$%&*+/<=>@[\\]^_`{|}~")
    top = max((low.count(w) for w in low), default=0)
    share = lambda a, b: math.log(a / max(b, 1) + quality.FLOOR)
    letters = sum(c.isascii() and c.isalpha() or not c.isascii() for c in text)
    has = lambda w: any(c.isascii() and c.isalpha() or not c.isascii() for c in w)
    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "longest_word": math.log1p(max((len(w.encode()) for w in words), default=0)), "line_length": math.log1p(len(text) / max(1, len(lines))),
        "letters": share(letters, len(text)), "upper": share(sum("A" <= c <= "Z" for c in text), letters), "digits": share(sum("0" <= c <= "9" for c in text), len(text)),
        "repeated_next": share(sum(a == b for a, b in zip(low, low[1:], strict=False)), len(words)), "distinct_words": share(len(set(low)), len(words)), "top_word": share(top, len(words)),
        "letterless_words": share(sum(not has(w) for w in words), len(words)), "symbol_ends": share(sum(w[-1] in symbols for w in words), len(words)), "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
    }


def test_statistics():
    texts = ["", None, "a", "A b\nA b\n\nc! c! c$", "é中𝔘 123 é中𝔘 --", prose(1, 300, 0), prose(2, 50, 1), " \n\t "]
    seen = 0
    for piece in textbatch.pieces(pa.array(texts), 100):
        for row in quality.statistics(piece):
            own = dict(zip(quality.NAMES, row.tolist(), strict=True))
            plain = plain_statistics(texts[seen])
            assert {k: own[k] for k in plain} == pytest.approx(plain, abs=1e-12), texts[seen]
            seen += 1
    assert seen == len(texts)


def test_discriminant_is_the_posterior():
    """Against densities written out: shrunk covariances, determinants and distances by inverses."""
    own = np.random.default_rng(3)
    x = [own.standard_normal((40, 3)), own.standard_normal((90, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.2]]) + 1]
    z = [np.concatenate([np.ones((len(a), 1)), a, np.zeros((len(a), 1))], 1) for a in x]
    model = quality.fitted({k: a.T @ a for k, a in enumerate(z)}, 0.3, 0.2, 2.0)
    covariances = [np.cov(a.T, bias=True) for a in x]
    within = sum(len(a) * c for a, c in zip(x, covariances, strict=True)) / 130
    within = 0.8 * within + (0.2 + 1e-6) * np.diag(np.diag(within))
    at = own.standard_normal((20, 3))
    logs = []
    for a, c in zip(x, covariances, strict=True):
        c, gap = 0.7 * c + 0.3 * within, at - a.mean(0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap) - 0.5 * np.log(np.linalg.det(c)))
    odds = logs[1] - logs[0] + np.log(91 / 41)
    assert model.odds(at) == pytest.approx(odds, abs=1e-9) and model.score(at) == pytest.approx(1 / (1 + np.exp(-odds / 2)), abs=1e-9)


def test_quality_of_held_out_rows(spark):
    texts = [prose(i, 5 + i % 60, 0 if i % 3 else 1 + i % 9 // 3) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "x") for i in range(400)], "doc_id long, quality int, score string")
    found = {r.doc_id: r for r in quality.quality_scores(documents(spark, texts), labels).collect()}
    assert len(found) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(r.held_out == (__import__("zlib").crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i in found if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 3 > 0) for i in held]) > 0.95
    # Labels of held-out rows teach nothing.
    turned = spark.createDataFrame([(i, int((i % 3 > 0) ^ found[i].held_out), "x") for i in range(400)], "doc_id long, quality int, score string")
    again = {r.doc_id: r.score for r in quality.quality_scores(documents(spark, texts), turned).collect()}
    assert again == pytest.approx({i: r.score for i, r in found.items()}, abs=1e-9)


def test_quality_odd(spark):
    texts = [None, "", " \n ", "x" * 3_000_000, "a b " * 200_000, "é中𝔘", "one two", "one two"]
    docs = documents(spark, texts, [1, 2, 3, 4, None, 6, 7, 7])
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (None, 0), (6, 7), (7, 0), (7, 1), (99, 1)], "doc_id long, quality int")
    for labels in (some, some.where("quality = 1"), some.limit(0)):
        found = quality.quality_scores(docs, labels).collect()
        assert len(found) == 8 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in found)
        assert len({r.score for r in found if r.doc_id == 7}) == 1
        scores = {r.doc_id: r.score for r in found}
        assert scores[1] == scores[2]
    assert {r.score for r in quality.quality_scores(docs, some.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), some).collect() == []
