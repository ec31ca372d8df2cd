"""Vectors and languages against brute force, exact fractions and held-out rows."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pacegrid.llm import _vectors, languages, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code int, n long, component string, i int, _length int"
CLASH = ("v", 3, 4, "c", 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, *CLASH) for i, v, k in rows], SCHEMA).repartition(3)


def made(n, wide, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, wide)) @ rng.normal(size=(wide, wide)) * 0.3
    return [[float(x) for x in row] for row in base.astype(np.float32)]


ODD = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [math.nan] * 16, 1), (903, [math.inf] + [0.0] * 15, None), (904, [0.5] * 3, 2), (905, [], 2)]


@given(st.lists(st.lists(st.integers(-(1 << 61), 1 << 61), min_size=3, max_size=3), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_products_and_packing_are_exact(rows):
    y = np.array(rows, np.int64)
    assert whitening.products(y).tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    assert whitening.sums(y).tolist() == [sum(r[i] for r in rows) for i in range(3)]
    assert _vectors.unpacked(_vectors.packed(y), 3).tolist() == rows
    batch = whitening._cells(len(rows), whitening.sums(y), whitening.products(y)).to_pylist()
    back = {}
    for c in batch:
        back[c["i"], c["j"]] = back.get((c["i"], c["j"]), 0) + (c["value"] << (30 * c["part"]))
    assert back[-1, -1] == len(rows) and back[0, 2] == sum(r[0] * r[2] for r in rows) and back[1, -1] == sum(r[1] for r in rows)


@pytest.mark.parametrize("far", [0.0, 30_000.0])
def test_whitening_equals_fractions(spark, far):
    vectors = made(300, 16)
    vectors = [[x + far * (k == 3) for k, x in enumerate(v)] for v in vectors]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 1) for i in range(150)] + [(7, vectors[7], 1), (None, vectors[9], None)] + ODD
    found = whitening.whitening(frame(spark, rows)).collect()
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v, _ in rows if i not in range(900, 906)}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    assert len(found) == (300 + 150 + 2) * 16 and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, 17))
    whole = [[n * sum(r[a] * r[b] for r in fit) - sums[a] * sums[b] for b in range(16)] for a in range(16)]
    values, base = np.linalg.eigh(np.array([[float(Fraction(v, n * n)) for v in row] for row in whole]))
    trace = float(Fraction(sum(whole[a][a] for a in range(16)), n * n))
    sign = {}
    for r in found:
        assert r.deviation == int(r.deviation_digits) == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))
        k = 16 - r.component
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-4) and r.identity_error < 1e-4
        by_hand = sum(float(Fraction(n * v - s, n)) * base[d, k] for d, (v, s) in enumerate(zip(x[r.vec_id], sums))) / math.sqrt(values[k])
        if abs(by_hand) > 0.1:
            assert abs(r.whitened) == pytest.approx(abs(by_hand), rel=1e-6)
            assert sign.setdefault(r.component, r.whitened * by_hand > 0) == (r.whitened * by_hand > 0)


def test_whitening_of_few_vectors(spark):
    flat = [0.5] * 4
    rows = [(1, flat, 1), (2, flat, 1), (3, [1.5, 0.5, 0.5, 0.5], 1)]
    found = whitening.whitening(frame(spark, rows)).collect()
    assert len(found) == 12 and {r.n for r in found} == {2}
    assert all((r.whitened is None) == (r.component > 1) and (r.explained == pytest.approx(1) if r.component == 1 else r.explained == 0) for r in found)
    assert {abs(r.whitened) for r in found if r.component == 1} == {1.0} and {r.identity_error for r in found} == {0.0}
    alone = whitening.whitening(frame(spark, [(1, flat, 1)])).collect()
    assert len(alone) == 4 and all(r.whitened is None and r.deviation == 0 for r in alone)
    assert whitening.whitening(frame(spark, rows).limit(0)).count() == 0
    assert whitening.whitening(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    # sums of squares beyond a long: the digits tell
    far = whitening.whitening(frame(spark, [(1, [1e15, 0.0], 1), (2, [-1e15, 0.0], 1)])).collect()
    assert all(r.deviation is None and int(r.deviation_digits) > 1 << 63 for r in far)
    with pytest.raises(Exception, match="too large"):
        whitening.whitening(frame(spark, [(1, [1e30, 0.0], 1)])).collect()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract, entry by entry."""
    kept = {}
    for i, v, k in rows:
        if v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v):
            kept.setdefault(i, []).append(([math.floor(4096 * float(np.float32(c))) for c in v], k))
    ids = sorted((i for i in kept if i is not None)) + [None] * (None in kept)
    long = 16 // parts
    cut = lambda x, p: x[p * long : (p + 1) * long]
    books = [[cut(min(x for x, _ in kept[i]), p) for i in ids[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    everyone = [(i, x, k) for i in kept for x, k in kept[i]]

    def best(x, p):
        return min((far(cut(x, p), b), j) for j, b in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in everyone:
                groups.setdefault(best(x, p)[1], []).append(cut(x, p))
            for j, g in groups.items():
                groups[j] = [sum(c) // len(g) for c in zip(*g)]
            books[p] = [groups.get(j, b) for j, b in enumerate(books[p])]
    out = []
    for i, x, k in everyone:
        found = [best(x, p) for p in range(parts)]
        out.append((i, k, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    by_label = {}
    for _, k, _, e in out:
        by_label[k] = by_label.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    key = lambda r: (r[0] is None, r)
    return sorted(((i, c, e, by_label[k], digest) for i, k, c, e in out), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_equal_a_plain_search(spark, coarse):
    """Coarse vectors have many ties between entries."""
    vectors = [[round(x * 2) / 2 if coarse else x for x in v] for v in made(200, 16, 4)]
    rows = [(i * 3, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors)] + [(2000 + i, vectors[5], 1) for i in range(100)]
    rows += [(6, vectors[30], 2), (6, vectors[30], 2), (None, vectors[31], None)] + ODD
    found = sorted((tuple(r) for r in vector_codes.vector_codes(frame(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert found == plain_codes(rows)


def test_codes_of_few_vectors(spark):
    rows = [(5, made(1, 16)[0], None), (None, made(2, 16)[1], 3)]
    found = {r.vec_id: r for r in vector_codes.vector_codes(frame(spark, rows)).collect()}
    assert {k: r.code for k, r in found.items()} == {5: "00" * 8, None: "01" * 8} and {r.error for r in found.values()} == {0}
    assert vector_codes.vector_codes(frame(spark, rows).limit(0)).count() == 0
    nameless = vector_codes.vector_codes(frame(spark, [(None, [0.5] * 16, 1), (None, [0.5] * 16, None)])).collect()
    assert [(r.code, r.error) for r in nameless] == [("00" * 8, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [0.0] * 9, 1)]))


@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_search_is_exact_and_skips_entries(seed, entries, wide):
    rng = np.random.default_rng(seed)
    points, books = rng.integers(-6, 7, (60, wide)), rng.integers(-6, 7, (entries, wide))
    best, least, taken = vector_codes.nearest(points, books, rng.integers(0, entries, 60))
    every = ((points[:, None] - books[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all() and taken <= every.size
    far = np.concatenate([books * 1000, books * 1000 + 1])
    away = vector_codes.nearest(far, books * 1000, np.tile(np.arange(entries), 2))
    assert len(np.unique(books, axis=0)) < entries or away[2] == len(far)


SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "öß"], "cc": ["ción", "ñe", "que", "los"]}


def speech(rng, kind, n):
    return " ".join("".join(rng.choice(SYLLABLES[kind]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, kind, rng.randint(3, 60)), kind) for i, kind in enumerate(rng.choices(list(SYLLABLES), [6, 3, 1], k=400))]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "12 $$ ́ 34", "cc"), (503, "ka lo " * 60_000, "aa"), (None, "ein ung", "bb"), (504, speech(rng, "cc", 20), None), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    odd += [(600 + i, rows[9][1], rows[9][2]) for i in range(200)] + [(900 + i, "漢字 仮名 " * 5, None) for i in range(4)]
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows + odd], "doc_id long, text string, lang string, score string, _hash double, held_out int").repartition(3)
    found = languages.language_id(docs, each=60).collect()
    assert len(found) == len(rows) + len(odd) and {r.lang_pred for r in found} == {*SYLLABLES, "und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None) and all(0 <= r.score <= 1 for r in found)
    truth = dict((i, k) for i, _, k in rows)
    right = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert len(right) > 60 and sum(right) >= 0.97 * len(right)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (500, 501, 502))
    assert by_id[503].lang_pred == "aa" and by_id[None].lang_pred == "bb" and by_id[504].lang_pred == "cc"
    assert all(by_id[900 + i].rejected for i in range(4)) and sum(r.rejected for r in found if r.doc_id in truth) < 0.1 * len(rows)
    assert found and sorted(map(tuple, found), key=str) == sorted(map(tuple, languages.language_id(docs.repartition(5), each=60).collect()), key=str)
    assert languages.training_rows(docs, 60).num_rows <= 180
    assert languages.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in languages.language_id(docs.where("lang IS NULL")).collect()} == {"und"}


def test_subwords_by_hand():
    column = pa.array(["Ab c-d", None, "é", "123"])
    got = [len(b) for b, _ in languages.subwords(column)]
    # " ab c d ": 4 letters; runs of 2 with a blank at an end or none: _a ab b_ _c c_ _d d_; then _ab ab_ _c_ _d_; then _ab_; "é" has two bytes
    assert got == [4 + 2, 7 + 3, 4 + 2, 1 + 1, 3 + 1]
    assert languages.letters(column).to_pylist() == [" ab c d ", " ", " é ", " "]
    assert [r.tolist() for _, r in languages.subwords(column)][0] == [0, 4, 4, 6, 6]
