import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pacegrid.llm import _text, near_dedup, quality_rules

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\ré#|,. "), st.text(max_size=20)), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_spans_are_the_pattern(texts):
    column = pa.array(texts, pa.string())
    raw, bounds = _text.text_bytes(column)
    starts, ends, rows = _text.word_spans(raw, bounds)
    for i, text in enumerate(texts):
        got = [raw[a:b].tobytes().decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])]
        assert got == WORD.findall(text or "")
    hashed, at = near_dedup.word_hashes(column)
    words = [w for t in texts for w in WORD.findall(t or "")]
    assert len(set(hashed.tolist())) == len(set(words)) and np.array_equal(at, rows)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_rule_counts_are_brute_force(texts):
    counts, _ = quality_rules.statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        windows = list(zip(words, words[1:], words[2:]))
        inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
        assert tuple(int(counts[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_sequences_on_which_polynomial_hashes_collide():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    counts, _ = quality_rules.statistics(pa.array([f"{one}\n{other}", f"{one}\n{one}", f"{one} x y {other} x y {one} x"]))
    assert counts["n_dup_lines"].tolist() == [0, 1, 0] and counts["n_repeat_words"].tolist() == [0, 0, 0]
    keys = near_dedup.text_keys(*near_dedup.word_hashes(pa.array([" ".join(one), " ".join(other), "  ".join(one)])))
    assert keys[0] == keys[2] != keys[1]


def test_rare_pairs_meet_for_all_similar_texts():
    """Any two texts at the least similarity share one of their rarest word pairs."""
    rng = np.random.default_rng(4)
    for n in (*range(4, 40), 100, 200):
        a = [f"w{x}" for x in rng.integers(0, 30, n)]
        b = list(a)
        for _ in range(n // 5):
            at, kind = rng.integers(0, len(b)), rng.integers(0, 3)
            if kind == 0 and len(b) > 1 and len(b) * 5 > n * 4:
                del b[at]
            else:
                b[at:at + (kind == 1)] = [f"v{rng.integers(0, 30)}"]
        longer = max(len(a), len(b))
        if 5 * edit_distance(a, b) > longer:
            continue
        key, group, size = near_dedup._pairs_of_words(pa.array([" ".join(a), " ".join(b)]))
        some = [set(sorted(key[group == i].tolist())[: 2 * (int(size[i]) // 4) + 1]) for i in (0, 1)]
        assert some[0] & some[1] or edit_distance(a, b) == longer // 5 and longer < 5


def test_huge_pairs_are_aligned_between_anchors():
    rng = np.random.default_rng(7)
    a = rng.permutation(400_000).astype(np.uint64)
    b = a.copy()
    b[rng.integers(0, len(b), 30_000)] = 1 << 40
    found = near_dedup.edits_within([(a, b)], [80_000])[0]
    assert 0 < found <= 30_000
    assert near_dedup.edits_within([(a, rng.permutation(a))], [80_000])[0] == -1


def test_slices_keep_order_and_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 50, None, "b" * 500, "c"], "n": [1, 2, 3, 4]})
    parts = list(_text.slices(batch, "text", 60))
    assert [x for p in parts for x in p.column("n").to_pylist()] == [1, 2, 3, 4]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25)), min_size=1, max_size=6), st.integers(0, 12))
def test_banded_alignment_is_edit_distance(pairs, limit):
    arrays = [(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs]
    got = near_dedup.edits_within(arrays, [limit] * len(pairs))
    want = [d if (d := edit_distance(a, b)) <= limit else -1 for a, b in pairs]
    assert got.tolist() == want


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 30))
def test_diagonals_count_edits_as_bands_do(a, b, limit):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    d = edit_distance(a, b)
    assert near_dedup._diagonals(x, y, limit) == (d if d <= limit else -1)
    assert all(near_dedup._runs(x, y, q) <= d for q in (2, 4))


def test_edits_do_not_depend_on_the_length_of_texts(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = []
    for size in (30, 200, 900):
        a = rng.integers(0, 12, size).astype(np.uint64)  # few words, so no word stands once in both
        b = np.delete(a, rng.integers(0, size, size // 20))
        b[rng.integers(0, len(b), size // 20)] = 3
        pairs.append((a, np.insert(b, rng.integers(0, len(b), size // 20), 5)))
    limits = [len(a) // 5 for a, _ in pairs]
    banded = near_dedup.edits_within(pairs, limits)
    monkeypatch.setattr(near_dedup, "MOST_CELLS", 10)
    assert near_dedup.edits_within(pairs, limits).tolist() == banded.tolist()
    assert (banded > 0).all()
