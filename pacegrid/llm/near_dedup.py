"""Near duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of words.  Its k-mers (``WORDS`` words) are labelled with
their occurrence number, so that repeats differ.  Each of ``SKETCHES`` hash
functions picks the ``TAKEN`` labelled k-mers with the least hashes and keeps
them in text order; texts that agree in a pick are candidates.  The chance of
that falls with edit distance, not only with the shared set of k-mers.

Candidates are tested by banded edit alignment over words: two texts are linked
if ``1 - edits / words of the longer`` is ``SIMILAR`` or more.  Classes are the
connected components of links; texts with equal word sequences are one node,
named by 128 bits of xxh3 over the hashes of its words.

Buckets are settled without pairing off their members.  Every bucket has up to
``HUBS`` hubs, the members with the most company over all their buckets, one of
each hash class.  First every text meets one hub, the one with most company of all
its buckets' hubs, then the other hubs; pairs of one component are left out, as
they can join nothing.  Members that still stand in different components are tested pair by
pair in buckets of up to ``FEW`` texts.  Those of larger buckets go to an exact join:
two texts of ``SIMILAR`` or more share one of their rarest word pairs (``_enough``) and
have word parities that differ little (``_parity``), so only texts that do are tested,
whatever the size of their bucket.  Many such pairs are of one group, say of a long
passage: every text has a home, the bucket or word pair that most texts share with it, and
pairs of one home are tested where blocks of it meet, so that a text travels once for each block
and not once for each pair.  Word pairs become rows only where texts of different homes share them.

Defined results: texts without a word (null, empty, white space) are equal to
each other; texts shorter than a k-mer have one k-mer, the whole text; repeated
rows are members of one class; class ids are the least doc_id of the class (null
if no member has one).  Edits are exact for texts of any length: where a band of the
allowed width has more than ``MOST_CELLS`` cells they are counted by diagonals instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _text
from pacegrid.operators import network

WORDS = 5
TAKEN = 2
SKETCHES = 80
SIMILAR = 0.8
HUBS = 8
#: Buckets of up to so many texts are settled pair by pair where hubs have not joined them.
FEW = 32
#: Texts of a group that meet in one task, about, and pairs of them that are aligned together.
BLOCK, PAIRS = 256, 4096
#: Counters of word pairs in the exact join, and how many of them are summed up together: they decide its cost, not its result.
SLOTS, SPAN = 1 << 22, 1 << 14
#: The level of what is there once.
ONCE = 2000
#: Bits of a text that tell most unlike texts apart before they are aligned.
PARITY = 512
MOST_CELLS = 2_000_000_000
#: Sketches are taken of so many bytes of text at a time, so that arrays stay in a core's cache.
SKETCH_BYTES = 1 << 20
_FAR = np.int32(1 << 20)
_PLACE = np.uint64((1 << 28) - 1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SUMS = ("slots", "n", "low", "high")


def _stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and row offsets into the words.

    Eight bytes at a time are stirred in, over all words together.
    """
    raw, bounds = _text.text_bytes(column)
    starts, ends, rows = _text.word_spans(raw, bounds)
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    hashed = _stir(size.astype(np.uint64) * _BASE)
    active, at = np.arange(len(size)), 0
    while len(active):
        left = np.minimum(size[active] - at, 8).astype(np.uint64)
        lane = eights[starts[active] + at] & (_LAST >> (np.uint64(64) - np.uint64(8) * left))
        hashed[active] = _stir((hashed[active] ^ lane) * _BASE + np.uint64(1))
        at += 8
        active = active[size[active] > at]
    return hashed, rows


def text_keys(words: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """128 bits that name each word sequence."""
    raw = memoryview(np.ascontiguousarray(words)).cast("B")
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(rows.tolist(), rows[1:].tolist())]


def _labelled(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``values`` with their occurrence number in the group stirred in, groups being runs."""
    order = np.lexsort((values, group))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (values[order][1:] != values[order][:-1]) | (group[order][1:] != group[order][:-1])
    run = np.flatnonzero(fresh)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
    return _stir(values + nth * _BASE)


def picks(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) hashes of the ordered picks; texts without words get 0."""
    size = np.diff(rows)
    kmers = np.where(size >= WORDS, size - WORDS + 1, (size > 0).astype(np.int64))
    out = np.zeros((len(size), SKETCHES), np.uint64)
    full = np.flatnonzero(kmers)
    if not len(full):
        return out
    group, place = _text.ragged(kmers[full])
    first = rows[full][group] + place
    until = rows[full + 1][group]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    hashed = np.zeros(len(first), np.uint64)
    for j in range(WORDS):
        hashed = _stir(hashed * _BASE + np.where(first + j < until, padded[first + j], np.uint64(7)))
    label = _labelled(hashed, group)
    begin = np.cumsum(kmers[full]) - kmers[full]
    # a value's upper bits are the hash, its lower bits the place: its minimum tells where it stands
    where = np.arange(len(label), dtype=np.uint64)
    if len(label) > int(_PLACE):
        raise ValueError("a text of more than 2**28 words")
    least = np.empty((SKETCHES, TAKEN, len(full)), np.int64)
    for s in range(SKETCHES):
        factor = _stir(np.array([2 * s + 1], np.uint64))[0] | np.uint64(1)
        value = label * factor
        value &= ~_PLACE
        value |= where
        for t in range(TAKEN):
            at = (np.minimum.reduceat(value, begin) & _PLACE).astype(np.int64)
            least[s, t] = np.where(kmers[full] > t, at, len(label))
            if t + 1 < TAKEN:
                value[at[kmers[full] > t]] = _LAST
    least.sort(axis=1)
    named = np.append(label, np.uint64(11))
    key = np.broadcast_to(np.arange(SKETCHES, dtype=np.uint64)[:, None], (SKETCHES, len(full)))
    for t in range(TAKEN):
        key = _stir(key * _BASE + named[least[:, t]])
    out[full] = key.T
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch, "text", SKETCH_BYTES):
            words, rows = word_hashes(part.column("text"))
            keys = picks(words, rows).view(np.int64).ravel()
            offsets = np.arange(part.num_rows + 1, dtype=np.int32) * SKETCHES
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_raw"), pa.array(text_keys(words, rows), pa.binary()), pa.array(np.diff(rows)), pa.ListArray.from_arrays(offsets, keys)],
                ["doc_id", "_raw", "_text", "n_words", "_picks"],
            )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("text"), pa.array(text_keys(*word_hashes(part.column("text"))), pa.binary())], ["text", "_text"])


def _excess(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edits between two sequences, from counts of their members."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    sign = np.where(order < len(a), 1, -1)
    ordered = both[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    surplus = np.add.reduceat(sign, start)
    return max(int(surplus[surplus > 0].sum()), int(-surplus[surplus < 0].sum()))


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Edits of each pair within a band of k diagonals on both sides; more than k: k + 1."""
    height = np.array([len(a) for a, _ in pairs])
    width = np.array([len(b) for _, b in pairs])
    rows, columns = int(height.max()), max(int(width.max()), int(height.max()))
    left = np.zeros((len(pairs), rows), np.uint64)
    right = np.zeros((len(pairs), columns + 2 * k + 1), np.uint64)
    right[:] = 1
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, k : k + len(b)] = b
    shift = np.arange(2 * k + 1, dtype=np.int32)
    state = np.where(shift >= k, shift - k, _FAR).astype(np.int32)[None, :].repeat(len(pairs), axis=0)
    end = np.clip(width - height + k, 0, 2 * k)
    found = np.where(height == 0, state[np.arange(len(pairs)), end], _FAR)
    for i in range(1, rows + 1):
        step = state + (left[:, i - 1, None] != right[:, i - 1 : i + 2 * k])
        np.minimum(step[:, :-1], state[:, 1:] + 1, out=step[:, :-1])
        state = np.minimum.accumulate(step - shift, axis=1) + shift
        done = height == i
        if done.any():
            found[done] = state[done, end[done]]
    return np.where((np.abs(width - height) <= k) & (found <= k), found, k + 1)


def _runs(a: np.ndarray, b: np.ndarray, q: int) -> int:
    """A lower bound of the edits, from counts of runs of ``q`` members: an edit changes ``q`` of them at most."""
    size = [max(0, len(x) - q + 1) for x in (a, b)]
    if not all(size):
        return 0
    hashed = [np.zeros(n, np.uint64) for n in size]
    for x, h, n in zip((a, b), hashed, size, strict=True):
        for j in range(q):
            h[:] = _stir(h * _BASE + x[j : j + n])
    return -(-_excess(*hashed) // q)


def _diagonals(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Edits of two sequences by the furthest place that each number of edits reaches on each diagonal; more than ``limit``: -1.

    Exact as ``_band`` is, in memory for one row of diagonals and in steps of the edits squared, not of edits times length.
    """
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > limit:
        return -1
    most = min(limit, max(n, m))
    # reach[k + most + 1]: members of ``a`` passed on diagonal k, so k more of ``b``
    reach = np.full(2 * most + 3, -(1 << 60), np.int64)
    reach[most + 1] = 0
    for edits in range(most + 1):
        low, high = max(-edits, goal - (most - edits), -n), min(edits, goal + (most - edits), m)
        k = np.arange(low, high + 1)
        at = slice(low + most + 1, high + most + 2)
        if edits:
            step = np.maximum(reach[at], reach[low + most + 2 : high + most + 3]) + 1
            np.maximum(step, reach[low + most : high + most + 1], out=step)
            np.minimum(step, np.minimum(n, m - k), out=step)
            reach[at] = step
        here = reach[at]
        end = np.minimum(n, m - k)
        on = np.flatnonzero((here >= 0) & (here < end))
        while len(on):
            on = on[a[here[on]] == b[here[on] + k[on]]]
            if len(on) > 16:
                here[on] += 1
            else:
                for i in on.tolist():
                    x, y, width = int(here[i]), int(here[i] + k[i]), 64
                    while x < end[i]:
                        width = min(width, int(end[i]) - x)
                        differ = np.flatnonzero(a[x : x + width] != b[y : y + width])
                        step = int(differ[0]) if len(differ) else width
                        x, y = x + step, y + step
                        if len(differ):
                            break
                        width *= 2
                    here[i] = x
                break
            on = on[here[on] < end[on]]
        if low <= goal <= high and reach[goal + most + 1] >= n:
            return edits
    return -1


def edits_within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Edit distance of each pair where it is within its limit, else -1."""
    out = np.full(len(pairs), -1)
    waiting: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]] = []
    for i, ((a, b), limit) in enumerate(zip(pairs, limits, strict=True)):
        a, b = _trim(a, b)
        least = max(_excess(a, b), abs(len(a) - len(b))) if len(a) and len(b) else max(len(a), len(b))
        if least > limit:
            continue
        if not len(a) or not len(b):
            out[i] = least
            continue
        if (2 * limit + 1) * len(a) > MOST_CELLS:
            # the same edits at less cost, where a band would be long and wide
            out[i] = -1 if max(_runs(a, b, q) for q in (2, 4)) > limit else _diagonals(a, b, limit)
            continue
        waiting.append((max(4, 1 << max(0, least - 1).bit_length()), i, (a, b)))
    while waiting:
        waiting.sort(key=lambda w: (w[0], len(w[2][0])))
        later = []
        while waiting:
            k = min(waiting[0][0], max(limits[waiting[0][1]], 1))
            take = [waiting.pop(0)]
            room = max(1, 400_000 // max(2 * k + 1, len(take[0][2][0])))
            while waiting and len(take) < room and waiting[0][0] == take[0][0] and len(waiting[0][2][0]) <= 1.3 * len(take[0][2][0]) + 16:
                take.append(waiting.pop(0))
            wide = max(min(t[0], max(limits[t[1]], 1)) for t in take)
            for (_, i, pair), found in zip(take, _band([t[2] for t in take], wide), strict=True):
                if found <= wide:
                    out[i] = found if found <= limits[i] else -1
                elif wide < limits[i]:
                    later.append((2 * wide, i, pair))
        waiting = later
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _text.slices(batch, "_a_text"):
            left, at = word_hashes(part.column("_a_text"))
            right, bt = word_hashes(part.column("_b_text"))
            pairs = [(left[at[i] : at[i + 1]], right[bt[i] : bt[i + 1]]) for i in range(part.num_rows)]
            longest = [max(len(a), len(b)) for a, b in pairs]
            # whole arithmetic: edits <= longest * (1 - SIMILAR)
            edits = edits_within(pairs, [n * round(100 * (1 - SIMILAR)) // 100 for n in longest])
            yield pa.RecordBatch.from_arrays(
                [part.column("_a"), part.column("_b"), pa.array(edits >= 0), pa.array([1 - max(e, 0) / n if n else 1.0 for e, n in zip(edits, longest, strict=True)])],
                ["_a", "_b", "linked", "similarity"],
            )


def _pairs_of_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled hashes of neighbouring words, the text of each, and the texts' words."""
    words, rows = word_hashes(column)
    size = np.diff(rows)
    group, place = _text.ragged(np.maximum(size - 1, 0))
    first = rows[:-1][group] + place
    return _labelled(_stir(words[first] * _BASE + words[first + 1]) if len(first) else np.zeros(0, np.uint64), group), group, size


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)


def _summed(slots: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each slot once, with the sum of ``n``, the least ``low`` and the greatest ``high``."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])[: len(slots)])
    if not len(first):
        return slots, n, low, high
    return slots[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _by_slot(texts: DataFrame, entries: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], found: Callable[..., np.ndarray], kind: type) -> np.ndarray:
    """(SLOTS,) numbers of ``kind``: ``found(n, low, high)`` of the entries (key, value) in each slot, 0 where there are none.

    A task's sums travel as one row for each block of ``SPAN`` slots, and blocks are summed up apart from each other: what
    meets in a task or on the driver depends on ``SLOTS`` and on the number of tasks, not on texts that share a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            for part in _text.slices(batch, "text"):
                key, value = entries(part)
                sums = _summed(*(np.append(x, y) for x, y in zip(sums, (_slot(key), np.ones(len(key), np.int64), value, value), strict=True)))
        bounds = np.searchsorted(sums[0], np.arange(0, SLOTS + SPAN, SPAN))
        for block in np.flatnonzero(np.diff(bounds)).tolist():
            start, stop = bounds[block : block + 2].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), pa.array(x[start:stop])) for x in sums)], ["block", *_SUMS])

    def whole(block: pa.Table) -> pa.Table:
        slots, *sums = _summed(*(pa.concat_arrays([x.flatten() for x in block[c].chunks]).to_numpy() for c in _SUMS))
        out = np.zeros(SPAN, kind)
        out[slots % SPAN] = found(*sums)
        return pa.table([block["block"].slice(0, 1), pa.array([out.tobytes()], pa.binary())], ["block", "found"])

    rows = texts.mapInArrow(_tables.tidy_all(run), f"block long, {', '.join(f'{c} array<long>' for c in _SUMS)}")
    out = np.zeros(SLOTS, kind)
    for row in rows.groupBy("block").applyInArrow(whole, "block long, found binary").toArrow().to_pylist():
        out[row["block"] * SPAN : (row["block"] + 1) * SPAN] = np.frombuffer(row["found"], kind)
    return out


def _levels(n: np.ndarray, *_) -> np.ndarray:
    """Counts on a scale of logarithms, in 16 bits; 0 and 1 stay apart from what is more."""
    return np.rint(ONCE * np.log2(1 + n))


def _enough(size: np.ndarray) -> np.ndarray:
    """How many of its word pairs, first in an order that all texts obey, a text of ``size`` words needs to share one with every text that is alike.

    Texts of n and m >= n words are alike with at most m // 5 edits, m - n of them insertions at least.  A changed
    or deleted word takes two of the shorter text's labelled word pairs, an inserted one takes one: at most
    2 * (m // 5) - (m - n) are lost, which is the most for m = n, or for m = n + 1 if that is a multiple of 5.  Of the
    longer text at most 2 * (m // 5) are lost.  The first one of those that both have comes behind lost ones only.
    """
    return 2 * (size // 5) + (size % 5 == 4) + 1


def _rare(part: pa.RecordBatch, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``_enough`` rarest word pairs of every text without those that no other text has, and the text of each.

    Rare is what has a low level in ``often``, then a low hash.
    """
    key, group, size = _pairs_of_words(part.column("text"))
    level = often[_slot(key)]
    order = np.lexsort((key, level, group))
    have = np.maximum(size - 1, 0)
    owner, nth = _text.ragged(np.minimum(have, _enough(size)))
    chosen = order[(np.cumsum(have) - have)[owner] + nth]
    chosen = chosen[level[chosen] > ONCE]
    return key[chosen].view(np.int64), group[chosen]


def _counted(texts: DataFrame) -> tuple[Broadcast, Broadcast]:
    """Levels of all word pairs of ``texts``, and of their rare ones alone."""
    spark = texts.sparkSession

    def every(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key = _pairs_of_words(part.column("text"))[0]
        return key, np.zeros(len(key), np.int64)

    often = spark.sparkContext.broadcast(_by_slot(texts, every, _levels, np.uint16))

    def rare(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key = _rare(part, often.value)[0]
        return key, np.zeros(len(key), np.int64)

    return often, spark.sparkContext.broadcast(_by_slot(texts, rare, _levels, np.uint16))


def _commonest(texts: DataFrame, often: Broadcast, shared: Broadcast) -> DataFrame:
    """(_text, _key, _n): of the rare word pairs of each text the one that most texts have among theirs, and their number, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                key, owner = _rare(part, often.value)
                level = shared.value[_slot(key)]
                key, owner, level = (x[level > ONCE] for x in (key, owner, level))
                order = np.lexsort((-key, level, owner))
                last = order[np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True)[: len(order)])]
                number = np.rint(2 ** (level[last] / ONCE)).astype(np.int64) - 1
                yield pa.RecordBatch.from_arrays([part.column("_text").take(pa.array(owner[last])), pa.array(key[last]), pa.array(number)], ["_text", "_key", "_n"])

    return texts.mapInArrow(_tables.tidy(run), "_text binary, _key long, _n long")


def _between(texts: DataFrame, often: Broadcast, shared: Broadcast) -> DataFrame:
    """(_key, _text): the rare word pairs of ``texts`` (_text, text, _home) in slots that texts of different homes have.

    Pairs of one home meet without a key, so a passage of many texts makes no row where they all have one home.
    """

    def homes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key, owner = _rare(part, often.value)
        more = shared.value[_slot(key)] > ONCE
        return key[more], part.column("_home").to_numpy()[owner[more]]

    several = texts.sparkSession.sparkContext.broadcast(_by_slot(texts, homes, lambda n, low, high: low < high, np.bool_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                key, owner = _rare(part, often.value)
                goes = np.flatnonzero(several.value[_slot(key)])
                for start in range(0, len(goes), 100_000):
                    at = goes[start : start + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at]), part.column("_text").take(pa.array(owner[at]))], ["_key", "_text"])

    return texts.mapInArrow(_tables.tidy(run), "_key long, _text binary")


def _odd(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """(texts, PARITY / 64): for each hash class whether a text has an odd number of values in it, as bits."""
    odd = np.bincount(owner * PARITY + (_stir(values) % np.uint64(PARITY)).astype(np.int64), minlength=texts * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(texts, PARITY), axis=1).view(np.int64)


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_text, n_words, _bits, _pair_bits) of words and of neighbouring words.

    An edit changes two bits of words at most and four of word pairs, so texts that differ in more are not alike.
    """
    for batch in batches:
        for part in _text.slices(batch, "text"):
            words, rows = word_hashes(part.column("text"))
            size = np.diff(rows)
            key, group, _ = _pairs_of_words(part.column("text"))
            bits = [_odd(v, o, len(size)) for v, o in ((words, np.repeat(np.arange(len(size)), size)), (key, group))]
            offsets = np.arange(len(size) + 1, dtype=np.int32) * (PARITY // 64)
            yield pa.RecordBatch.from_arrays([part.column("_text"), pa.array(size), *(pa.ListArray.from_arrays(offsets, x.ravel()) for x in bits)], ["_text", "n_words", "_bits", "_pair_bits"])


def _near(a: str, b: str) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * SIMILAR


def _company(buckets: DataFrame) -> DataFrame:
    """``buckets`` (_text, n_words, _key, _size) with the texts' _company: the sizes of their buckets."""
    return buckets.join(buckets.groupBy("_text").agg(F.sum("_size").alias("_company")), "_text")


def _hubs(members: DataFrame) -> DataFrame:
    """(_key, _hubs): of each hash class of a bucket's members the one with most company, in that order."""
    order = F.struct((-F.col("_company")).alias("o"), F.col("_text").alias("t"), F.col("n_words").alias("n"))
    best = members.groupBy("_key", F.pmod(F.xxhash64("_text"), F.lit(HUBS)).alias("_class")).agg(F.min(order).alias("_best"))
    return best.groupBy("_key").agg(F.array_sort(F.collect_list("_best")).alias("_hubs"))


def _met(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members with the hubs of their buckets that are near in length: (_text, _hubbed, _order)."""
    met = members.join(hubs, "_key").select("_text", "n_words", F.explode("_hubs").alias("_hub"))
    met = met.select("_text", "n_words", F.col("_hub.t").alias("_hubbed"), F.col("_hub.n").alias("_n"), F.col("_hub.o").alias("_order"))
    return met.where((F.col("_text") != F.col("_hubbed")) & _near("n_words", "_n")).select("_text", "_hubbed", "_order")


def _met_apart(members: DataFrame, hubs: DataFrame, roots: DataFrame) -> DataFrame:
    """(_text, _hubbed) of members with the hubs of their buckets that are near in length and of another component: hubs bring theirs along."""
    each = hubs.select("_key", F.explode("_hubs").alias("_hub")).withColumn("_hubbed", F.col("_hub.t")).join(roots.toDF("_hubbed", "_at"), "_hubbed")
    rooted = each.groupBy("_key").agg(F.collect_list(F.struct("_hub.t", "_hub.n", "_at")).alias("_hubs"))
    met = members.join(roots, "_text").join(rooted, "_key")
    apart = F.filter("_hubs", lambda h: (h["_at"] != F.col("_root")) & (F.least(h["n"], "n_words") >= F.greatest(h["n"], "n_words") * SIMILAR))
    return met.select("_text", F.explode(apart).alias("_hub")).select("_text", F.col("_hub.t").alias("_hubbed"))


def _paired(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("_a"), F.greatest(one, other).alias("_b")]


def _likely(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` without most of those whose _text none of ``names`` (_text) has, so that texts that an exact join would drop don't travel to it.

    24 bits of each name are marked in a bitmap, of 2 MB whatever the number of names.  The exact join is an inner one
    with different names: Spark would move a semi join ahead of this.
    """
    slot = F.conv(F.hex(F.substring("_text", 1, 3)), 16, 10).cast("int")
    part, place = F.shiftright(slot, 15), slot.bitwiseAND(32767)
    marks = names.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_marks"))
    byte = F.conv(F.hex(F.substring(F.col("_marks"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_part", part).join(F.broadcast(marks), "_part").where(F.getbit(byte, place.bitwiseAND(7)) == 1)
    return marked.select(*rows.columns)


def _texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(_text, text) of ``members``: one row of each."""
    hashed = _likely(docs.select("text").mapInArrow(_tables.tidy(_named), "text string, _text binary"), members)
    return hashed.join(members.distinct(), "_text").groupBy("_text").agg(F.first("text").alias("text"))


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with ``linked`` and ``similarity``."""
    texts = _likely(texts, pairs.select(F.explode(F.array("_a", "_b")).alias("_text")))
    joined = pairs.join(texts.toDF("_a", "_a_text"), "_a").join(texts.toDF("_b", "_b_text"), "_b")
    return joined.mapInArrow(_tables.tidy(_verify), "_a binary, _b binary, linked boolean, similarity double")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (_text, _root) brought up to ``links`` (_a, _b)."""
    ends = links.join(roots.toDF("_a", "u"), "_a").join(roots.toDF("_b", "v"), "_b").select("u", "v")
    found = components(ends).toDF("_root", "_new")
    return roots.join(found, "_root", "left").select("_text", F.coalesce("_new", "_root").alias("_root"))


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots: the component's least node; each round is written to the shared folder."""
    return network.stars(edges, lambda df, instead: _tables.stored(df, f"{name}-edges", instead=instead))


def _settled(buckets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_text, _root) of texts with company, and the links that joined them."""
    members = _tables.stored(_company(buckets), "near-members", instead=buckets)
    hubs = _tables.stored(_hubs(members), "near-hubs")
    roots = _tables.stored(members.select("_text").distinct().withColumn("_root", F.col("_text")), "near-roots")
    tested: DataFrame | None = None

    def tell(pairs: DataFrame) -> None:
        """Tests ``pairs`` that have not been tested and joins what they link."""
        nonlocal tested, roots
        fresh = pairs if tested is None else pairs.join(tested, ["_a", "_b"], "left_anti")
        asked = _tables.stored(fresh, "near-pairs")
        found = _tables.stored(_tested(asked, texts), "near-tested", instead=asked)
        tested = found if tested is None else tested.unionByName(found)
        links = found.where("linked")
        if not links.isEmpty():
            roots = _tables.stored(_joined(roots, links), "near-roots", instead=roots)

    # every text meets one hub first, the one with most company of all: it joins large groups with a test for each text
    foremost = _met(members, hubs.select("_key", F.slice("_hubs", 1, 1).alias("_hubs")))
    tell(foremost.groupBy("_text").agg(F.min(F.struct("_order", "_hubbed")).alias("_x")).select(*_paired("_text", "_x._hubbed")).distinct())
    # then all hubs of its buckets that are not of its component
    tell(_met_apart(members, hubs, roots).select(*_paired("_text", "_hubbed")).distinct())
    # what hubs have not joined: small buckets pair by pair, large ones by their rare word pairs
    rest = members.join(roots, "_text")
    open_keys = rest.groupBy("_key").agg(F.min("_root").alias("_least"), F.max("_root").alias("_most")).where("_least <> _most")
    left = _tables.stored(rest.where("_size > 2").join(open_keys, "_key", "left_semi").select("_key", "_text", "n_words", "_size", "_root"), "near-left", instead=members)
    known = _likely(texts, left).join(left.select("_text").distinct(), "_text").mapInArrow(_tables.tidy(_parity), "_text binary, n_words long, _bits array<long>, _pair_bits array<long>")
    known = _tables.stored(known.join(roots, "_text"), "near-known")
    few = left.where(F.col("_size") <= FEW).select("_key", "_text")
    large = left.where(F.col("_size") > FEW).select("_text").distinct()
    many = _tables.stored(_likely(texts, large).join(large, "_text"), "near-many")
    often, shared = _counted(many)
    # texts of one largest group meet there, block by block; other pairs are few and come as rows
    homes = _tables.stored(_homes(few, _commonest(many, often, shared)), "near-homes")
    many = _tables.stored(many.join(homes, "_text"), "near-many", instead=many)
    keys = _tables.stored(few.unionByName(_between(many, often, shared).select("_key", "_text")), "near-rare")
    dense = _tables.stored(_met_in_cells(_cells(homes, known), _likely(texts, homes)), "near-tested")
    tested = tested.unionByName(dense)
    tell(_within(keys.join(homes, "_text"), known))
    if not dense.isEmpty():
        roots = _tables.stored(_joined(roots, dense), "near-roots", instead=roots)
    _tables.drop(keys, known, homes)
    _tables.drop(left, many, hubs)
    return roots, tested.where("linked").select("_a", "_b", "similarity")


def _within(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(_a, _b) of ``rows`` (_key, _text, _home) of one key and of different homes, whose components differ and that can be alike by length and parities.

    Homes of a key are paired off first, so that texts of one home never meet here.
    """
    rows = rows.join(known.select("_text", "_root"), "_text")
    home = rows.select("_key", "_home").distinct()
    apart = home.join(home.toDF("_key", "_o_home"), "_key").where("_home < _o_home")
    other = rows.toDF(*[c if c == "_key" else f"_o{c}" for c in rows.columns])
    met = apart.join(rows, ["_key", "_home"]).join(other, ["_key", "_o_home"]).where("_root <> _o_root").select(*_paired("_text", "_o_text")).distinct()
    one, two = (known.select(*[F.col(c).alias(f"{end}{c}") for c in ("_text", "n_words", "_bits", "_pair_bits")]) for end in ("_a", "_b"))
    differ = lambda c: sum((F.bit_count(F.col(f"_a{c}")[i].bitwiseXOR(F.col(f"_b{c}")[i])) for i in range(PARITY // 64)), F.lit(0))
    allowed = F.floor(F.greatest("_an_words", "_bn_words") * F.lit(round(100 * (1 - SIMILAR))) / 100)
    can = _near("_an_words", "_bn_words") & (differ("_bits") <= 2 * allowed) & (differ("_pair_bits") <= 4 * allowed)
    return met.join(one, F.col("_a") == F.col("_a_text")).join(two, F.col("_b") == F.col("_b_text")).where(can).select("_a", "_b")


def _homes(few: DataFrame, rare: DataFrame) -> DataFrame:
    """(_text, _home): of a text's keys, those of ``few`` (_key, _text) and one of ``rare`` (_text, _key, _n), the one that most texts have; the least on ties."""
    size = few.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    keys = few.join(size, "_key").select("_text", "_key", "_n").unionByName(rare)
    best = keys.groupBy("_text").agg(F.max(F.struct("_n", (-F.col("_key")).alias("_k"))).alias("_b"))
    return best.select("_text", (-F.col("_b._k")).alias("_home"))


def _cells(homes: DataFrame, known: DataFrame) -> DataFrame:
    """Texts of one home, dealt to cells that hold every pair of them: (_home, _i, _j, _own, _text, n_words, _bits, _pair_bits, _root).

    A home's texts go to blocks of about ``BLOCK`` by hash, and each pair of blocks is a cell: a large
    home is many cells of bounded size, and a text comes to as many of them as its home has blocks.
    """
    blocks = homes.groupBy("_home").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_home", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("_text", F.lit(7)), F.col("_blocks")).cast("int")
    rows = homes.join(blocks, "_home").join(known, "_text").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("_home", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_text", "n_words", "_bits", "_pair_bits", "_root")


def _pairs_of_cell(cell: pa.Table) -> list[tuple[int, int]]:
    """Places of the pairs of a cell to be tested: of different components, and of lengths and parities that alike texts have."""
    size, own = cell["n_words"].to_numpy(), cell["_own"].to_numpy()
    root = cell["_root"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    bits = [np.stack(cell[c].to_numpy(zero_copy_only=False)).view(np.uint64) for c in ("_bits", "_pair_bits")]
    i, j = cell["_i"][0].as_py(), cell["_j"][0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = []
    for n, a in enumerate(left.tolist()):
        b = right[n + 1 :] if i == j else right
        b = b[(root[b] != root[a]) & (np.minimum(size[b], size[a]) >= np.maximum(size[b], size[a]) * SIMILAR)]
        for kind, most in zip(bits, (2, 4), strict=True):
            allowed = np.maximum(size[b], size[a]) * round(100 * (1 - SIMILAR)) // 100
            b = b[np.bitwise_count(kind[b] ^ kind[a]).sum(axis=1) <= most * allowed] if len(b) else b
        out += [(a, c) for c in b.tolist()]
    return out


def _met_in_cells(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(_a, _b, linked, similarity) of the pairs of cells that are alike; a text comes to a cell once, whatever the pairs it is in."""

    def run(cell: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes, float]] = []
        pairs = _pairs_of_cell(cell)
        if pairs:
            words, rows = word_hashes(cell["text"].combine_chunks())
            names = cell["_text"].to_pylist()
            span = [words[a:b] for a, b in zip(rows.tolist(), rows[1:].tolist())]
            for start in range(0, len(pairs), PAIRS):
                some = pairs[start : start + PAIRS]
                longest = [max(len(span[a]), len(span[b])) for a, b in some]
                edits = edits_within([(span[a], span[b]) for a, b in some], [n * round(100 * (1 - SIMILAR)) // 100 for n in longest])
                for (a, b), e, n in zip(some, edits.tolist(), longest, strict=True):
                    if e >= 0:
                        out.append((min(names[a], names[b]), max(names[a], names[b]), 1 - e / n))
        a, b, similarity = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([True] * len(a), pa.bool_()), pa.array(similarity, pa.float64())], ["_a", "_b", "linked", "similarity"])

    whole = cells.join(texts, "_text")
    return whole.groupBy("_home", "_i", "_j").applyInArrow(run, "_a binary, _b binary, linked boolean, similarity double")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, class_id, links_found, kept and a hash of its text), and the links that joined texts."""
    raw = docs.select("doc_id", "text", F.xxhash64("text").alias("_raw"))
    sketches = _tables.stored(raw.mapInArrow(_tables.tidy(_sketch), "doc_id long, _raw long, _text binary, n_words long, _picks array<long>"), "near-sketches")
    # the texts: copies count once; picks of equal texts are equal
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_raw").alias("raw"))
    nodes = sketches.groupBy("_text").agg(F.min(row).alias("_first"), F.first("n_words").alias("n_words"), F.first("_picks").alias("_picks"))
    nodes = _tables.stored(nodes, "near-nodes")
    # rows keep their text's name alone
    sketches = _tables.stored(sketches.select("doc_id", "_raw", "_text"), "near-rows", instead=sketches)
    members = nodes.where("n_words > 0").select("_text", "n_words", F.explode("_picks").alias("_key"))
    size = members.groupBy("_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    buckets = _tables.stored(members.join(size, "_key"), "near-buckets")
    nodes = _tables.stored(nodes.drop("_picks"), "near-nodes", instead=nodes)
    texts = _tables.stored(_texts(buckets.select("_text").distinct(), docs), "near-texts")
    roots, links = _settled(buckets, texts)
    degree = links.select(F.explode(F.array("_a", "_b")).alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("links_found"))
    rooted = (
        nodes.select("_text", "_first")
        .join(roots, "_text", "left")
        .join(degree, "_text", "left")
        .select("_text", "_first", F.coalesce("_root", "_text").alias("_root"), F.coalesce("links_found", F.lit(0)).alias("links_found"))
    )
    rooted = _tables.stored(rooted, "near-rooted", instead=roots)
    _tables.drop(texts, nodes)
    ids = rooted.groupBy("_root").agg(F.min("_first").alias("_class"))
    named = rooted.join(ids, "_root").select("_text", "_class", "links_found")
    rows = sketches.select("doc_id", "_raw", "_text").join(named, "_text")
    kept = F.col("doc_id").eqNullSafe(F.col("_class.id")) & F.col("_raw").eqNullSafe(F.col("_class.raw"))
    return rows.select("doc_id", F.col("_class.id").alias("class_id"), "links_found", kept.alias("kept"), "_raw"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, links_found (links to different texts that the tests needed, not all there are) and kept.

    ``kept`` marks one document of each class; rows that repeat it in doc_id and text are marked, too.
    """
    return classes(docs)[0].drop("_raw")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, and of rows with that id the one whose text is kept.

    Columns travel in a struct, so that their names can't clash with those used here.
    """
    # keys are never null, so documents are dealt once for the join and for the window behind it
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    rows = classes(docs)[0].where("kept").select(*keys, "_raw").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), *keys, F.xxhash64("text").alias("_raw"))
    kept = whole.join(rows, ["_id", "_none", "_raw"])
    again = F.row_number().over(Window.partitionBy("_id", "_none", "_raw").orderBy(F.lit(1)))
    return kept.withColumn("_n", again).where("_n = 1").select("_doc.*")
