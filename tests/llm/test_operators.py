"""Operators on small tables: odd rows, copies, ties, empty tables, clashing names."""

import math
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import _tables, html_text, media, mixing, near_dedup, quality, quality_rules, sentencepieces, token_files, toxicity

public = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = COLUMNS + ", _score double, _label string, _row long, _text string, size int, score string, kept int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "re", "st", "ou", "in"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        text = prose(rng, rng.randint(60, 90))
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            words = text.split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilescum", "idiotic", "wretched"])
            text = " ".join(words)
        if not good:
            text = " ".join(w + "$$#" for w in text.split())
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark, corpus):
    rows, labels = corpus
    odd = [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n", "en", None, 2), (1003, "word " * 30_000, "en", "s2", 150_000), (None, "no id here", "en", "s1", 10), (5, rows[5][1], "en", "s1", 9), (5, rows[5][1], "en", "s1", 9)]
    docs = spark.createDataFrame(rows + odd, COLUMNS).withColumns({"_score": F.lit(0.1), "_label": F.lit("x"), "_row": F.lit(7).cast("long"), "_text": F.lit("t"), "size": F.lit(1), "score": F.lit("s"), "kept": F.lit(0)})
    return docs.repartition(3).cache(), spark.createDataFrame([*labels, (1001, None, None), (None, 1, 1), (7, 0, 5)], "doc_id long, quality int, toxic int")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity(frames, corpus):
    docs, labels = frames
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == held(r.doc_id) for r in found if r.doc_id is not None)
    truth = {i: t for i, _, t in corpus[1]}
    right = [r.predicted == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]
    assert sum(right) > 0.9 * len(right)
    stays = toxicity.keep_ordinary(docs, labels)
    assert stays.schema == docs.schema and 0 < stays.count() < docs.count()
    nothing = toxicity.toxicity(docs.limit(0), labels.limit(0))
    assert nothing.count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_quality(frames, corpus):
    docs, labels = frames
    found = quality.quality(docs, labels).collect()
    truth = {i: q for i, q, _ in corpus[1]}
    right = [r.kept == bool(truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == docs.count() and sum(right) > 0.95 * len(right)
    assert quality.keep_good(docs, labels).schema == docs.schema
    assert quality.quality(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_quality_rules(frames, corpus):
    docs, labels = frames
    found = quality_rules.rules(docs, labels).collect()
    truth = {i: q for i, q, _ in corpus[1]}
    right = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in found if r.doc_id in truth and held(r.doc_id)]
    assert sum(right) > 0.95 * len(right)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in found)
    assert quality_rules.rules(docs.limit(0), labels.limit(0)).count() == 0


def test_mixing(frames):
    docs, _ = frames
    rows = mixing.mixing(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixing(docs.repartition(5)).collect())) and len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes, targets, taken = {}, {}, {}
    source = {}
    for r in docs.select("doc_id", "source").collect():
        source[r.doc_id] = r.source
    for r in rows:
        s = source[r.doc_id]
        sizes[s], targets[s] = sizes.get(s, 0) + r.size, r.target
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size >= r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, want, pot = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        level = (pot - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    want |= {s: level * weight[s] for s in left}
    for s in names:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(60, 0.01 * want[s])
    # the dual, by bisection: rates are exp(x * size), 2 at most, and sum to the target; copies are near to them
    chosen = {r.doc_id: (source[r.doc_id], r.size, r.taken // max(r.size, 1)) for r in rows if r.doc_id is not None and r.doc_id != 5}
    for s in names:
        mine = [(n, c) for t, n, c in chosen.values() if t == s and n]
        if want[s] >= 2 * sizes[s] - 1e-6:
            assert all(c == 2 for _, c in mine)
            continue
        sizes_of = [r.size for r in rows if source[r.doc_id] == s]
        if max(sizes_of) > 0.05 * sum(sizes_of):
            continue  # whole copies of one document are too coarse: the others make up for it
        low, high = -5.0, 1.0
        for _ in range(200):
            x = (low + high) / 2
            low, high = (x, high) if sum(min(2.0, math.exp(min(x * n, 1))) * n for n in sizes_of) < want[s] else (low, x)
        expected = sum(min(2.0, math.exp(min(low * n, 1))) for n, _ in mine)
        assert abs(sum(c for _, c in mine) - expected) <= 3 + 0.02 * expected
        small = [(n, c) for n, c in mine if n <= 80]
        assert abs(sum(c for _, c in small) - sum(min(2.0, math.exp(min(low * n, 1))) for n, _ in small)) <= 6 + 0.05 * len(small)
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema.names == docs.schema.names
    assert mixed.count() == sum(1 if r.size == 0 else r.taken // r.size for r in rows)
    assert mixing.mixing(docs.limit(0)).count() == 0


def test_mixing_of_many_sources_and_chains(spark, monkeypatch):
    """Chains of few documents and classes of many sizes still end near the target; 300 sources are ranked and filled."""
    monkeypatch.setattr(mixing, "CHAINED", 64)
    monkeypatch.setattr(mixing, "EXACT", 16)
    rng = random.Random(9)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 4 % 3000), "" if i % 2 else f"é{i % 300}" if i % 7 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.mixing(docs).collect()
    sizes, targets, taken, source = {}, {}, {}, {i: s for i, _, s in rows}
    for r in found:
        s = source[r.doc_id]
        sizes[s], targets[s], taken[s] = sizes.get(s, 0) + r.size, r.target, taken.get(s, 0) + r.taken
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, want, pot = set(names), {}, 1.5 * sum(sizes.values())
    while True:
        level = (pot - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    want |= {s: level * weight[s] for s in left}
    assert all(targets[s] == pytest.approx(want[s]) for s in names)
    assert abs(taken[""] - want[""]) <= 0.01 * want[""] and abs(sum(taken.values()) - pot) <= 0.01 * pot


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(25)]
    rows, shared = [], prose(rng, 30)
    for i, text in enumerate(base):
        rows.append((len(rows), text))
        for _ in range(i % 4):
            words = text.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), "  ".join(words)))
    rows += [(len(rows) + k, f"{prose(rng, 60)} {shared}") for k in range(20)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "one  two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit(1))
    words = {i: (t or "").split() for i, t in rows}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for a, b in combinations(words, 2):
        n = max(len(words[a]), len(words[b]))
        if abs(len(words[a]) - len(words[b])) <= n / 5 and 5 * distance(words[a], words[b]) <= n:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in words}
    one = near_dedup.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(got.values()))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_star(spark):
    """Variants are like their original but not like each other: it alone joins them."""
    rng = random.Random(11)
    original = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(original))]
    for i in range(1, 301):
        words = list(original)
        for at in rng.sample(range(150), 18):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, at = near_dedup.word_hashes(pa.array([t for _, t in rows]))
    picks = near_dedup.picks(words, at)
    meet = [i for i, _ in rows if (picks[i] == picks[0]).any()]
    # two rows of one doc_id and other texts, each of a class of its own but one: one row of each class stays
    docs = docs.unionByName(spark.createDataFrame([(0, "another text of the least id that is like none of the others at all"), (1, rows[1][1])], docs.schema))
    found = near_dedup.near_duplicates(docs).collect()
    got = {r.doc_id: r.class_id for r in found}
    assert len(meet) > 290 and all(got[i] == 0 for i in meet)
    assert near_dedup.one_of_each(docs).count() == len(rows) - len(meet) + 1 + 1


def test_few_texts_travel_and_shuffle_files_go(spark):
    """Texts that no name asks for stay where they are, and a stored table leaves no shuffle files behind."""
    name = F.unhex(F.md5(F.col("id").cast("string"))).alias("_text")
    texts, names = spark.range(20_000).select(name, "id"), spark.range(300).select(name)
    found = {r.id for r in near_dedup._likely(texts, names).collect()}
    assert set(range(300)) <= found and len(found) < 400
    assert near_dedup._likely(texts, names.limit(0)).count() == 0
    docs = spark.range(3000).select(F.concat_ws(" ", *[F.md5((F.col("id") * 7 + i).cast("string")) for i in range(6)]).alias("text"))
    few = _tables.stored(docs.limit(20).mapInArrow(near_dedup._named, "text string, _text binary").select("_text"), "few")
    plan = near_dedup._texts(few, docs)
    assert plan.count() == 20
    seen = plan._jdf.queryExecution().optimizedPlan().toString()
    # the exact join stands above the bitmap's: it would be dealt whole texts otherwise
    assert "LeftSemi" not in seen and "bitmap" in seen
    files = lambda: {f.getName() for f in _java_list(spark) if f.getName().startswith("shuffle_")}
    before = files()
    kept = _tables.stored(texts.groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 7


def _java_list(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_picks_find_pairs_over_the_whole_range():
    rng = random.Random(1)
    for n, similar in ((100, 0.8), (100, 0.85), (300, 0.8), (300, 0.9)):
        texts = []
        for _ in range(300):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), round(n * (1 - similar))):
                b[at] = f"v{rng.randrange(10**6)}"
            texts += [" ".join(a), " ".join(b)]
        keys = near_dedup.picks(*near_dedup.word_hashes(pa.array(texts)))
        assert (keys[0::2] == keys[1::2]).any(axis=1).mean() >= 0.9 - 0.03 * (similar == 0.8)


def test_a_bucket_of_many_unlike_texts_is_settled(spark):
    """Texts that share a passage fall in one bucket; the few pairs that are alike are found without pairing all."""
    rng = random.Random(8)
    passage = prose(rng, 70)
    rows = [(i, f"{prose(rng, 60)} {passage}") for i in range(400)]
    for i in range(0, 400, 20):
        words = rows[i][1].split()
        for at in rng.sample(range(60), 10):
            words[at] = f"changed{at}"
        rows.append((1000 + i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_near_duplicates_of_a_common_passage(spark, monkeypatch):
    """Texts that share most of their words: rows of the exact join don't grow with the group, and no link is lost."""
    rng = random.Random(11)
    kept = {}
    stored = _tables.stored

    def counting(df, name, instead=None):
        out = stored(df, name, instead)
        if name == "near-rare":
            kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup._tables, "stored", counting)
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join([*(f"x{rng.randrange(10**6)}" for _ in range(15)), *passage, *(f"y{rng.randrange(10**6)}" for _ in range(15))]) for _ in range(150)]
    # near copies of some, at ten places of a hundred
    for i in range(0, 30, 3):
        words = texts[i].split()
        for at in rng.sample(range(100), 10):
            words[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    words, at = near_dedup.word_hashes(pa.array(texts))
    spans = [words[a:b] for a, b in zip(at, at[1:])]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    linked = near_dedup.edits_within([(spans[i], spans[j]) for i, j in pairs], [20] * len(pairs)) >= 0
    least = list(range(len(texts)))
    for _ in range(3):
        for (i, j), yes in zip(pairs, linked, strict=True):
            if yes:
                least[i] = least[j] = min(least[i], least[j])
    assert linked.sum() >= 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == least
    assert kept["near-rare"] < 6 * len(texts)


def test_few_rare_pairs_are_enough():
    """Of alike texts with more and fewer words one of the first ``_enough`` word pairs of each is shared, in any order."""
    rng = np.random.default_rng(9)
    for n in (*range(4, 30), 64, 99):
        for m in range(n, n + n // 4 + 1):
            for _ in range(6):
                a = [f"a{i}" for i in range(n)]
                b, left = list(a), m // 5 - (m - n)
                if left < 0:
                    continue
                for at in rng.choice(n, left, replace=False):
                    b[at] = f"b{at}"
                for x in range(m - n):
                    b.insert(rng.integers(0, len(b) + 1), f"c{x}")
                key, group, size = near_dedup._pairs_of_words(pa.array([" ".join(a), " ".join(b)]))
                one, two = set(key[group == 0].tolist()), set(key[group == 1].tolist())
                # the worst order: what only one of them has comes first
                assert len(one - two) < near_dedup._enough(size)[0] and len(two - one) < near_dedup._enough(size)[1]


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "u long, v long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}


def test_token_files(frames):
    docs, _ = frames
    path = public.path("word_bpe_49k.json")
    rows = token_files.token_files(docs, path).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.select("doc_id", "text").collect())
    want, at = [], 0
    for (known, key), text in texts:
        ids = own.encode(text, add_special_tokens=False).ids + [1]
        want.append((key if known else None, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_files.token_files(docs.limit(0), path).count() == 0


def test_media_and_pieces(frames):
    import hashlib

    docs, _ = frames
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in media.media_column(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert re.fullmatch(r"512x\d+:[0-9a-f]{16}", r.feature)
    path = public.path("piece_bpe_32k.model")
    coded = sentencepieces.encode(docs, path)
    assert coded.where("NOT parity OR NOT round_trip").count() == 0 and coded.count() == docs.count()
    back = {r.doc_id: r.text for r in sentencepieces.decode(coded, path).collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    assert media.media_column(docs.limit(0)).count() == 0 and sentencepieces.encode(docs.limit(0), path).count() == 0


def test_pipeline(frames, spark, tmp_path):
    import corpus_pipeline

    docs, labels = frames
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert len(corpus_pipeline.STAGES) == 5 and out and all(r.parity and r.round_trip and len(r.ids) == r.n_tokens for r in out)
    assert corpus_pipeline.ORACLE_SQL is None


def test_copies_of_a_page_keep_their_text(spark):
    """Pages without article or main: copies are one content, a repeated branch still goes."""
    rng = random.Random(2)

    def page(body):
        return f"<html><body><div class='top'><div>our site</div></div><section class='text'><div>{body}</div></section></body></html>"

    few = [prose(rng, 30) for _ in range(3)]
    many = [prose(rng, 30) for _ in range(6)]
    rows = [(i, "http://one.org/a", page(few[0])) for i in range(40)]
    rows += [(100 + i, "http://three.org/a", page(few[i % 3])) for i in range(999)]
    rows += [(2000 + i, "http://many.org/a", page(many[i % 6])) for i in range(60)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == f"our site\n\n{few[0]}" for i in range(40))
    assert all(got[100 + i] == f"our site\n\n{few[i % 3]}" for i in range(999))
    assert all(got[2000 + i] == many[i % 6] for i in range(60))


def test_repeats_of_a_labelled_document_are_one_training_row(spark):
    """A labelled id that repeats 20,000 times, with two texts, is one row on the driver."""
    from pacegrid.llm import _tables

    key = next(i for i in range(100) if not held(i))
    docs = spark.range(20_000).selectExpr(f"CAST({key} AS LONG) AS doc_id", "CASE WHEN id % 2 = 0 THEN 'some text' ELSE 'other text' END AS text").unionByName(spark.createDataFrame([(i, f"text {i}") for i in range(200, 260)], "doc_id long, text string"))
    labels = spark.createDataFrame([(key, 1), *[(i, i % 2) for i in range(200, 260)]], "doc_id long, quality int")
    got = _tables.labelled_rows(docs, labels, "quality", {0: 5, 1: 7}, ["text"]).collect()
    assert len(got) <= 12 and len({r.doc_id for r in got}) == len(got)
    everyone = _tables.labelled_rows(docs, labels, "quality", {0: 100, 1: 100}, ["text"]).collect()
    assert [r.text for r in everyone if r.doc_id == key] in (["some text"], ["other text"])
