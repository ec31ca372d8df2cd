import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacegrid.llm import html_text, media, sentencepieces, token_files, warc

public = pytest.importorskip("public_tokenizers")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=5))
def test_jpeg_round_trip(payloads):
    padded = [np.frombuffer(p + bytes(-len(p) % 64) if p else bytes(64), np.uint8) for p in payloads]
    pictures = [media.parse(j) for j in media.encode(padded)]
    grey = iter(media.luminance([p for many in pictures for p in many]))
    assert [b"".join(next(grey).tobytes() for _ in many) for many in pictures] == [p.tobytes() for p in padded]


def test_jpeg_of_several_pictures_and_colour():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 8195).astype(np.uint8)
    pictures = media.parse(media.encode([payload])[0])
    assert len(pictures) == 2 and b"".join(x.tobytes() for x in media.luminance(pictures)) == payload.tobytes()
    # two components, luminance twice as wide: one MCU of Y Y C, all DC steps 0
    head = media._head(1)
    sof = media._segment(media.SOF0, bytes([8, 0, 8, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0]))
    sos = media._segment(media.SOS, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    own = media._segment(media.SOF0, bytes([8]) + (8).to_bytes(2, "big") + (512).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    code, size = media._codes(media.DC_LENGTHS)[0]
    bits = (f"{code:0{size}b}" + "0") * 3
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    jpeg = head.replace(own, sof)[: -len(media._segment(media.SOS, bytes([1, 1, 0, 0, 63, 0])))] + sos + data + bytes([0xFF, media.EOI])
    assert media.luminance(media.parse(jpeg))[0].tolist() == [[128, 128]]
    with pytest.raises(ValueError):
        media.parse(bytes([0xFF, media.SOI]) + media._segment(0xC2, bytes(9)))


ODD = ["", " ", "  a  b ", "\n", "a\n\n b\t", "😀 ok", " lead", "trail ", "x" * 500, "\n a", "Ã\x00b", "don't. stop, a.b 3.14", "<|endoftext|> <|ENDOFTEXT|>.", "É. Σας"]


def test_sentencepiece_parity_and_round_trip():
    own = sentencepieces.Codec(public.path("piece_bpe_32k.model"))
    ids, ends, agree = own.encode(pa.array([*ODD, None]))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [*own.judge.encode(ODD), []]
    assert agree.all() and own.round_trip(pa.array([*ODD, None]), ids, ends).all()
    assert own.decode(ids, ends) == [*ODD, ""]


def test_token_encoder_is_the_tokenizer():
    own = token_files.Encoder(public.path("word_bpe_49k.json"))
    ids, ends = own(pa.array([*ODD, None]))
    want = [e.ids + [token_files.END] for e in own.tokenizer.encode_batch([*ODD, ""], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_unigram_models_are_rebuilt():
    proto = sentencepieces.Proto(pieces=[("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1)])
    assert sentencepieces.build(proto).encode("▁ab").ids == [3]


def _field(number, kind, payload):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return head + (bytes([len(payload) & 127 | 128, len(payload) >> 7]) + payload if kind == 2 else payload)


def test_unigram_models_encode_like_the_library(tmp_path):
    """A unigram model written by hand: scores, byte fallback, the marker, and pieces with the marker inside."""
    import struct

    words = {"▁": -3.0, "▁a": -3.5, "a": -4.0, "b": -4.2, "ab": -5.0, "▁ab": -5.1, "c": -4.4, "bc": -5.2, "abc": -6.5, "d": -4.9, "▁d": -5.5, "cd": -6.0, "é": -6.1, ".": -4.0, "a▁b": -7.0}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [(w, s, 1) for w, s in words.items()]
    proto = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([k]))) for p, s, k in pieces)
    proto += _field(2, 2, _field(3, 0, b"\x01") + _field(35, 0, b"\x01"))
    proto += _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01"))
    path = tmp_path / "unigram.model"
    path.write_bytes(proto)
    own = sentencepieces.Codec(str(path))
    rng = random.Random(4)
    texts = ["", " ", "  ", "a b", "ab abc", "é", "x", "中 a", None] + ["".join(rng.choice("aabbccd .éx") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    ids, ends, agree = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == own.judge.encode([t or "" for t in texts]) and agree.all()
    assert own.decode(ids, ends) == [t or "" for t in texts]


def test_vocabularies_that_keep_case_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"[UNK]": 0, "end": 1, "a": 2, "A": 3, "b": 4, ".": 5}, "[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    path = tmp_path / "own.json"
    plain.save(str(path))
    own = token_files.Encoder(str(path))
    ids, ends = own(pa.array(["a A", None, "b. A"]))
    assert not own.by_words and [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [[2, 3, 1], [1], [4, 5, 3, 1]]
    assert token_files.Encoder(public.path("word_bpe_49k.json")).by_words


def test_jpeg_with_a_scan_for_each_component():
    code, size = media._codes(media.DC_LENGTHS)[0]
    bits = f"{code:0{size}b}0" * 2
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    own = media._segment(media.SOF0, bytes([8]) + (8).to_bytes(2, "big") + (512).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    sof = media._segment(media.SOF0, bytes([8, 0, 8, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0]))
    start = media._head(1).replace(own, sof)[: -len(media._segment(media.SOS, bytes([1, 1, 0, 0, 63, 0])))]
    scans = b"".join(media._segment(media.SOS, bytes([1, c, 0, 0, 63, 0])) + data for c in (1, 2))
    assert media.luminance(media.parse(start + scans + bytes([0xFF, media.EOI])))[0].tolist() == [[128, 128]]
    deep = media._segment(media.SOF0 + 1, bytes([12, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    with pytest.raises(ValueError):
        media.parse(bytes([0xFF, media.SOI]) + deep)


def test_merkle_trees_are_brute_force(spark):
    """Roots by hand; records that only the replica has, or that it lacks, are told."""
    import hashlib

    rows = [("archive", p, i, 100 * p + i, 10 * i, 10 * i + 10, hashlib.sha256(b"%d %d" % (p, i)).hexdigest(), True) for p in range(3) for i in range(40)]
    other = [("replica", *r[1:]) for r in rows if (r[1], r[2]) != (1, 39)] + [("replica", 2, 40, 999, 400, 410, "ab", True)]
    other = [(*r[:6], "00", False) if (r[1], r[2]) == (0, 17) else r for r in other]
    leaf = spark.createDataFrame(rows + other, warc.NODE).cache()

    def root(copy):
        def up(nodes):
            return [(nodes[i][0], nodes[min(i + 15, len(nodes) - 1)][1], hashlib.sha256("\n".join(f"{a}:{b}:{d}" for a, b, d in nodes[i : i + 16]).encode()).hexdigest()) for i in range(0, len(nodes), 16)]

        tops = []
        for part in range(3):
            level = [(r[4], r[5], r[6]) for r in rows + other if r[0] == copy and r[1] == part]
            level.sort()
            while len(level) > 1:
                level = up(level)
            tops.append(level[0])
        lines = "\n".join(f"{a}:{b}:{d}" for a, b, d in tops)
        return hashlib.sha256(lines.encode()).hexdigest()

    top = {r["copy"]: r.digest for r in warc.tree(leaf)[0].collect()}
    assert top == {c: root(c) for c in ("archive", "replica")}
    found = {(r.part, r.seq): r.status for r in warc.audit(leaf, "archive", "replica").collect()}
    assert {k: v for k, v in found.items() if v != "intact"} == {(0, 17): "corrupt", (1, 39): "missing", (2, 40): "extra"} and len(found) == 121


def test_html():
    page = '<head><title>t</title></head><nav><li>menu</nav><header>site</header><div class="ad">buy</div><article><h1>T &amp; x</h1><p>One<br>two <b>three</b><p>Four<p class="notice">no</p><section id="comments"><p>c</section><footer>f</footer></article><aside>q</aside>'
    assert html_text.main_text(page, set()) == "T & x\n\nOne two three\n\nFour"
    assert [html_text.main_text(x, set()) for x in (None, "", "<p>", "a < b", "<div>x")] == ["", "", "", "a < b", "x"]
    assert html_text.main_text("<div>" * 5000 + "deep", set()) == "deep"


def test_style_tree_removes_what_pages_repeat(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=a1><p>Same line</p><p>Other same</p></div><div class=b1><p>text {i * i} {i}</p></div>") for i in range(12)] + [(99, None, None)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("text 9 3", 8) and got[99] == ("", 0) and len(got) == 13


def test_html_names_are_whole_words():
    kept = ['<section class="discussion"><p>x</p></section>', '<div class="no-sidebar">x</div>', '<h2 id="related-work">x</h2>', '<div class="side-by-side">x</div>', '<h2 id="how-to-search-for-ads">x</h2>']
    gone = ['<div class="cookie-banner">n</div>', '<div id="comments">n</div>', '<ul class="comment-list"><li>n</ul>', '<div hidden>n</div>', '<p class="adBox">n</p>', '<div role="search">n</div>', '<p><a class="ad"><div>n</div></a></p>']
    assert [html_text.main_text(f"<article>{x}</article>", set()) for x in kept] == ["x"] * len(kept)
    assert [html_text.main_text(f"<article><p>x</p>{x}</article>", set()) for x in gone] == ["x"] * len(gone)
    assert html_text.main_text('<article><p>a <span class="ad">buy <span>x</span> tail</span> b</p></article>', set()) == "a b"


def test_token_encoder_asks_for_many_words_at_once():
    """Words of plain letters share a call, words met before ask for none; ids are those of the whole text."""
    own = token_files.Encoder(public.path("word_bpe_49k.json"))
    plain = own.tokenizer
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **more)

    own.tokenizer = Counting()
    words = ["".join(chr(97 + (i // 26**j + 7 * j) % 26) for j in range(5)) for i in range(3000)]
    texts = [" ".join(words[:1500]), "don't It's 3.14 x", None, " ".join(w.upper() for w in words) + ", \u00e9t\u00e9 \U0001f600", "", "<|endoftext|> a"]
    for _ in range(2):
        ids, bounds = own(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t or "", add_special_tokens=False).ids + [token_files.END] for t in texts]
    assert len(asked) < 30


def test_html_of_hostile_pages_is_read_in_linear_time():
    import time

    for page in ('<a "' * 100_000, '<a "x>\' ' * 40_000, '<a b="c>' * 40_000 + '"', "<" * 400_000, "<!--" * 100_000, "<div>" * 80_000 + "x", "<p><span class=ad>" * 20_000):
        began = time.process_time()
        html_text.main_text(page, set())
        assert time.process_time() - began < 3


def test_style_trees_find_the_repeated_branches_of_labelled_pages(spark):
    """Unnamed branches inside and outside of articles, beside blocks of the article that pages share by chance."""
    rng = random.Random(6)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    fixed, rows, want = [words(12) for _ in range(3)], [], {}
    quote = words(9)
    for i in range(40):
        host, body = i % 4, [words(30), *([quote] if i % 8 < 2 else []), words(20)]
        inner = "".join(f"<p>{b}</p>" for b in body)
        page = (
            f"<body><div class='xq'><div>{fixed[0]}</div></div><article><div class='t1'>{inner}</div><div class='box7'><p>{fixed[1]}</p></div>"
            f"<section class='discussion'><p>{words(8)}</p></section></article><div class='zz'>{fixed[2]}</div></body>"
        )
        said = page[page.index("discussion") + 15 :].split("</p>")[0]
        rows.append((i, f"http://h{host}.org/{i}" if host else None, page))
        want[i] = "\n\n".join([*body, said])
    # one host of near copies of an article: no repetition to judge by
    copy = [words(40), words(6)]
    for i in range(100, 130):
        rows.append((i, f"http://copies.org/{i}", f"<body><article><div class='t1'><p>{copy[0]}</p><p>{copy[1]} {i % 3}</p></div></article></body>"))
        want[i] = f"{copy[0]}\n\n{copy[1]} {i % 3}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_host": F.lit("x"), "_salt": F.lit(1), "text": F.lit("t")})
    assert {r.page_id: r.text for r in html_text.extract(pages.repartition(4)).collect()} == want
    hosted = pages.withColumn("_host", F.coalesce(F.regexp_extract("url", "//([^/]+)", 1), F.lit("")))
    low = html_text.importance(hosted).where(F.col("importance") < html_text.LEAST).groupBy("_host").count().collect()
    assert {r["_host"]: r["count"] for r in low} == dict.fromkeys(["", "h1.org", "h2.org", "h3.org"], 3)  # two outside the article, one in it
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc(spark):
    rows = [(i, f"http://h.example/{i}" if i % 3 else None, "x" * i if i % 5 else None) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: r.status for r in warc.fixity(pages).collect()}
    assert {k for k, v in found.items() if v != "intact"} == {13, 110, 207} and len(found) == 300
    assert warc.fixity(pages.limit(0)).count() == 0
    data = b"".join(warc.record(*r) for r in rows[:7])
    parsed = list(warc.records(data))
    assert [f.get("WARC-Target-URI") for _, _, f, _ in parsed] == [r[1] for r in rows[:7]]
    assert [block.partition(b"\r\n\r\n")[2].decode() for _, _, _, block in parsed] == [r[2] or "" for r in rows[:7]]
    assert gzip.decompress(data[: parsed[0][1]]).startswith(b"WARC/1.1")


def test_monotonic_trees():
    from pacegrid.llm import trees

    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800)) < 0.6).astype(float)
    forest = trees.fit(x, y, np.ones(800), np.array([-1, 0, 1]), trees=30)
    assert ((forest.probability(x) >= 0.5) == y).mean() > 0.85
    line = np.tile([0.5, 0.5, 0.5], (50, 1))
    line[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(forest.raw(line)) <= 1e-9).all()
    line[:, 0], line[:, 2] = 0.5, np.linspace(0, 1, 50)
    assert (np.diff(forest.raw(line)) >= -1e-9).all()


def test_pieces_are_gathered_in_little_room():
    """A text's ids and bytes are copied in runs: places of all bytes at once took over thirty times the text."""
    import tracemalloc

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(100)]
    own = sentencepieces.Codec(public.path("piece_bpe_32k.model"))
    column = pa.array([*texts, None, ""])
    ids, ends, agree = own.encode(column)
    tracemalloc.start()
    assert own.round_trip(column, ids, ends).all() and agree.all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * sum(map(len, texts))
    ids[ends[7] + 3] = ids[0] if ids[ends[7] + 3] != ids[0] else ids[1]
    assert np.flatnonzero(~own.round_trip(column, ids, ends)).tolist() == [7]
