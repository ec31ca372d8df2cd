"""Bytes as baseline JPEG pictures, and DC-only thumbnails of JPEG files.

``encode`` stores one byte in the DC coefficient of one 8x8 block: with a
quantiser of 8, a flat block of grey v has the quantised coefficient v - 128, so
the picture is lossless and its 1:8 thumbnail is the payload.  Every row of
blocks ends in a restart marker, so rows can be coded and decoded side by side.

``decode`` reads any baseline JPEG: markers, quantisers, Huffman tables, scans
of one or more components with subsampling and restarts.  Only the DC terms of
the luminance are kept: one sample per block.  All restart segments of all
pictures of a batch with equal tables are decoded together, one symbol of each
at a time.

A text is UTF-8, padded with zeros to a positive multiple of 64 bytes, in
pictures of at most ``MOST_BLOCKS`` blocks; longer texts take several, one after
the other.  Defined results: null texts are empty; equal texts have equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pacegrid.llm import _text

PAD = 64
WIDE = 64
#: 8,191 blocks are the most that a 16-bit height has, 8 pixels each.
MOST_ROWS = 8191
MOST_BLOCKS = WIDE * MOST_ROWS
SLICE_BYTES = 2 << 20

#: Fixed values of the JPEG format: markers, and code lengths of our two tables.
SOI, EOI, SOS, DQT, DHT, DRI, SOF0, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xD0
#: Symbols of the DC table (bits of a difference) by code length 1, 2, ...: small differences of letters are common.
DC_LENGTHS = {0: 5, 1: 5, 2: 4, 3: 3, 4: 2, 5: 3, 6: 3, 7: 3, 8: 5}
#: The AC table knows end of block alone.
AC_LENGTHS = {0: 1}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes (code, length) by symbol."""
    out, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    by = [sorted(s for s, n in lengths.items() if n == size) for size in range(1, 17)]
    return _segment(DHT, bytes([kind << 4, *map(len, by), *[s for row in by for s in row]]))


def _head(rows: int) -> bytes:
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return (
        bytes([0xFF, SOI])
        + _segment(DQT, bytes([0, 8, *[1] * 63]))
        + _segment(SOF0, frame)
        + _table(0, DC_LENGTHS)
        + _table(1, AC_LENGTHS)
        + _segment(DRI, WIDE.to_bytes(2, "big"))
        + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
    )


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference -255..255, end of block included."""
    dc, end = _codes(DC_LENGTHS), _codes(AC_LENGTHS)[0]
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc[n]
        code = code << n | (d if d >= 0 else d + (1 << n) - 1)
        bits[d + 255], size[d + 255] = code << end[1] | end[0], length + n + end[1]
    return bits, size


_BITS, _SIZE = _block_codes()


def _scan_rows(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of WIDE samples, stuffed, and row offsets into them."""
    rows = payload.reshape(-1, WIDE)
    # the prediction starts at 0 in each segment, the coefficient of grey 128
    steps = np.diff(rows.astype(np.int64) - 128, axis=1, prepend=0) + 255
    bits, size = _BITS[steps], _SIZE[steps]
    most = int(size.sum(axis=1).max(initial=0)) // 32 + 2
    words = np.zeros((len(rows), most), np.uint32)
    held, count = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    filled = np.zeros(len(rows), np.int64)
    line = np.arange(len(rows))
    for j in range(WIDE):
        held = held << size[:, j] | bits[:, j]
        count += size[:, j]
        full = np.flatnonzero(count >= 32)
        over = count[full] - np.uint64(32)
        words[line[full], filled[full]] = (held[full] >> over).astype(np.uint32)
        held[full] &= (np.uint64(1) << over) - np.uint64(1)
        count[full] = over
        filled[full] += 1
    # the last bits of a segment are filled up with ones
    gap = np.uint64(32) - count
    words[line, filled] = (held << gap | (np.uint64(1) << gap) - np.uint64(1)).astype(np.uint32)
    length = filled * 4 + (count.astype(np.int64) + 7) // 8
    plain = words.astype(">u4").view(np.uint8).reshape(len(rows), -1)
    inside = np.arange(plain.shape[1]) < length[:, None]
    flat = plain[inside]
    stuffed = np.flatnonzero(flat == 0xFF)
    out = np.insert(flat, stuffed + 1, 0) if len(stuffed) else flat
    ends = np.cumsum(length)
    return out, np.concatenate([[0], ends + np.searchsorted(stuffed, ends)])


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG (or several, one after the other) of each payload, multiples of PAD long."""
    scanned, at = _scan_rows(np.concatenate(payloads) if payloads else np.zeros(0, np.uint8))
    out, row = [], 0
    for payload in payloads:
        pictures = []
        for start in range(0, len(payload) // WIDE, MOST_ROWS):
            rows = min(MOST_ROWS, len(payload) // WIDE - start)
            pieces = [_head(rows)]
            for r in range(rows):
                pieces.append(scanned[at[row] : at[row + 1]].tobytes())
                row += 1
                if r < rows - 1:
                    pieces.append(bytes([0xFF, RST0 + r % 8]))
            pictures.append(b"".join(pieces) + bytes([0xFF, EOI]))
        out.append(b"".join(pictures))
    return out


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of the DC term
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | number: 16 counts and symbols
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC and AC table
    segments: list[bytes] = field(default_factory=list)
    seen: dict[int, bytes] | None = None  # tables defined so far, once the luminance has its own


def parse(data: bytes) -> list[Picture]:
    """Headers and unstuffed restart segments of the baseline JPEGs in ``data``."""
    pictures: list[Picture] = []
    at, now = 0, Picture()
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
            continue
        if marker == SOI:
            now = Picture()
            continue
        if marker == EOI:
            pictures.append(now)
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        at += size
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                now.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                (now.tables if now.seen is None else now.seen)[body[0]] = body[1:n]
                body = body[n:]
        elif marker == DRI:
            now.restart = int.from_bytes(body, "big")
        elif marker in (SOF0, SOF0 + 1):
            if body[0] != 8:
                raise ValueError("samples of more than 8 bits aren't baseline")
            now.height, now.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            now.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[i : i + 3] for i in range(6, 6 + 3 * body[5], 3))]
        elif SOF0 < marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError(f"frame type {marker:#x} isn't baseline")
        elif marker == SOS:
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            # components may have a scan each: the one that has the luminance counts, with the tables it finds
            wanted = not now.scan and bool(now.components) and scan[0][0] == now.components[0][0]
            if wanted:
                now.scan, now.tables, now.seen = scan, dict(now.tables), now.tables
            raw = np.frombuffer(data, np.uint8, offset=at)
            signs = np.flatnonzero(raw[:-1] == 0xFF)
            follow = raw[signs + 1]
            marks = signs[(follow != 0) & (follow != 0xFF)]
            stops = marks[(raw[marks + 1] < RST0) | (raw[marks + 1] > RST0 + 7)]
            stop = int(stops[0]) if len(stops) else len(raw)
            cuts = [0, *[x for m in marks[marks < stop].tolist() for x in (m, m + 2)], stop]
            whole = data[at : at + stop]
            if wanted:
                now.segments += [whole[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(cuts[::2], cuts[1::2])]
            at += stop
    return pictures


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol, 0 where there is no code."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length in range(1, 17):
        for symbol in table[16 + at : 16 + at + table[length - 1]]:
            out[code << 16 - length : (code + 1) << 16 - length] = length << 8 | symbol
            code += 1
        at += table[length - 1]
        code <<= 1
    return out


class _Bits:
    """Bit readers over many segments, which all move together."""

    def __init__(self, segments: list[bytes]):
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        raw = np.frombuffer(b"".join(s + b"\xff\xff\xff\xff" for s in segments), np.uint8).astype(np.uint32)
        wide = np.concatenate([raw, np.full(4, 255, np.uint32)])
        self.window = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]
        self.at = (np.cumsum(size + 4) - size - 4) * 8
        self.end = self.at + (size + 3) * 8

    def ahead(self, who: np.ndarray) -> np.ndarray:
        at = np.minimum(self.at[who], self.end[who])
        return (self.window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF


def _symbols(bits: _Bits, who: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = table[bits.ahead(who)]
    if not found.all():
        raise ValueError("no Huffman code fits")
    bits.at[who] += found >> 8
    return found & 255


def _block(bits: _Bits, who: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """DC differences of the next block of each segment; the AC terms are passed over."""
    size = _symbols(bits, who, dc).astype(np.int64)
    value = bits.ahead(who) >> (16 - size)
    bits.at[who] += size
    step = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
    term = np.ones(len(who), np.int64)
    left = np.arange(len(who))
    while len(left):
        symbol = _symbols(bits, who[left], ac)
        bits.at[who[left]] += symbol & 15
        term[left] += np.where(symbol == 0, 64, np.where(symbol == 0xF0, 16, (symbol >> 4) + 1))
        left = left[term[left] < 64]
    return step


def luminance(pictures: list[Picture]) -> list[np.ndarray]:
    """DC-only luminance of each picture: one 8-bit sample for each 8x8 block."""
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(pictures)
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        alike.setdefault((tuple(sorted(p.tables.items())), tuple(p.components), tuple(p.scan)), []).append(i)
    for which in alike.values():
        first = pictures[which[0]]
        tables = {k: _lookup(v) for k, v in first.tables.items()}
        shape = {c[0]: c for c in first.components}
        single = len(first.scan) == 1
        plan = [(n, *((1, 1) if single else shape[c][1:3]), tables[d], tables[16 | a]) for n, (c, d, a) in enumerate(first.scan)]
        across, down = (1, 1) if single else (max(c[1] for c in first.components), max(c[2] for c in first.components))
        grids, lengths, segments = [], [], []
        for i in which:
            p = pictures[i]
            if single:
                h, v = (max(c[k] for c in p.components) for k in (1, 2))
                wide, high = -(-(-(-p.width * p.components[0][1] // h)) // 8), -(-(-(-p.height * p.components[0][2] // v)) // 8)
            else:
                wide, high = -(-p.width // (8 * across)), -(-p.height // (8 * down))
            every = p.restart or wide * high
            lengths += [min(every, wide * high - s) for s in range(0, wide * high, every)]
            segments += p.segments
            grids.append((wide, high))
            if len(segments) != len(lengths):
                raise ValueError("segments and restart interval differ")
        length = np.array(lengths, np.int64)
        own = plan[0]
        terms = np.zeros((len(segments), int(length.max(initial=0)), own[1] * own[2]), np.int32)
        bits, value = _Bits(segments), np.zeros((len(plan), len(segments)), np.int64)
        for j in range(terms.shape[1]):
            who = np.flatnonzero(length > j)
            for n, x, y, dc, ac in plan:
                for b in range(x * y):
                    value[n, who] += _block(bits, who, dc, ac)
                    if n == 0:
                        terms[who, j, b] = value[0, who]
        at = 0
        for i, (wide, high) in zip(which, grids, strict=True):
            p, x, y = pictures[i], own[1], own[2]
            count = len(p.segments)
            blocks = terms[at : at + count][np.arange(terms.shape[1]) < length[at : at + count, None]]
            at += count
            grid = blocks.reshape(high, wide, y, x).transpose(0, 2, 1, 3).reshape(high * y, wide * x)
            grey = (grid * p.quantisers[shape[p.scan[0][0]][3]] + 4) // 8 + 128
            kept = np.clip(grey, 0, 255).astype(np.uint8)
            out[i] = kept[: -(-p.height * y // (8 * down)) or 1, : -(-p.width * x // (8 * across)) or 1]
    return out


def thumbnail_hash(grey: np.ndarray) -> str:
    """64 bits in hex: which of 8x8 areas are brighter than the whole."""
    rows, columns = (np.arange(9) * n // 8 for n in grey.shape)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    sums[1:, 1:] = grey.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    rows, columns = np.stack([rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)]), np.stack([columns[:-1], np.maximum(columns[1:], columns[:-1] + 1)])
    rows, columns = np.minimum(rows, grey.shape[0]), np.minimum(columns, grey.shape[1])
    area = np.diff(rows, axis=0).T * np.diff(columns, axis=0)
    part = sums[rows[1]][:, columns[1]] - sums[rows[0]][:, columns[1]] - sums[rows[1]][:, columns[0]] + sums[rows[0]][:, columns[0]]
    return np.packbits(part * grey.size > int(sums[-1, -1]) * area).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the JPEG bytes of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text", SLICE_BYTES):
                raw, bounds = _text.text_bytes(part.column("text"))
                size = np.diff(bounds)
                full = np.maximum(-(-size // PAD), 1) * PAD
                padded = np.zeros(int(full.sum()), np.uint8)
                ends = np.cumsum(full)
                group, inside = _text.ragged(size)
                padded[(ends - full)[group] + inside] = raw
                media = encode([padded[e - n : e] for e, n in zip(ends, full)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored pictures hold: dimensions, payload and hashes of the thumbnails."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "n_pictures"]

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        media = part.column("media").to_pylist()
        parsed = [parse(m) for m in media]
        grey = iter(luminance([p for pictures in parsed for p in pictures]))
        out = []
        for data, pictures in zip(media, parsed, strict=True):
            thumbs = [next(grey) for _ in pictures]
            payload = b"".join(t.tobytes() for t in thumbs)
            tail = zlib.crc32(payload[-PAD:])
            seen = ";".join(f"{p.width}x{p.height}:{thumbnail_hash(t)}" for p, t in zip(pictures, thumbs, strict=True))
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), tail, len(data), hashlib.sha256(data).hexdigest(), seen, pictures[0].width, sum(p.height for p in pictures), len(pictures)))
        columns = [pa.array(c) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum([0, *[len(m) for m in batch.column("media").to_pylist()]])
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(size, size[start] + SLICE_BYTES, side="right")) - 1)
                yield rows(batch.slice(start, stop - start))
                start = stop

    kinds = ["long", "long", "long", "string", "long", "long", "string", "string", "long", "long", "long"]
    return stored.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def media_column(docs: DataFrame) -> DataFrame:
    """Every whole text stored as JPEG, read back, with dimensions and hashes."""
    return features(store(docs))
