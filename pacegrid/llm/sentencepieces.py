"""SentencePiece models on the tokenizers library: encode, decode, verify.

``parse`` reads the model protobuf field by field (wire format, no generated
classes): pieces with scores and types, trainer and normaliser settings.
``build`` makes a tokenizers model of it: the dummy prefix and white space
collapsing of the normaliser, the metaspace marker, byte fallback, and either
unigram scores (model type 1) or, for a BPE model (type 2), whose scores are
ranks, the merges that those ranks stand for.

A piece never has the marker after another character, nor one of the characters
in ``isolated`` beside others; so a text may be cut before marker runs and around
such characters, and each distinct part is encoded once for a batch.  Every
distinct part is also encoded by the sentencepiece library, which is the parity
check; decoding goes from ids to bytes and is compared with the whole text.

Defined results: null and empty texts have no ids; a text's round trip holds if
its decoded bytes equal the normalised text.
"""

from __future__ import annotations

import struct
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pacegrid.llm import _tables, _text

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SLICE_BYTES = 4 << 20
#: Parts that are encoded in one call.
CALL = 4_096
#: Threads of the tokenizers library in a task.
THREADS = 2
#: Runs that are copied together: their places take eight bytes for each id or byte.
RUNS = 1 << 16


@dataclass
class Proto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True
    charsmap: bytes = b""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Proto:
    """Field numbers are those of the published sentencepiece_model.proto."""
    out = Proto()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.model_type = v
                elif n == 24:
                    out.suffix_marker = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.collapse = bool(v)
                elif n == 5:
                    out.escape = bool(v)
    return out


def build(proto: Proto):
    """A tokenizers.Tokenizer for one part: the marker is already in the text."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(proto.pieces) if p[2] == UNKNOWN), None)
    if proto.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in proto.pieces], unk_id=unknown, byte_fallback=proto.byte_fallback)
    elif proto.model_type == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(proto.pieces)}
        joinable = {p: s for p, s, kind in proto.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, score in joinable.items():
            cuts = [(piece[:n], piece[n:]) for n in range(1, len(piece)) if piece[:n] in joinable and piece[n:] in joinable]
            merges += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in cuts]
        merges.sort()
        model = models.BPE(
            ids, [(m[4], m[5]) for m in merges], fuse_unk=True, byte_fallback=proto.byte_fallback,
            unk_token=None if unknown is None else proto.pieces[unknown][0],
        )
    else:
        raise ValueError(f"model type {proto.model_type} has no counterpart")
    out = Tokenizer(model)
    if proto.charsmap:
        out.normalizer = normalizers.Precompiled(proto.charsmap)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if proto.dummy_prefix else []))
    special = [AddedToken(p, normalized=False, special=False) for p, _, kind in proto.pieces if kind == USER_DEFINED]
    if special:
        out.add_tokens(special)
    return out


def _joined(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``which`` names, one behind the other, and where each begins; ``RUNS`` at a time."""
    at = np.concatenate([[0], np.cumsum(size[which])])
    out = np.empty(int(at[-1]), flat.dtype)
    for start in range(0, len(which), RUNS):
        some = which[start : start + RUNS]
        group, place = _text.ragged(size[some])
        out[at[start] : at[start + len(some)]] = flat[first[some][group] + place]
    return out, at


class Codec:
    """Encodes and decodes batches of whole texts, one encoding per distinct part."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.proto = parse(data)
        if self.proto.suffix_marker or not self.proto.escape:
            raise ValueError("models with a suffix marker or without escaping aren't supported")
        self.tokenizer = build(self.proto)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        long = [p for p, _, kind in self.proto.pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1]
        self.cuts_at_marker = self.proto.model_type == BPE and not any(MARK in p.lstrip(MARK) for p in long)
        joined = set("".join(long))
        self.isolated = [c for c in "\n\t\r" if c not in joined] if self.proto.model_type == BPE else []
        pieces = []
        for piece, _, kind in self.proto.pieces:
            if kind == BYTE:
                pieces.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                pieces.append(b"")
            else:
                pieces.append((" ⁇ " if kind == UNKNOWN else piece.replace(MARK, " ")).encode())
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def normalised(self, column: pa.Array) -> pa.Array:
        """Texts with the dummy prefix and, if the model says so, single spaces."""
        text = column.cast(pa.large_string()).fill_null("")
        if self.proto.charsmap:
            text = pa.array([self.tokenizer.normalizer.normalize_str(t) for t in text.to_pylist()], pa.large_string())
        if self.proto.collapse:
            text = pc.utf8_trim(pc.replace_substring_regex(text, " +", " "), " ")
        if self.proto.dummy_prefix:
            filled = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
            text = pc.if_else(pc.equal(text, ""), text, filled)
        return text

    def _parts(self, text: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct parts, the part at each place, and row offsets into the places."""
        raw, bounds = _text.text_bytes(text)
        if not len(raw):
            return [], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        filled = bounds[:-1][np.diff(bounds) > 0]
        if self.cuts_at_marker:
            space = raw == 32
            cut[1:-1] = space[1:] & ~space[:-1]
        for c in self.isolated:
            here = np.flatnonzero(raw == ord(c))
            cut[here] = True
            cut[here + 1] = True
        cut[filled] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        offsets = pa.py_buffer(edges.astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(edges[:-1], bounds)

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts, their number in each, and whether the sentencepiece library agrees."""
        # the library reads this at every call; another operator may have turned it off in this worker
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        size: list[int] = []
        same: list[bool] = []
        for start in range(0, len(parts), CALL):
            text = [p.decode() for p in parts[start : start + CALL]]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.replace(" ", MARK) for t in text], add_special_tokens=False)]
            size += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found))))
            # the library adds its own prefix: parts with one go in without, others behind a line feed
            prefix = self.proto.dummy_prefix
            asked = [t[1:] if prefix and t[0] == " " else ("\n" + t if prefix else t) for t in text]
            for t, mine, theirs in zip(text, found, self.judge.encode(asked, num_threads=1), strict=True):
                if prefix and t == " ":
                    theirs = mine if len(mine) == 1 else []
                elif prefix and t[0] != " ":
                    theirs = theirs[2:]
                same.append(mine == theirs)
        return np.concatenate(ids), np.array(size, np.int64), np.array(same, bool)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, row offsets into them, and each row's parity."""
        parts, places, rows = self._parts(self.normalised(column))
        ids, size, same = self._encode_parts(parts)
        out, at = _joined(ids, np.cumsum(size) - size, size, places)
        ends = at[rows]
        agree = _text.row_sums(~same[places], rows) == 0 if len(places) else np.ones(len(rows) - 1, bool)
        return out, ends, agree

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and row offsets into them, with the dummy prefix still there."""
        raw, at = _joined(self.bytes, self.first, self.size, ids)
        return raw, at[ends]

    def round_trip(self, column: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw, bounds = _text.text_bytes(self.normalised(column))
        back, at = self.decode_bytes(ids, ends)
        sizes = np.diff(bounds) == np.diff(at)
        if len(raw) == len(back) and sizes.all():
            same = np.ones(len(sizes), bool)
            same[np.searchsorted(bounds, np.flatnonzero(raw != back), side="right") - 1] = False
            return same
        return np.array([ok and np.array_equal(raw[a:b], back[c:d]) for ok, a, b, c, d in zip(sizes, bounds, bounds[1:], at, at[1:])], bool)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts; bytes that aren't UTF-8 become replacement characters."""
        raw, bounds = self.decode_bytes(ids, ends)
        skip = 1 if self.proto.dummy_prefix else 0
        out = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return [t[skip:] if t[:1] == " " else t for t in out]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_bytes_fallback, parity, round_trip and, if asked, ``ids``.

    ``model`` is a path that every executor has.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_fallback long, parity boolean, round_trip boolean" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        fallback = np.array([kind == BYTE for _, _, kind in own.proto.pieces])
        for batch in batches:
            for part in _text.slices(batch, "text", SLICE_BYTES):
                text = part.column("text")
                found, ends, agree = own.encode(text)
                plain = found.astype("<u4")
                crc = [zlib.crc32(plain[a:b].data) if b > a else 0 for a, b in zip(ends, ends[1:])]
                columns = [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(_text.row_sums(fallback[found], ends)), pa.array(agree), pa.array(own.round_trip(text, found, ends))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(ends.astype(np.int32), found))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                del part, text, found, ends, agree, plain, crc, columns
                _tables.release()

    return docs.select("doc_id", "text").mapInArrow(_tables.tidy(run), schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.decode(flat, offsets), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
