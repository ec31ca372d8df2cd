"""Token ids in flat unsigned files, read back memory-mapped.

Documents are dealt to tasks by ranges of doc_id and sorted, so a part's place
is its number.  Each task writes three files: ids (16-bit unsigned if the
vocabulary allows, else 32-bit), 64-bit document offsets into them (one more than
there are documents), and 64-bit doc_ids; all little-endian.  A manifest row per
part is what a finished task returns; files of attempts that were lost have no
row and are never read.  Part bases are prefix sums over the manifest.

Encoding goes word by word: the tokenizer never joins across white space, and a
run of full stops or commas after an ASCII letter or digit is a piece of its own,
so each distinct word is encoded once for many documents.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts
first and is stored as the least 64-bit integer; equal doc_ids lie side by side,
in the order of a hash of their texts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _text

END = 1
NO_KEY = np.iinfo(np.int64).min
SLICE_BYTES = 8 << 20
#: Distinct words whose ids a Python process remembers.
REMEMBERED = 1_000_000


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in the shared storage."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


#: Texts on which word-by-word encoding must agree with the tokenizer before it is used.
PROBES = [
    "", " ", "A b", "don't. stop, a.b 3.14", "x.,. y..", " lead", "trail ", "\ta\n\nb\r\n", "<|endoftext|> <|ENDOFTEXT|>.", "É. Σας ß", "a,b c, d.", "😀 ok", "e\u0301 \u00a0 \u3000x", "### $$$ %%%",
    "The QUICK (brown) fox's \"den\"; 1,000.50!", "a" * 300, "word. Word, WORD", "\u200bzero", "中文 字,符.", "-- - _ __x",
]


class Encoder:
    """Ids of whole texts; every distinct word goes through the tokenizer once.

    Words on their own give the ids of the whole text only if the vocabulary lowers case
    and parts words from punctuation as it is done here.  That is tried on ``PROBES``; with
    a vocabulary that differs on any, whole texts go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known, self.flat, self.size = pa.array([], pa.large_string()), np.zeros(0, self.type), np.zeros(0, np.int64)
        self.ends = self._ends()
        plain = [e.ids + [END] for e in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        self.by_words = all(self._by_words(pa.array([p]))[0].tolist() == want for p, want in zip(PROBES, plain, strict=True))

    def _ends(self) -> np.ndarray | None:
        """Which ids end a piece, if the vocabulary marks them."""
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not mark:
            return None
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(mark)]] = True
        return ends

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has.

        Plain words, of the letters a to z and A to Z, are one piece each, and its last id is one that ends a piece: many of them go
        through the tokenizer as one text and are told apart by those ids.
        """
        if self.ends is None:
            return self._singly(words)
        text = " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or len(ids) and last[-1] != len(ids) - 1:
            return self._singly(words)
        return ids, np.diff(last, prepend=-1)

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.type, int(size.sum())), size

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and how many each has: of words met before from ``known``, which is begun anew when it is full."""
        if len(self.known) > REMEMBERED:
            self.known, self.flat, self.size = pa.array([], pa.large_string()), np.zeros(0, self.type), np.zeros(0, np.int64)
        at = pc.index_in(words, self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        plain = pc.match_substring_regex(fresh, "^[A-Za-z]+$").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        fresh = fresh.take(pa.array(order))
        several, many = fresh.to_pylist(), int(plain.sum())
        parts = [self._coded(several[i : min(i + 1000, many)]) for i in range(0, many, 1000)]
        parts += [self._singly(several[i : i + 20_000]) for i in range(many, len(several), 20_000)]
        at[new[order]] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat = np.concatenate([self.flat, *(x for x, _ in parts)])
        self.size = np.concatenate([self.size, *(n for _, n in parts)])
        size = self.size[at]
        group, inside = _text.ragged(size)
        return self.flat[(np.cumsum(self.size) - self.size)[at][group] + inside], size

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END, and row offsets into them."""
        if self.by_words:
            return self._by_words(column)
        ids = [e.ids + [END] for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.type), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = _text.text_bytes(column)
        text = _text.strings(raw, bounds)
        # the normaliser lowers case anyway; only the names of special tokens must stay as they are
        if not pc.any(pc.match_substring(text, "<|")).as_py():
            text = _text.strings(_text.fold_case(raw), bounds)
        text = pc.replace_substring_regex(text, r"([A-Za-z0-9])([.,]+)(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(text)
        coded = split.flatten().dictionary_encode()
        flat, size = self._ids(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.asarray(split.offsets)
        total = np.concatenate([[0], np.cumsum(size[at])])[rows] + np.arange(len(rows))
        out = np.full(int(total[-1]), END, self.type)
        group, inside = _text.ragged(size[at])
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        out[np.arange(len(group)) + row[group]] = flat[(np.cumsum(size) - size)[at][group] + inside]
        return out, total


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """The manifest (part, name, n_docs, n_tokens) of files written to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        store, path = place(folder)
        store.create_dir(path)
        documents = tokens = 0
        with (
            store.open_output_stream(f"{path}/{name}.bin") as ids_file,
            store.open_output_stream(f"{path}/{name}.off") as offsets_file,
            store.open_output_stream(f"{path}/{name}.key") as keys_file,
        ):
            offsets_file.write(np.zeros(1, "<i8"))
            for batch in batches:
                for rows in _text.slices(batch, "text", SLICE_BYTES):
                    ids, bounds = own(rows.column("text"))
                    ids_file.write(ids)
                    offsets_file.write((bounds[1:] + tokens).astype("<i8"))
                    keys_file.write(rows.column("doc_id").fill_null(NO_KEY).to_numpy(zero_copy_only=False).astype("<i8"))
                    documents += rows.num_rows
                    tokens += len(ids)
        if documents:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "width": [own.type.itemsize], "n_docs": [documents], "n_tokens": [tokens]})
        else:
            for end in ("bin", "off", "key"):
                store.delete_file(f"{path}/{name}.{end}")

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "part long, name string, width long, n_docs long, n_tokens long")


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped on a mounted store, read where there is none."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file = f"{path}/{row['name']}"
                ids, offsets, keys = (_mapped(store, f"{file}.{end}", kind) for end, kind in (("bin", f"<u{row['width']}"), ("off", "<i8"), ("key", "<i8")))
                for start in range(0, len(keys), 10_000):
                    bounds = offsets[start : start + 10_001]
                    key = np.asarray(keys[start : start + 10_000])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, mask=key == NO_KEY), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = max(1, manifest.count())
    return based.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents to new files in the shared folder and read them back."""
    folder = _tables.scratch(docs.sparkSession, "tokens")
    return read(_tables.stored(write(docs, vocabulary, folder), "tokens-manifest"), folder)
