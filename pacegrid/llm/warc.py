"""WARC archives with Merkle trees, and a fixity audit of replicas.

``write`` stores pages as WARC/1.1 response records, one gzip member each, in one
file per task, with the record boundaries beside it.  ``leaves`` hashes the stored
bytes of every record of a copy.  ``tree`` hashes ordered runs of ``FANOUT``
nodes, offsets included, into the nodes above, up to a root of each file, and runs
of files likewise up to one root of the archive.  ``audit`` compares the roots
of two copies and descends through mismatching nodes alone, down to records.

Defined results: null html is an empty payload, a null url leaves the target
header out; repeated pages are records of their own; of an empty table there is
no file and no row; a record of any length is one leaf; other columns are not
stored.  Files of lost attempts have no manifest row and are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm import _tables
from pacegrid.llm.token_files import place

FANOUT = 16
DATE = "1970-01-01T00:00:00Z"
#: The drill of the query: the replica's records of these pages are damaged on its disk.
DRILL_EVERY, DRILL_AT = 97, 13
NODE = "copy string, part long, seq long, page_id long, start long, end long, digest string, valid boolean"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC response record, compressed as a gzip member of its own."""
    body = (html or "").encode()
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head += [
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(payload)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 1, mtime=0)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of the records of a ``.warc.gz``."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        plain = member.decompress(data[at:])
        size = len(data) - at - len(member.unused_data)
        head, _, rest = plain.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        yield at, size, fields, rest[: int(fields["Content-Length"])]
        at += size


def valid(data: bytes) -> bool:
    """Whether the bytes are one whole record whose payload has the digest that it states."""
    try:
        ((_, size, fields, block),) = records(data)
        payload = block.partition(b"\r\n\r\n")[2]
        return size == len(data) and fields.get("WARC-Payload-Digest") == f"sha256:{hashlib.sha256(payload).hexdigest()}"
    except (ValueError, KeyError, zlib.error):
        return False


def write(pages: DataFrame, folder: str) -> DataFrame:
    """The manifest (part, name, n_records, n_bytes) of files written to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        store, path = place(folder)
        store.create_dir(path)
        at, bounds, keys = 0, [0], []
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    data = record(*row)
                    out.write(data)
                    at += len(data)
                    bounds.append(at)
                    keys.append(row[0])
        if not keys:
            store.delete_file(f"{path}/{name}")
            return
        with store.open_output_stream(f"{path}/{name}.index", compression=None) as out:
            out.write(np.array(bounds, "<i8"))
            out.write(np.array([k is None for k in keys], "<i8"))
            out.write(np.array([k or 0 for k in keys], "<i8"))
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_records": [len(keys)], "n_bytes": [at]})

    return pages.select("page_id", "url", "html").mapInArrow(run, "part long, name string, n_records long, n_bytes long")


def _index(store, file: str) -> tuple[np.ndarray, list[int | None]]:
    with store.open_input_stream(f"{file}.index", compression=None) as f:
        raw = np.frombuffer(f.read(), "<i8")
    n = (len(raw) - 1) // 3
    return raw[: n + 1], [None if absent else int(k) for absent, k in zip(raw[n + 1 : 2 * n + 1], raw[2 * n + 1 :])]


def replicate(manifest: DataFrame, folder: str, target: str, drill: bool = False) -> DataFrame:
    """Copies all files to ``target``; the manifest of the copies.  A drill damages some records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, source = place(folder)
        into, path = place(target)
        into.create_dir(path)
        for batch in batches:
            for row in batch.to_pylist():
                bounds, keys = _index(store, f"{source}/{row['name']}")
                # a name of its own for each attempt: only a finished one is in the manifest
                name = f"{row['name']}.{uuid.uuid4().hex}"
                with store.open_input_file(f"{source}/{row['name']}") as f, into.open_output_stream(f"{path}/{name}", compression=None) as out:
                    for a, b, key in zip(bounds, bounds[1:], keys):
                        data = bytearray(f.read_at(int(b - a), int(a)))
                        if drill and key is not None and key % DRILL_EVERY == DRILL_AT:
                            data[len(data) // 2] ^= 1
                        out.write(bytes(data))
                yield pa.RecordBatch.from_pydict({"part": [row["part"]], "name": [name], "index": [row["name"]]})

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, "part long, name string, index string")


def leaves(manifest: DataFrame, folder: str, index: str, copy: str) -> DataFrame:
    """A leaf for each record of a copy, over its bytes at the places that the index states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = place(folder)
        own, origin = place(index)
        for batch in batches:
            for row in batch.to_pylist():
                bounds, keys = _index(own, f"{origin}/{row['index']}")
                with store.open_input_file(f"{path}/{row['name']}") as f:
                    digest, whole = [], []
                    for a, b in zip(bounds, bounds[1:]):
                        data = f.read_at(int(b - a), int(a))
                        digest.append(hashlib.sha256(data).hexdigest())
                        whole.append(valid(data))
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([copy] * n), pa.array([row["part"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(keys, pa.int64()), pa.array(bounds[:-1]), pa.array(bounds[1:]), pa.array(digest), pa.array(whole, pa.bool_())],
                    ["copy", "part", "seq", "page_id", "start", "end", "digest", "valid"],
                )

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, NODE)


def _level(nodes: DataFrame) -> DataFrame:
    """The level above: hashes of runs of at most FANOUT nodes, with their ranges, in order."""
    child = F.array_sort(F.collect_list(F.struct("part", "seq", "start", "end", "digest")))
    line = F.transform(child, lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["digest"]))
    return nodes.groupBy("copy", F.col("up_part").alias("part"), F.col("up_seq").alias("seq")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.concat_ws("\n", line), 256).alias("digest")
    )


def _under(nodes: DataFrame, in_file: bool, at_file: bool) -> DataFrame:
    """``nodes`` with the place (up_part, up_seq) of the node above each."""
    by = F.col("part") if at_file else F.col("seq")
    up_part = F.col("part") if in_file else F.lit(-1).cast("long")
    return nodes.withColumns({"up_part": up_part, "up_seq": F.floor(by / FANOUT)})


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the archive's root down to the leaves; each above the leaves is written once.

    In a level of the files, ``part`` is a file and ``seq`` a run of its records;
    above their roots ``part`` is -1 and ``seq`` a run of files.
    """
    most = leaf.agg(F.max("seq"), F.max("part")).first()
    records, files = (0, 0) if most[0] is None else (most[0] + 1, most[1] + 1)
    now = leaf.select("copy", "part", "seq", "start", "end", "digest")
    levels: list[DataFrame] = []
    while records > 1:
        levels.append(_under(now, True, False))
        now, records = _tables.stored(_level(levels[-1]), "warc-level"), -(-records // FANOUT)
    at_file = True
    while files > 1 or at_file:
        levels.append(_under(now, False, at_file))
        now, files, at_file = _tables.stored(_level(levels[-1]), "warc-level"), -(-files // FANOUT), False
    levels.append(_under(now, False, False))
    return levels[::-1]


def mismatches(levels: list[DataFrame], one: str, other: str) -> DataFrame:
    """(part, seq, _a, _b) of leaves that differ: below the root, only children of nodes that differ are compared."""
    suspect: DataFrame | None = None
    for nodes in levels:
        if suspect is not None:
            above = suspect.select(F.col("part").alias("up_part"), F.col("seq").alias("up_seq"))
            nodes = nodes.join(above, ["up_part", "up_seq"], "left_semi")
        a = nodes.where(F.col("copy") == one).select("part", "seq", F.col("digest").alias("_a"))
        b = nodes.where(F.col("copy") == other).select("part", "seq", F.col("digest").alias("_b"))
        # written, so that a level's plan holds that level alone
        suspect = _tables.stored(a.join(b, ["part", "seq"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))), "warc-suspect")
    return suspect


def audit(leaf: DataFrame, one: str, other: str) -> DataFrame:
    """One row per record of copy ``one``, and of those that only ``other`` has: its place, both digests and ``status``.

    ``valid`` says whether the record at hand can be read back with the payload digest it states.
    """
    found = mismatches(tree(leaf), one, other)
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("corrupt")
    named = found.select("part", "seq", F.col("_b").alias("other_sha256"), status.alias("status"))
    own = leaf.where(F.col("copy") == one).join(named.where("status <> 'extra'"), ["part", "seq"], "left")
    more = leaf.where(F.col("copy") == other).join(named.where("status = 'extra'"), ["part", "seq"])
    same = F.col("status").isNull()
    return own.unionByName(more).select(
        "page_id", "part", "seq", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"),
        F.when(~F.coalesce(F.col("status") == "extra", F.lit(False)), F.col("digest")).alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"),
        F.when(same, F.col("digest")).otherwise(F.col("other_sha256")).alias("replica_sha256"), "valid",
    )


def fixity(pages: DataFrame, drill: bool = True) -> DataFrame:
    """Archive ``pages``, replicate the archive, and audit the replica against it.

    With ``drill``, records of pages with ``page_id % 97 = 13`` are damaged in the
    replica, so that the audit has something to find.
    """
    spark = pages.sparkSession
    folder, target = _tables.scratch(spark, "warc"), _tables.scratch(spark, "warc-replica")
    manifest = _tables.stored(write(pages, folder), "warc-manifest")
    copies = _tables.stored(replicate(manifest, folder, target, drill), "warc-copied")
    own = leaves(manifest.withColumn("index", F.col("name")), folder, folder, "archive")
    copied = leaves(copies, target, folder, "replica")
    return audit(_tables.stored(own.unionByName(copied), "warc-leaves"), "archive", "replica")
