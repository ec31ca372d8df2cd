"""A packed artifact per city: a JSON header, then one block per column; and its bands.

Layout: ``MAGIC``, version byte, header length (4 bytes), header, blocks.  The header
names columns, types, rows and the hash of the blocks; a reader refuses another
magic, an unknown version, a wrong length and a wrong hash.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"PGRD"
VERSIONS = (1,)
COLUMNS = {"eid": "<i8", "u": "<i8", "v": "<i8", "len_dm": "<u2", "noise_q": "u1", "surface_q": "u1", "green_q": "u1", "flags": "u1"}
#: Edges of one artifact; more of a city go to further parts.
MOST = 1 << 20


def pack(pdf: pd.DataFrame) -> bytes:
    blocks = b"".join(pdf[c].to_numpy().astype(t).tobytes() for c, t in COLUMNS.items())
    head = json.dumps({"columns": list(COLUMNS.items()), "rows": len(pdf), "hash": hashlib.sha256(blocks).hexdigest()[:16]}, sort_keys=True).encode()
    return MAGIC + bytes([VERSIONS[-1]]) + len(head).to_bytes(4, "little") + head + blocks


def unpack(data: bytes) -> pd.DataFrame:
    if data[:4] != MAGIC:
        raise ValueError("not an artifact")
    if data[4] not in VERSIONS:
        raise ValueError(f"version {data[4]} is unknown")
    size = int.from_bytes(data[5:9], "little")
    head, blocks = json.loads(data[9 : 9 + size]), data[9 + size :]
    if len(blocks) != head["rows"] * sum(np.dtype(t).itemsize for _, t in head["columns"]):
        raise ValueError("the blocks' length is wrong")
    if hashlib.sha256(blocks).hexdigest()[:16] != head["hash"]:
        raise ValueError("the blocks' hash is wrong")
    out, at = {}, 0
    for name, kind in head["columns"]:
        n = head["rows"] * np.dtype(kind).itemsize
        out[name] = np.frombuffer(blocks[at : at + n], kind).astype("int64")
        at += n
    return pd.DataFrame(out)


def packed(edges: DataFrame) -> DataFrame:
    """(city, part, data): artifacts of edges (city and COLUMNS), sorted by eid; a city may have several parts."""
    part = F.floor(F.col("eid") / (4 * MOST))

    def make(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"city": [key[0]], "part": [key[1]], "data": [pack(pdf.sort_values("eid"))]})

    return edges.select("city", *COLUMNS).withColumn("part", part).groupBy("city", "part").applyInPandas(make, "city long, part long, data binary")


def unpacked(artifacts: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for city, data in zip(pdf["city"], pdf["data"]):
                yield unpack(bytes(data)).assign(city=city)

    return artifacts.select("city", "data").mapInPandas(run, ", ".join(f"{c} long" for c in (*COLUMNS, "city")))
