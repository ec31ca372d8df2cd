"""Shade series as files of whole days (version 7) and of bands of the day (version 8).

A file is a prefix of 16 bytes (magic, version, width in buckets, index, and the first 8 bytes of the
payload's SHA-256) and a byte for each edge and bucket, bucket after bucket.  So a band of a version 7
file is a run of its bytes, and a file is split into bands without working any shade out again.

Files lie in a Parquet table in folders by band: a reader names the bands it needs, and Spark
opens no other.  What it opens is refused if the magic, version, index, width, length or hash is wrong.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
MAGIC, WHOLE, BANDED = b"PGSH", 7, 8
_PREFIX = struct.Struct("<4sBBH8s")
#: Edges of one file; more of a city are further parts.
MOST = 1 << 20


def pack(payload: bytes, version: int, width: int, index: int) -> bytes:
    return _PREFIX.pack(MAGIC, version, width, index, hashlib.sha256(payload).digest()[:8]) + payload


def unpack(data: bytes, version: int, width: int, index: int, edges: int) -> bytes:
    """The payload of a file that is what its name says; raises what is wrong."""
    if len(data) < _PREFIX.size:
        raise ValueError("shorter than a prefix")
    magic, *said, hash8 = _PREFIX.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shade file")
    for what, has, wants in zip(("version", "width", "index"), said, (version, width, index), strict=True):
        if has != wants:
            raise ValueError(f"{what} {has} where {wants} is expected")
    payload = data[_PREFIX.size :]
    if len(payload) != width * edges:
        raise ValueError(f"{len(payload)} bytes for {edges} edges of {width} buckets")
    if hashlib.sha256(payload).digest()[:8] != hash8:
        raise ValueError("the hash is wrong")
    return payload


def widths(buckets: int, width: int) -> list[int]:
    """Plain chunks, the last one short."""
    return [min(width, buckets - first) for first in range(0, buckets, width)]


def whole(edges: DataFrame) -> DataFrame:
    """(city, part, eids, data): version 7 files of edges (city, eid, shade), edges ascending."""

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("eid")
        series = np.stack([np.asarray(s, np.uint8) for s in own["shade"]])
        return pd.DataFrame({"city": [key[0]], "part": [key[1]], "eids": [own["eid"].tolist()], "data": [pack(series.T.tobytes(), WHOLE, series.shape[1], 0)]})

    rows = edges.select("city", "eid", "shade", F.floor(C("eid") / (4 * MOST)).alias("part"))
    return rows.groupBy("city", "part").applyInPandas(make, "city long, part long, eids array<long>, data binary")


def rebanded(files: DataFrame, buckets: int, width: int) -> DataFrame:
    """(city, part, band, eids, data): version 8 files of version 7 ones: runs of their bytes, with a prefix of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                payload, n, at = unpack(bytes(r.data), WHOLE, buckets, 0, len(r.eids)), len(r.eids), 0
                for band, wide in enumerate(widths(buckets, width)):
                    out.append((r.city, r.part, band, r.eids, pack(payload[at * n : (at + wide) * n], BANDED, wide, band)))
                    at += wide
            yield pd.DataFrame(out, columns=["city", "part", "band", "eids", "data"])

    return files.mapInPandas(run, "city long, part long, band int, eids array<long>, data binary")


def differing(files: DataFrame, bands: DataFrame, buckets: int, width: int) -> DataFrame:
    """(city, part) whose bands, one after the other, are not the bytes of the version 7 file, or not all there; each pair is compared as a hash of its payloads."""
    wide = widths(buckets, width)

    def digest(version: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    n = len(r.eids)
                    if version == WHOLE:
                        payload, at = unpack(bytes(r.data), WHOLE, buckets, 0, n), np.concatenate([[0], np.cumsum(wide)]) * n
                        out += [(r.city, r.part, k, hashlib.sha256(payload[at[k] : at[k + 1]]).hexdigest()) for k in range(len(wide))]
                    else:
                        out.append((r.city, r.part, r.band, hashlib.sha256(unpack(bytes(r.data), BANDED, wide[r.band], r.band, n)).hexdigest()))
                yield pd.DataFrame(out, columns=["city", "part", "band", "hash"])

        return run

    schema = "city long, part long, band int, hash string"
    one, two = files.mapInPandas(digest(WHOLE), schema), bands.mapInPandas(digest(BANDED), schema)
    return one.exceptAll(two).unionByName(two.exceptAll(one)).select("city", "part").distinct()


def needed(first: float, last: float, start_min: float, step_min: float, buckets: int, width: int) -> list[int]:
    """Bands of a span of minutes, with the bucket that interpolation looks at behind its end; none where the span misses the window."""
    low, high = (first - start_min) / step_min, (last - start_min) / step_min
    if high < 0 or low > buckets - 1 or last < first:
        return []
    clamp = lambda k: min(max(int(k), 0), buckets - 1)
    return list(range(clamp(low) // width, clamp(int(high) + 1) // width + 1))


def read(bands: DataFrame, wanted: list[int], buckets: int, width: int) -> DataFrame:
    """(city, eid, bucket, shade) of the ``wanted`` bands of a table in folders by band; others are not opened."""
    wide = widths(buckets, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                n = len(r.eids)
                payload = np.frombuffer(unpack(bytes(r.data), BANDED, wide[r.band], r.band, n), np.uint8)
                bucket = np.repeat(np.arange(wide[r.band]) + width * r.band, n)
                yield pd.DataFrame({"city": r.city, "eid": np.tile(np.asarray(r.eids), wide[r.band]), "bucket": bucket, "shade": payload.astype(np.int64)})

    chosen = bands.where(C("band").isin(wanted)) if wanted else bands.limit(0)
    return chosen.select("city", "band", "eids", "data").mapInPandas(run, "city long, eid long, bucket long, shade long")
