"""Shade files: refusals, bands by name, and what is not opened."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.operators import store
from pacegrid.sources import bands


def test_files_refuse_what_is_wrong():
    payload = bytes(range(12))
    data = bands.pack(payload, bands.BANDED, 3, 2)
    assert bands.unpack(data, 8, 3, 2, 4) == payload and len(data) == 16 + 12
    cases = {
        "prefix": data[:9], "not a shade": b"XXXX" + data[4:], "version 7": bands.pack(payload, 7, 3, 2), "width 4": bands.pack(payload, 8, 4, 2), "index 1": bands.pack(payload, 8, 3, 1),
        "11 bytes": data[:-1], "hash": data[:-1] + b"\x00",
    }
    for what, bad in cases.items():
        with pytest.raises(ValueError, match=what):
            bands.unpack(bad, 8, 3, 2, 4)
    assert bands.widths(50, 8) == [8] * 6 + [2] and bands.widths(16, 8) == [8, 8]


def test_bands_of_minutes():
    ask = lambda first, last: bands.needed(first, last, 480, 15, 50, 8)
    assert ask(480, 480) == [0] and ask(585, 585) == [0, 1] and ask(584, 584) == [0] and ask(0, 2000) == list(range(7))
    assert ask(1215, 1300) == [6] and ask(1216, 1300) == [] and ask(0, 479) == [] and ask(600, 500) == []


def test_bands_are_the_days_and_only_wanted_ones_open(spark):
    rng = np.random.default_rng(1)
    rows = [(c, 10 * c + e, [int(x) for x in rng.integers(0, 256, 21)]) for c in range(3) for e in range(5)]
    files = bands.whole(spark.createDataFrame(rows, "city long, eid long, shade array<int>")).cache()
    split = store.stored(bands.rebanded(files, 21, 8), "test-bands", by="band")
    assert split.count() == 9 and bands.differing(files, split, 21, 8).isEmpty()
    got = {(r.city, r.eid, r.bucket): r.shade for r in bands.read(split, [0, 1, 2], 21, 8).collect()}
    assert got == {(c, e, k): s for c, e, series in rows for k, s in enumerate(series)}
    # one band is damaged: it raises, and so does the comparison; the others are read as before
    bad = split.withColumn("data", F.when((F.col("band") == 1) & (F.col("city") == 2), F.concat(F.expr("substring(data, 1, length(data) - 1)"), F.lit(b"\x07"))).otherwise(F.col("data")))
    broken = store.stored(bad, "test-bands", by="band")
    assert bands.read(broken, [0, 2], 21, 8).count() == 15 * 13 and bands.read(broken, [], 21, 8).count() == 0
    with pytest.raises(Exception, match="hash is wrong"):
        bands.read(broken, [1], 21, 8).collect()
    with pytest.raises(Exception, match="hash is wrong"):
        bands.differing(files, broken, 21, 8).collect()
    plan = bands.read(split, [1], 21, 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(band" in plan or "PartitionFilters: [band" in plan
    # a band that another file's bytes stand in differs
    swapped = split.withColumn("data", F.when(F.col("city") == 0, F.lit(bands.pack(bytes(40), 8, 8, 0))).otherwise(F.col("data"))).where("band = 0").unionByName(split.where("band <> 0"))
    assert [tuple(r) for r in bands.differing(files, swapped, 21, 8).collect()] == [(0, 0)]
    assert [r.city for r in bands.differing(files, split.where("NOT (city = 1 AND band = 2)"), 21, 8).collect()] == [1]
