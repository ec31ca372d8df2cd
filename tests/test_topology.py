"""Split forks against plain loops, and networks that stay whole."""

import cmath
import math

import numpy as np

from pacegrid.operators import topology

NODES, STREETS = "node long, x double, y double, crossing boolean", "eid long, u long, v long, highway string, name string, oneway boolean, crossing boolean, metres double"


def town(seed):
    rng = np.random.default_rng(seed)
    place = {r * 8 + c: (c * 100 + float(rng.integers(-25, 26)), r * 100 + float(rng.integers(-25, 26))) for r in range(8) for c in range(8)}
    ways = [(n, m) for n in place for m in (n + 1, n + 8, n + 9, n + 7) if m in place and abs(place[n][0] - place[m][0]) < 160]
    streets = [(k, *((a, b) if rng.random() < 0.5 else (b, a)), str(rng.choice(["residential", "primary", "footway"], p=[0.6, 0.3, 0.1])), [None, "", "A", "B", "C"][rng.choice(5, p=[0.05, 0.05, 0.6, 0.2, 0.1])], bool(rng.random() < 0.6), bool(rng.random() < 0.04), 100.0) for k, (a, b) in enumerate(ways) if rng.random() < 0.8]
    streets.append((5000, 3, 3, "residential", "A", True, False, 10.0))
    return [(n, *p, bool(rng.random() < 0.05)) for n, p in place.items()], streets


def plain(nodes, streets):
    """{node: (streets that move, new place)} with complex numbers."""
    place = {n: complex(x, y) for n, x, y, _ in nodes}
    out = {}
    for n, _, _, crossing in nodes:
        own = sorted((s[0], place[s[2] if s[1] == n else s[1]] - place[n], s) for s in streets if n in s[1:3] and s[1] != s[2])
        if crossing or any(s[6] for _, _, s in own):
            continue
        names = {}
        for e, d, s in own:
            if s[3] in topology.STREETS and s[4]:
                names.setdefault(s[4], []).append((e, d, s[5]))
        turn = lambda a, b: abs(math.degrees(cmath.phase(a / b)))
        for group in sorted(names.values(), key=lambda g: g[0][0]):
            pair = next(((a, b) for i, a in enumerate(group) for b in group[i + 1 :] if turn(a[1], b[1]) < 40), None)
            if len(group) < 3 or sum(o for *_, o in group) < 2 or pair is None:
                continue
            axis = -(pair[0][1] / abs(pair[0][1]) + pair[1][1] / abs(pair[1][1]))
            axis /= abs(axis)
            off = [(e, (d / abs(d) / axis).imag) for e, d, _ in own if e in (pair[0][0], pair[1][0]) or turn(d, axis) >= 50]
            moved = {e for e, side in off if side < 0}
            if all(abs(side) >= 0.05 for _, side in off) and 0 < len(moved) < len(own):
                out[n] = (moved, place[n] + 1.5j * axis)
                break
    return out


def test_forks_equal_plain_loops(spark):
    seen = 0
    for seed in (1, 2, 3):
        nodes, streets = town(seed)
        new_nodes, new_streets = (df.collect() for df in topology.split(spark.createDataFrame(nodes, NODES), spark.createDataFrame(streets, STREETS).repartition(3)))
        want = plain(nodes, streets)
        seen += len(want)
        top, last = max(n[0] for n in nodes) + 1, max(s[0] for s in streets) + 1
        place = {r.node: complex(r.x, r.y) for r in new_nodes}
        assert set(place) == {n[0] for n in nodes} | {n + top for n in want} and all(abs(place[n + top] - p) < 1e-9 for n, (_, p) in want.items())
        got = {r.eid: r for r in new_streets}
        assert len(got) == len(new_streets) == len(streets) + len(want) and all(r.u in place and r.v in place for r in new_streets)
        for e, u, v, *_ in streets:
            assert (got[e].u, got[e].v) == tuple(n + top if n in want and e in want[n][0] else n for n in (u, v)) and not got[e].link
        assert all((got[n + last].u, got[n + last].v, got[n + last].link, got[n + last].metres) == (n, n + top, True, 15.0) for n in want)
    assert seen > 15


def test_nothing_to_split(spark):
    nodes, streets = spark.createDataFrame([(0, 0.0, 0.0, False), (1, 100.0, 0.0, False)], NODES), spark.createDataFrame([(0, 0, 1, "residential", "A", True, False, 100.0)], STREETS)
    kept, ways = topology.split(nodes, streets)
    assert kept.count() == 2 and [(r.u, r.v) for r in ways.collect()] == [(0, 1)]
    kept, ways = topology.split(nodes.limit(0), streets.limit(0))
    assert kept.count() == 0 and ways.count() == 0
