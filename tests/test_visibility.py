"""Visible ways against points sampled along every line."""

import math

import numpy as np

from pacegrid.operators import visibility


def star(rng, n, low, high, x, y):
    turn = np.sort(rng.random(n)) * 2 * math.pi
    size = low + rng.random(n) * (high - low)
    return [(float(round(x + r * math.cos(t), 1)), float(round(y + r * math.sin(t), 1))) for r, t in zip(size, turn)]


def leaves(rings, a, b):
    """How far the line from a to b leaves the area at most, by 600 points."""
    t = np.linspace(0, 1, 602)[1:-1, None]
    p = np.array(a) + t * (np.array(b) - np.array(a))
    inside, off = np.zeros(len(p), bool), np.full(len(p), np.inf)
    for ring in rings:
        c, d = np.array(ring), np.roll(np.array(ring), -1, axis=0)
        for (x1, y1), (x2, y2) in zip(c, d):
            if y1 != y2:
                inside ^= ((y1 > p[:, 1]) != (y2 > p[:, 1])) & (p[:, 0] < (x2 - x1) * (p[:, 1] - y1) / (y2 - y1) + x1)
            v = np.array([x2 - x1, y2 - y1])
            s = np.clip(((p - [x1, y1]) @ v) / (v @ v), 0, 1)
            off = np.minimum(off, np.hypot(*(p - [x1, y1] - s[:, None] * v).T))
    return 0.0 if inside.all() else float(off[~inside].max())


def test_visible_ways_equal_sampled_lines(spark):
    rng = np.random.default_rng(8)
    areas, corners, nodes = {}, [], []
    for area in range(4):
        rings = [star(rng, 14, 60, 260, 300.0, 300.0), [(float(x), float(y)) for x, y in [(290, 290), (315, 292), (312, 318), (288, 312)]]]
        if area == 3:  # a line along sides and through corners
            rings = [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (200.0, 100.0), (200.0, 0.0), (300.0, 0.0), (300.0, 200.0), (0.0, 200.0)]]
        areas[area] = rings
        corners += [(area, r, i, x, y) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
        own = [(float(x), float(y)) for x, y in rng.integers(50, 550, (12, 2))] + [rings[0][0]]
        nodes += [(area, 100 * area + k, x, y) for k, (x, y) in enumerate(own)]
    found = visibility.mesh(spark.createDataFrame(corners, "area long, ring long, i long, x double, y double"), spark.createDataFrame(nodes, "area long, node long, x double, y double")).collect()
    assert len({(r.area, r.a, r.b) for r in found}) == len(found)
    got = {(r.area, r.a, r.b): r for r in found}
    tried = 0
    for area, rings in areas.items():
        place = {f"n{k}": (x, y) for a, k, x, y in nodes if a == area}
        place |= {f"c-{r}-{i}": p for r, ring in enumerate(rings) for i, p in enumerate(ring) if p not in place.values()}
        name = {p: k for k, p in place.items()}
        side = {tuple(sorted((name[p], name[q]))) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])}
        for a in place:
            for b in place:
                if a >= b or math.dist(place[a], place[b]) < 1:
                    continue
                r = got.get((area, a, b))
                if (a, b) in side:
                    assert r.kind == "ring" and abs(r.metres - math.dist(place[a], place[b])) < 1e-9
                    continue
                far = leaves(rings, place[a], place[b])
                if not 0.3 < far < 1.5:
                    assert (r is not None) == (far <= 0.3), (area, a, b, far)
                    tried += 1
    assert tried > 800 and {r.kind for r in found} == {"ring", "chord"}


def test_larger_areas_get_their_sides(spark):
    ring = [(1, 0, i, 100 * math.cos(i / 81 * math.pi), 100 * math.sin(i / 81 * math.pi)) for i in range(162)]
    found = visibility.mesh(spark.createDataFrame(ring, "area long, ring long, i long, x double, y double"), spark.createDataFrame([], "area long, node long, x double, y double"))
    assert found.count() == 162 and found.where("kind <> 'ring'").isEmpty()
