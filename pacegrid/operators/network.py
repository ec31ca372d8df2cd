"""Graph operators: relaxation and components as joins, time-dependent search as a kernel per city.

``relax`` and ``components`` run on any size, round by round.  The search kernel
holds one city's edges in a task, where a heap needs them; a city's queries are
dealt to groups of about ``TRIPS``, so that a city with most queries is many tasks.
What an edge costs and what a turn costs is worked out by Spark, in the one place
that states it (``functions.cost``, ``turns``); the kernel adds numbers up.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.functions import cost as fixed
from pacegrid.operators.store import drop, stored

C = F.col
#: Queries of a city that share a task, about: of searches far around, of single ways, which cost less than a city's graph does, and of ways home, many to one goal.
TRIPS, WAYS, HOME = 64, 512, 4096
#: Least prices to goals that a graph keeps, about: numbers.
AHEAD = 2_000_000
#: Edges of one node are dealt to so many tasks.
NODE_SALTS = 16
#: Degrees within which a street goes on straight, and by which another way is bent more.
STRAIGHT_DEG, BENT_DEG = 20, 5
TURN_M, MAJOR_NODE_M = 60, 150


def relax(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, dist): least sums of (u, v, w); nodes beyond ``most`` are reached but lead no further.

    Rounds go on until none changes a sum.  They are written tables, and joins are merges: no side of
    them comes to the driver to be broadcast, whatever its size is taken for.
    """
    edges = stored(edges.select("u", "v", "w"), "relaxed-edges")  # each round reads them; what they are made of is broadcast once at most
    best = stored(sources.select("source", C("source").alias("node"), F.lit(0).cast("long").alias("dist")), "relaxed")
    front = best
    while True:
        step = front.where(C("dist") <= most).join(edges.hint("merge"), C("node") == C("u")).select("source", C("v").alias("node"), (C("dist") + C("w")).alias("dist"))
        step = step.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        known = best.select("source", "node", C("dist").alias("_known"))
        before = front
        front = stored(step.join(known.hint("merge"), ["source", "node"], "left").where(C("_known").isNull() | (C("dist") < C("_known"))).select("source", "node", "dist"), "relaxed-front")
        if before is not best:
            drop(before)
        if front.isEmpty():
            drop(front, edges)
            return best
        best = stored(best.unionByName(front).groupBy("source", "node").agg(F.min("dist").alias("dist")), "relaxed", instead=best)


def _with_least(edges: DataFrame, itself: bool) -> DataFrame:
    """``edges`` (u, v) with m, the least node that u meets (itself, too, if asked).

    A node of many edges is dealt to ``NODE_SALTS`` tasks: the least is found for each
    (u, salt), then for u, and comes back to the (u, salt) that exist.
    """
    many = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(NODE_SALTS)))
    part = many.groupBy("u", "_salt").agg(F.min("v").alias("_m"))
    least = part.groupBy("u").agg(F.min("_m").alias("m"), F.collect_list("_salt").alias("_salts"))
    back = least.select("u", F.explode("_salts").alias("_salt"), (F.least("m", "u") if itself else C("m")).alias("m"))
    return many.join(back, ["u", "_salt"]).select("u", "v", "m")


def stars(edges: DataFrame, write: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots: the least node of its component.

    Alternating large and small stars.  ``write(df, instead)`` cuts the lineage of a round
    and may let go of ``instead``, the round before.
    """
    ordered = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = write(ordered(edges), None), None
    while True:
        ways = edges.unionByName(edges.select(C("v").alias("u"), C("u").alias("v")))
        large = ordered(_with_least(ways, True).where("v > u").select(C("v").alias("u"), C("m").alias("v")))
        small = _with_least(large, False).select(F.explode(F.array(F.struct(C("v").alias("u"), C("m").alias("v")), F.struct("u", C("m").alias("v")))).alias("e"))
        edges = write(ordered(small.select("e.u", "e.v")), edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(C("u").alias("node"), C("v").alias("root"))
        before = now


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (u, v) is joined with, either way.

    Rounds are written tables, whose size is known: a checkpoint keeps the size that was estimated before it,
    a product over joins, whose digits multiply with every round until the driver is busy with them alone.
    """
    found = stars(edges, lambda df, instead: stored(df, "components", instead=instead))
    nodes = edges.select("u").unionByName(edges.select(C("v").alias("u"))).distinct()
    return nodes.join(found, C("u") == C("node"), "left").select(C("u").alias("node"), F.coalesce("root", "u").alias("component"))


def turns(edges: DataFrame) -> DataFrame:
    """(e1, e2, metres) of consecutive edges whose turn costs something.

    Leaving the straight street over a junction mouth costs ``TURN_M``, crossing a
    major road for nothing ``MAJOR_NODE_M``; at crossing nodes turns are free.
    ``edges`` has eid, u, v, len_dm, flags and the ends' places x1, y1, x2, y2.
    """
    size = F.greatest(F.hypot(C("x2") - C("x1"), C("y2") - C("y1")), F.lit(1e-9))
    e = edges.select("eid", "u", "v", "len_dm", "flags", ((C("x2") - C("x1")) / size).alias("ux"), ((C("y2") - C("y1")) / size).alias("uy"))
    one = e.select(*[C(c).alias(f"a_{c}") for c in ("eid", "u", "len_dm", "flags", "ux", "uy")], C("v").alias("n"))
    two = e.select(*[C(c).alias(f"b_{c}") for c in ("eid", "v", "len_dm", "flags", "ux", "uy")], C("u").alias("n"))
    along = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), C("a_ux") * C("b_ux") + C("a_uy") * C("b_uy")))
    pairs = one.join(two, "n").withColumn("along", along)
    back = (C("b_v") == C("a_u")) & (C("b_len_dm") == C("a_len_dm"))
    # the straightest streets out of the node, but for the way back: two of them, as one may be the turn itself
    straight = pairs.where(fixed.bit(C("b_flags"), 1) & ~back).groupBy("a_eid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-C("along")).alias("k"), C("b_eid").alias("e")))), 1, 2).alias("best"))
    ends = e.select(C("u").alias("n"), "flags").unionByName(e.select(C("v").alias("n"), "flags"))
    marks = ends.groupBy("n").agg(F.bool_or(fixed.bit(C("flags"), 4)).alias("crossing"), F.bool_or(C("flags").bitwiseAND(F.lit(33)) == 33).alias("major"))
    best = F.array_max(F.transform(F.filter("best", lambda o: o["e"] != C("b_eid")), lambda o: -o["k"]))
    bent = (C("b_flags").bitwiseAND(F.lit(3)) == 3) & (best > math.cos(math.radians(STRAIGHT_DEG))) & (F.acos("along") > F.acos(best) + math.radians(BENT_DEG))
    through = C("major") & ~fixed.bit(C("a_flags"), 32) & ~fixed.bit(C("b_flags"), 32)
    metres = F.when(F.coalesce(bent, F.lit(False)), TURN_M).otherwise(0) + F.when(through, MAJOR_NODE_M).otherwise(0)
    found = pairs.join(straight, "a_eid", "left").join(marks, "n").where("NOT crossing")
    return found.select(C("a_eid").alias("e1"), C("b_eid").alias("e2"), metres.alias("metres")).where("metres > 0")


def searched(edges: DataFrame, weights: tuple[float, float, float, float] | dict[str, tuple[float, float, float, float]], access: str) -> DataFrame:
    """``edges`` as the kernel needs them: (city, eid, u, v, places, metres, lit, sun, more, shade, turn_to, turn_m).

    A price is linear in what changes on the way: ``lit`` is the price in full shade,
    ``sun`` is added for each part of an edge in the sun, and ``more`` for each extra unit of rate.
    All are null where the access mode excludes an edge.  ``shade`` is the edge's series of bytes.  Weights by name
    give these three for each, as ``name_lit`` and so on: what presets share is there once.
    """
    e = {c: C(c) for c in ("len_dm", "noise_q", "surface_q", "green_q", "flags", "acc", "slope")}
    terms = []
    for name, each in (weights if isinstance(weights, dict) else {"": weights}).items():
        w = dict(zip(("shade", "noise", "surface", "green"), map(F.lit, each)))
        at = lambda shade, extra=None: fixed.edge_cost(e, F.lit(shade), w, access, extra)  # noqa: B023, E731
        before = f"{name}_" if name else ""
        terms += [at(1.0).alias(f"{before}lit"), (at(0.0) - at(1.0)).alias(f"{before}sun"), (at(1.0, F.lit(1.0)) - at(1.0)).alias(f"{before}more")]
    bends = turns(edges).groupBy(C("e1").alias("eid")).agg(F.collect_list(F.struct("e2", "metres")).alias("turns"))
    bends = bends.select("eid", F.transform("turns", lambda t: t["e2"]).alias("turn_to"), F.transform("turns", lambda t: t["metres"]).alias("turn_m"))
    return edges.select("city", "eid", "u", "v", "x1", "y1", "x2", "y2", (C("len_dm") / 10).alias("metres"), "shade", *terms).join(bends, "eid", "left")


def prices(e: pd.DataFrame, name: str = "") -> tuple[list[float], list[float], list[float]]:
    """Lists of ``lit``, ``sun`` and ``more`` of a preset's columns; infinite where an edge is excluded."""
    return tuple(e[name + c].astype(float).fillna(none).tolist() for c, none in (("lit", math.inf), ("sun", 0.0), ("more", 0.0)))


@dataclass
class Graph:
    """One city's edges, sorted by source; arrays and lists by edge position."""

    eid: np.ndarray
    u: np.ndarray
    v: np.ndarray
    first: dict[int, tuple[int, int]]
    length: np.ndarray
    lit: list[float]
    sun: list[float]
    more: list[float]
    series: np.ndarray
    turning: list[dict[int, float]]
    back: set[tuple[int, int]]
    place: dict[int, tuple[float, float]]
    at: dict[int, int]
    green: np.ndarray
    ends: list[int]
    metres: list[float]
    after: list[list[tuple[int, float]]]
    pairs: list[int]
    twins: list[list[int]]
    least_rate: float
    start_min: float
    step_min: float
    speed: float
    coming: dict[int, list[tuple[int, int]]]

    def __post_init__(self) -> None:
        self._buckets: dict[int, tuple[list[float], list[float]]] = {}
        self._ahead: dict[int, tuple[dict[int, float], dict[int, float], list[tuple[float, int]]]] = {}
        self._cost = [math.inf] * len(self.ends)
        self._walked, self._came = [0.0] * len(self.ends), [-1] * len(self.ends)

    @classmethod
    def of(cls, pdf: pd.DataFrame, weights: tuple[float, float, float, float], clock: tuple[float, float, float]) -> Graph:
        """``clock``: first minute and step of the shade series, and metres a minute."""
        e = pdf.sort_values(["u", "v", "eid"]).reset_index(drop=True)
        nodes, start = np.unique(e.u, return_index=True)
        first = {n: (a, b) for n, a, b in zip(nodes.tolist(), start.tolist(), [*start[1:].tolist(), len(e)])}
        u, v, metres = e.u.tolist(), e.v.tolist(), e.metres.astype(float).tolist()
        at = {x: i for i, x in enumerate(e.eid.tolist())}
        turning: list[dict[int, float]] = [{} for _ in u]
        for i in np.flatnonzero(e.turn_to.notna()).tolist():
            turning[i] = {at[k]: float(m) for k, m in zip(np.asarray(e.turn_to[i]).tolist(), np.asarray(e.turn_m[i]).tolist()) if k in at}
        same = {key: len(u) - 1 - i for i, key in enumerate(zip(reversed(u), reversed(v), reversed(metres)))}
        back = {(i, same[key]) for i, key in enumerate(zip(v, u, metres)) if key in same}
        # edges that may follow each one, with the metres of the turn: not the way back, but where it is the only one
        after = []
        for i, n in enumerate(v):
            lo, hi = first.get(n, (0, 0))
            after.append([(k, turning[i].get(k, 0.0)) for k in range(lo, hi) if hi - lo == 1 or (i, k) not in back])
        number: dict[tuple[int, int], int] = {}
        pairs = [number.setdefault((a, b) if a < b else (b, a), len(number)) for a, b in zip(u, v)]
        twins: list[list[int]] = [[] for _ in number]
        for k, p in enumerate(pairs):
            twins[p].append(k)
        coming: dict[int, list[tuple[int, int]]] = {}
        for k, (n, m) in enumerate(zip(u, v)):
            coming.setdefault(m, []).append((k, n))
        place = {n: (x, y) for a in ("1", "2") for n, x, y in zip((u, v)[a == "2"], e["x" + a].astype(float).tolist(), e["y" + a].astype(float).tolist())}
        series = np.stack([np.asarray(s, float) for s in e.shade]) / 255
        return cls(
            e.eid.to_numpy(), e.u.to_numpy(), e.v.to_numpy(), first, e.metres.to_numpy(float), *prices(e), series, turning, back, place, at,
            e.green.to_numpy(bool) if "green" in e else np.zeros(len(e), bool), v, metres, after, pairs, twins, max(0.05, 1 - weights[3]), *clock, coming,
        )

    @classmethod
    def each(cls, pdf: pd.DataFrame, names: list[str], clock: tuple[float, float, float]) -> dict[str, Graph]:
        """The graph of each preset, of edges ``searched`` for all of them: prices differ, the rest is one."""
        if len(names) == 1:
            return {names[0]: cls.of(pdf, fixed.preset(names[0].split(":")[0]), clock)}
        e = pdf.sort_values(["u", "v", "eid"]).reset_index(drop=True)
        found: dict[str, Graph] = {}
        for name in names:
            weights = fixed.preset(name.split(":")[0])
            if not found:
                found[name] = one = cls.of(e.rename(columns={f"{name}_{c}": c for c in ("lit", "sun", "more")}), weights, clock)
            else:
                found[name] = replace(one, **dict(zip(("lit", "sun", "more"), prices(e, f"{name}_"))), least_rate=max(0.05, 1 - weights[3]))
                found[name]._buckets = one._buckets
        return found

    def bucket(self, low: int) -> tuple[list[float], list[float]]:
        """Shade of every edge at the start of a bucket, and what it changes by to the next one."""
        found = self._buckets.get(low)
        if found is None:
            here = self.series[:, low]
            found = self._buckets[low] = here.tolist(), (self.series[:, min(low + 1, self.series.shape[1] - 1)] - here).tolist()
        return found

    def price(self, k: int, minute: float, extra: float = 0.0) -> float:
        """The price of an edge entered at a minute; outside the series all is shade, infinite where excluded."""
        step = (minute - self.start_min) / self.step_min
        if step < 0 or step > self.series.shape[1] - 1:
            return self.lit[k] + self.more[k] * extra
        low = int(step)
        here, change = self.bucket(low)
        return self.lit[k] + self.sun[k] * (1 - (here[k] + change[k] * (step - low))) + self.more[k] * extra

    def ahead(self, goal: int) -> tuple[dict[int, float], dict[int, float], list[tuple[float, int]]]:
        """The search back from a goal in full shade and without turns, as far as it has come: prices of settled nodes, of met ones, and its heap.

        No way is cheaper than that, and searches for one goal share it.
        """
        found = self._ahead.get(goal)
        if found is None:
            if len(self._ahead) * len(self.place) > AHEAD:
                self._ahead.clear()
            found = self._ahead[goal] = {}, {goal: 0.0}, [(0.0, goal)]
        return found

    def _settled(self, back: tuple[dict[int, float], dict[int, float], list[tuple[float, int]]], node: int) -> float:
        """The least price from a node to the goal of ``back``, which goes on until it is there; infinite where there is no way."""
        least, met, heap = back
        lit, coming = self.lit, self.coming
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            base, n = pop(heap)
            if n in least:
                continue
            least[n] = base
            for k, m in coming.get(n, ()):
                c = base + lit[k]
                if c < met.get(m, math.inf):
                    met[m] = c
                    push(heap, (c, m))
            if n == node:
                return base
        return least.setdefault(node, math.inf)

    def route(self, start: int, goal: int, minute: float, extra: dict[int, float] | Callable[[int], float] | None = None) -> tuple[list[int], float, float] | None:
        """(edge positions, metres, price) of the best way over edges as states; ties go to the lower edge.

        ``extra`` is a rate on top, by edge: of some edges, or a function of each.  What is ahead of an edge is the least price
        of any way from its end, not a straight line: edges that are shorter than that would not lead to the best way.
        """
        if start == goal:
            return [], 0.0, 0.0
        if start not in self.first or goal not in self.place:
            return None
        back, none = self.ahead(goal), math.inf
        least = back[0]
        lit, sun, more, metres, ends, after = self.lit, self.sun, self.more, self.metres, self.ends, self.after
        start_min, step_min, speed, last = self.start_min, self.step_min, self.speed, self.series.shape[1] - 1
        rate = extra.get if isinstance(extra, dict) else extra
        # lists of the graph, whose prices are infinite again behind each search
        cost, walked, came = self._cost, self._walked, self._came
        done: set[int] = set()
        met: list[int] = []
        heap: list[tuple[float, int]] = []
        push, pop = heapq.heappush, heapq.heappop
        i, base, far, following = -1, 0.0, 0.0, [(k, 0.0) for k in range(*self.first[start])]
        while True:
            step = (minute + far / speed - start_min) / step_min
            light = not (step < 0 or step > last)
            if light:
                low = int(step)
                part = step - low
                here, change = self.bucket(low)
            for k, turn in following:
                c = lit[k] + sun[k] * (1 - (here[k] + change[k] * part)) if light else lit[k]
                if rate is not None:
                    x = rate(k)
                    if x:
                        c += more[k] * x
                c = base + c + turn
                if c < cost[k]:
                    h = least.get(ends[k])
                    if h is None:
                        h = self._settled(back, ends[k])
                    if h == none:
                        continue
                    cost[k] = c
                    walked[k] = far + metres[k]
                    came[k] = i
                    met.append(k)
                    push(heap, (c + h, k))
            i = -1
            while heap and i < 0:
                i = pop(heap)[1]
                if i in done:
                    i = -1
            if i < 0:
                found = None
                break
            done.add(i)
            base, far = cost[i], walked[i]
            if ends[i] == goal:
                way, k = [], i
                while k >= 0:
                    way.append(k)
                    k = came[k]
                found = way[::-1], far, base
                break
            following = after[i]
        for k in met:
            cost[k] = math.inf
        return found

    def route_to_pin(self, start: int, eid: int, part: float, minute: float) -> tuple[list[int], float, float, float] | None:
        """The best way to a place on an edge, ``part`` of it from its source: by either end, with the piece from there.

        (edge positions to that end, metres in all, price in all, metres of the piece).
        """
        k = self.at.get(eid)
        if k is None:
            return None
        found = []
        for end, share in ((int(self.u[k]), part), (int(self.v[k]), 1 - part)):
            way = self.route(start, end, minute)
            if way is not None:
                edge = self.price(k, minute + way[1] / self.speed)
                piece = edge * share if edge < math.inf else 0.0
                metres = share * float(self.length[k])
                found.append((way[2] + piece, end, way[0], way[1] + metres, metres))
        best = min(found, key=lambda f: f[0], default=None)
        return None if best is None else (best[2], best[3], best[0], best[4])

    def tree(self, start: int, minute: float, most: float) -> tuple[dict, dict, dict, list[int]]:
        """Node-state search: price, metres, edge into each node, and nodes as they settle; past ``most`` metres nodes settle but lead no further."""
        cost, walked, into, settled, done = {start: 0.0}, {start: 0.0}, {}, [], set()
        lit, sun, metres, ends, first = self.lit, self.sun, self.metres, self.ends, self.first
        start_min, step_min, speed, last = self.start_min, self.step_min, self.speed, self.series.shape[1] - 1
        heap = [(0.0, start)]
        while heap:
            _, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            settled.append(n)
            base, far = cost[n], walked[n]
            if far > most:
                continue
            step = (minute + far / speed - start_min) / step_min
            light = not (step < 0 or step > last)
            if light:
                low = int(step)
                part = step - low
                here, change = self.bucket(low)
            for k in range(*first.get(n, (0, 0))):
                m = ends[k]
                c = base + (lit[k] + sun[k] * (1 - (here[k] + change[k] * part)) if light else lit[k])
                if m not in done and c < cost.get(m, math.inf):
                    cost[m], walked[m], into[m] = c, far + metres[k], k
                    heapq.heappush(heap, (c, m))
        return cost, walked, into, settled


def dealt(asked: DataFrame, edges: dict[str, DataFrame], clock: tuple[float, float, float], plan, schema: str, together: int = TRIPS) -> DataFrame:
    """``plan(graphs, row)`` for every row of ``asked`` (with city and trip), beside its city's graphs.

    ``edges`` holds ``searched`` edges by preset, by presets that share them with bars between, or by preset, a colon and a name of one's own.
    A city's rows are dealt to groups of about ``together``, each with the city's edges.
    """
    groups = asked.groupBy("city").agg(F.ceil(F.count(F.lit(1)) / together).alias("_groups"))
    rows = asked.join(groups, "city").withColumn("_salt", F.pmod(F.xxhash64("trip"), C("_groups")))
    named = None
    for name, e in edges.items():
        e = e.withColumn("_preset", F.lit(name))
        named = e if named is None else named.unionByName(e)
    held = named.join(rows.select("city", C("_salt").alias("_part")).distinct(), "city")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        graphs = {name: graph for names, part in right.groupby("_preset") for name, graph in Graph.each(part, names.split("|"), clock).items()}
        return pd.DataFrame([row for q in left.itertuples() for row in plan(graphs, q)], columns=names)

    return rows.groupBy("city", "_salt").cogroup(held.groupBy("city", "_part")).applyInPandas(run, schema)


def routes(edges: DataFrame, asked: DataFrame, clock: tuple[float, float, float], preset: str = "balanced", access: str = "stroller", together: int = WAYS) -> DataFrame:
    """(trip, eids, metres, cost) for rows (city, trip, start, goal, depart); null where there is no way.

    ``edges`` has city, eid, u, v, attributes, ``shade`` and the ends' places x1, y1, x2, y2.
    """

    def search(graphs, q):
        graph = graphs.get(preset)
        way, metres, price = (graph.route(int(q.start), int(q.goal), float(q.depart)) if graph else None) or (None, None, None)
        yield q.trip, None if way is None else [int(graph.eid[k]) for k in way], metres, price

    return dealt(asked, {preset: searched(edges, fixed.preset(preset), access)}, clock, search, "trip long, eids array<long>, metres double, cost double", together)


def routes_to_pins(edges: DataFrame, asked: DataFrame, clock: tuple[float, float, float], preset: str = "balanced", access: str = "stroller") -> DataFrame:
    """(trip, eids, metres, cost, piece_m) for rows (city, trip, start, pin, part, depart): ``part`` of the edge ``pin`` from its source."""

    def search(graphs, q):
        graph = graphs.get(preset)
        way, metres, price, piece = (graph.route_to_pin(int(q.start), int(q.pin), float(q.part), float(q.depart)) if graph else None) or (None,) * 4
        yield q.trip, None if way is None else [int(graph.eid[k]) for k in way], metres, price, piece

    return dealt(asked, {preset: searched(edges, fixed.preset(preset), access)}, clock, search, "trip long, eids array<long>, metres double, cost double, piece_m double", WAYS)


def trees(edges: dict[str, DataFrame], asked: DataFrame, clock: tuple[float, float, float]) -> DataFrame:
    """(trip, tree, rank, node, cost, metres, way) for rows (city, trip, start, depart, most): the nodes that settle within ``most`` metres, in order, and the way to each.

    ``edges`` holds ``searched`` edges by name, each a tree of its own.
    """

    def plan(graphs, q):
        for name, graph in graphs.items():
            if int(q.start) not in graph.place:
                continue
            cost, walked, into, settled = graph.tree(int(q.start), float(q.depart), float(q.most))
            ways: dict[int, list[int]] = {int(q.start): []}
            for rank, n in enumerate(settled):
                if n in into:
                    ways[n] = [*ways[int(graph.u[into[n]])], int(graph.eid[into[n]])]
                yield q.trip, name, rank, n, float(cost[n]), float(walked[n]), ways[n]

    return dealt(asked, edges, clock, plan, "trip long, tree string, rank long, node long, cost double, metres double, way array<long>")
