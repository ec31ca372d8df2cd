"""Every query with an oracle against DuckDB, and kernels against brute force."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from pacegrid.operators import network, raster, select
from pacegrid.plans import all as _all  # noqa: F401
from pacegrid.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def sorted_rows(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert sorted_rows(df.select(*columns).collect()) == sorted_rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


CLOCK = (480, 15, 4000 / 60)


def edge(eid, u, v, len_dm, place, **more):
    base = {"noise_q": 0, "surface_q": 0, "green_q": 0, "flags": 0, "acc": 0, "slope": 0, "shade": [255] * 50} | more
    return {"city": 0, "eid": eid, "u": u, "v": v, "len_dm": len_dm, "x1": place[u][0], "y1": place[u][1], "x2": place[v][0], "y2": place[v][1]} | base


def graph_of(spark, rows, weights, access="walk"):
    edges = spark.createDataFrame(pd.DataFrame(rows)) if isinstance(rows, list) else rows
    return network.Graph.of(network.searched(edges, weights, access).toPandas(), weights, CLOCK)


def test_route_prefers_quiet_and_shade(spark):
    place = {0: (0, 0), 1: (100, 100), 2: (100, -100), 3: (200, 0)}
    rows = [edge(0, 0, 1, 5000, place), edge(1, 0, 2, 3000, place, noise_q=255), edge(2, 1, 3, 5000, place), edge(3, 2, 3, 3000, place, noise_q=255)]
    graph = graph_of(spark, rows, (0.0, 0.0, 2.0, 0.0))
    way, metres, _ = graph.route(0, 3, 60.0)
    assert graph.eid[way].tolist() == [1, 3] and metres == 600
    assert graph.route(0, 0, 0.0) == ([], 0.0, 0.0) and graph.route(3, 0, 0.0) is None
    graph = graph_of(spark, rows, (0.0, 3.0, 2.0, 0.0))
    way, _, _ = graph.route(0, 3, 60.0)
    assert graph.eid[way].tolist() == [0, 2]


def test_route_takes_the_shade_of_the_hour(spark):
    """The longer way is in the shade from 14:00 on: at 8:00 the short one, at 15:00 the long one."""
    place = {0: (0, 0), 1: (100, 100), 2: (100, -100), 3: (200, 0)}
    late = [0] * 24 + [255] * 26
    rows = [edge(0, 0, 1, 5000, place, shade=late), edge(1, 0, 2, 3000, place, shade=[0] * 50), edge(2, 1, 3, 5000, place, shade=late), edge(3, 2, 3, 3000, place, shade=[0] * 50)]
    graph = graph_of(spark, rows, (3.5, 0.0, 0.0, 0.0))
    assert graph.eid[graph.route(0, 3, 480.0)[0]].tolist() == [1, 3] and graph.eid[graph.route(0, 3, 900.0)[0]].tolist() == [0, 2]


def best_by_force(graph, start, goal, minute, longest=7):
    """Least price of all ways without a return over at most ``longest`` edges, turns and time included."""
    best = math.inf

    def go(way, cost, walked):
        nonlocal best
        i = way[-1]
        if graph.v[i] == goal:
            best = min(best, cost)
            return
        lo, hi = graph.first.get(int(graph.v[i]), (0, 0))
        for k in range(lo, hi):
            if len(way) < longest and k not in way and not (hi - lo > 1 and (i, k) in graph.back):
                c = cost + graph.price(k, minute + walked / graph.speed) + graph.turning[i].get(k, 0.0)
                if c < best:
                    go([*way, k], c, walked + graph.length[k])

    for k in range(*graph.first[start]):
        go([k], graph.price(k, minute), graph.length[k])
    return best


def test_routes_with_time_and_turns_are_the_least_of_all(spark):
    """First come, first served: a shade series that only rises makes waiting useless, so the search is exact."""
    rng = np.random.default_rng(3)
    place = {i: (i % 4 * 100, i // 4 * 100) for i in range(16)}
    near = [(a, b) for a in place for b in place if abs(a % 4 - b % 4) + abs(a // 4 - b // 4) == 1]
    rows = [edge(16 * a + b, a, b, int(rng.integers(1000, 1600)), place, noise_q=int(rng.integers(0, 256)), flags=int(rng.choice([0, 1, 3, 35])), shade=[int(rng.integers(0, 100))] * 50) for a, b in near]
    graph = graph_of(spark, rows, (1.5, 1.5, 2.0, 0.0))
    assert any(graph.turning)
    for start, goal in ((0, 5), (0, 10), (3, 9), (12, 6)):
        assert graph.route(start, goal, 600.0)[2] == pytest.approx(best_by_force(graph, start, goal, 600.0))
    pin = graph.eid.tolist().index(16 * 5 + 6)
    way, metres, price, piece = graph.route_to_pin(0, 16 * 5 + 6, 0.25, 600.0)
    both = [best_by_force(graph, 0, end, 600.0) + share * graph.price(pin, 600.0) for end, share in ((5, 0.25), (6, 0.75))]
    assert price == pytest.approx(min(both)) and metres == pytest.approx(sum(graph.length[way]) + piece)


def test_route_is_the_least_price_where_time_does_not_matter(spark):
    rng = np.random.default_rng(2)
    place = {i: (i % 5 * 100, i // 5 * 100) for i in range(25)}
    rows = [edge(len(place) * a + b, a, b, int(rng.integers(1000, 3000)), place, green_q=int(rng.integers(0, 256))) for a in place for b in place if abs(a % 5 - b % 5) + abs(a // 5 - b // 5) == 1]
    graph = graph_of(spark, rows, (0.0, 0.0, 2.0, 0.6))
    cost, _, _, _ = graph.tree(0, 0.0, 1e9)
    for goal in range(1, 25):
        assert graph.route(0, goal, 0.0)[2] == pytest.approx(cost[goal])


def test_price_kernel_is_the_column_expression(spark):
    from pyspark.sql import functions as F

    from pacegrid.functions import cost
    from pacegrid.plans.networks import placed
    from pacegrid.plans.pricing import EDGE, weights
    from pacegrid.sources import bindings

    e = placed(spark, DATA)
    shade = cost.shade_at(lambda k: bindings.shade(F.col("eid"), k), F.lit(907.0))
    for access in ("walk", "stroller", "wheelchair"):
        price = cost.edge_cost({c: F.col(c) for c in EDGE}, shade, weights("balanced"), access)
        want = e.withColumn("price", price).toPandas().set_index("eid").price
        graph = graph_of(spark, e, cost.PRESETS["balanced"], access)
        for i in range(len(graph.eid)):
            got = graph.price(i, 907.0)
            assert (math.isinf(got) and math.isnan(want[graph.eid[i]])) or got == pytest.approx(want[graph.eid[i]])


def test_components_and_relaxation(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "u long, v long")
    got = {r.node: r.component for r in network.components(chain).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}
    edges = spark.createDataFrame([(0, 1, 5), (1, 2, 5), (0, 2, 20)], "u long, v long, w long")
    dist = {r.node: r.dist for r in network.relax(edges, spark.createDataFrame([(0,)], "source long"), 100).collect()}
    assert dist == {0: 0, 1: 5, 2: 10}


def test_shadows_of_a_wall(spark):
    z = np.zeros((100, 100))
    z[40:61, 50] = 10
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(100) for j in range(100)], "row long, col long, z double").cache()

    def mask(azimuth, elevation):
        return raster.shadows(cells, azimuth, elevation).toPandas().pivot(index="row", columns="col", values="shaded").to_numpy()

    west = mask(270, 45)
    assert west[50, 52] and west[50, 59] and not west[50, 62] and not west[50, 48]
    south = mask(180, 26.57)
    assert south[25, 50] and not south[15, 50] and not south[70, 50]
    assert mask(90, -1).all()
    # brute force: a cell is dark if a higher one stands on its ray, step by step towards the sun
    slanted = mask(200.0, 30.0)
    slope, fall = math.tan(math.radians(20)), math.tan(math.radians(30)) * math.hypot(1, math.tan(math.radians(20)))
    for i, j in [(20, 55), (35, 52), (39, 53), (30, 60), (45, 51), (70, 50), (10, 65)]:
        a, c = 99 - i, j  # the sun stands in the south, a little west: along grows to the north, aside to the east
        ray = c - round(slope * a)
        dark = any(0 <= ray + round(slope * k) < 100 and z[99 - k, ray + round(slope * k)] - fall * (a - k) > z[i, j] + 0.01 for k in range(a))
        assert slanted[i, j] == dark


def test_diverse_selection(spark):
    rows = [(1, 1, 1.0, 1300, 0, [1, 2]), (1, 2, 2.0, 1300, 1, [3, 4]), (1, 3, 3.0, 1300, 8, [1, 2]), (1, 4, 4.0, 1300, 8, [5, 6]), (1, 5, 0.1, 9000, 4, [7])]
    df = spark.createDataFrame(rows, "query long, cand long, score double, metres long, sector long, eids array<long>")
    assert [r.cand for r in select.diverse(df, 3, 1300.0).orderBy("rank").collect()] == [1, 4, 2]
    assert sorted(r.cand for r in select.unlike(df).collect()) == [1, 2, 4, 5]


def test_sun_against_known_positions(spark):
    from pyspark.sql import functions as F

    from pacegrid.functions import sun

    # solar noon at the equinox over the meridian: due south, 90 - latitude
    az, el = sun.position(F.lit(20167), F.lit(727.5), F.lit(50.0), F.lit(0.0))
    row = spark.range(1).select(az.alias("az"), el.alias("el")).first()
    assert abs(row.az - 180) < 1 and abs(row.el - 40) < 0.6


def test_artifacts_refuse_what_is_wrong():
    from pacegrid.sources import artifact

    data = artifact.pack(pd.DataFrame({c: [1, 2] for c in artifact.COLUMNS}))
    assert artifact.unpack(data).eid.tolist() == [1, 2]
    for bad in (b"XXXX" + data[4:], data[:4] + b"\x09" + data[5:], data[:-1], data[:-1] + b"\x07"):
        with pytest.raises(ValueError):
            artifact.unpack(bad)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_round_walks_are_closed_and_near_the_target(spark):
    from pacegrid.operators import planner

    place = {i: (i % 15 * 100, i // 15 * 100) for i in range(225)}
    rows = [edge(225 * a + c, a, c, 1000, place) for a in place for c in place if abs(a % 15 - c % 15) + abs(a // 15 - c // 15) == 1]
    graph = graph_of(spark, rows, (1.5, 1.5, 2.0, 0.6))
    found = planner.loops(graph, 112, 1500.0, 600.0)
    assert 1 <= len(found) <= 3
    for way, metres, _, _ in found:
        assert graph.u[way[0]] == 112 == graph.v[way[-1]] and abs(metres - 1500) <= 0.35 * 1500
        assert all(graph.v[a] == graph.u[c] for a, c in zip(way, way[1:]))
    assert all(planner.overlap(set(a[0]), set(c[0])) <= 0.5 for i, a in enumerate(found) for c in found[:i])
    ways = planner.alternatives({"balanced": graph, "fastest": graph_of(spark, rows, (0.0, 0.0, 2.0, 0.0))}, 0, 20, 600.0)
    assert ways[0][0] == "balanced" and len(ways) <= 3


def test_small_kernels():
    from pacegrid.plans import details

    x = np.arange(5.0)
    assert details.simplify(x, np.zeros(5), 0.8).tolist() == [0, 4]
    assert len(details.hull(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]))) == 4
    assert details.limited_profile(np.array([0, 100, 0]), 10).tolist() == [0, 10, 0]


def test_progress_on_a_loop(spark):
    from pacegrid.plans import progress

    def reached(places, x, y):
        rows = spark.createDataFrame([([(float(a), float(c)) for a, c in places], float(x), float(y))], "places array<struct<x double, y double>>, px double, py double")
        return progress.reached(rows).first().step

    loop = [(0, 0), (100, 0), (200, 0), (200, 100), (100, 100), (0, 100), (0, 0)]
    # at the start of a loop one stands on its first and its last node: the first counts, behind the middle the last
    assert reached(loop, 3, 2) == [0, 6, 6, 6, 6, 6, 6]
    # between two nodes the nearer one, and never back while what lies ahead is near
    assert reached(loop, 140, 0)[0] == 1 and reached(loop, 160, 0)[0] == 2 and reached(loop, 150, 40)[3] == 3
    # far from all that lies ahead: the whole walk is asked
    assert reached([(0, 0), (100, 0), (500, 0), (900, 0)], 30, 0) == [0, 1, 0, 0]


def test_ladders_against_the_rule(spark):
    from pacegrid.plans import progress

    rng = np.random.default_rng(5)
    rows = [(int(c), i, float(rng.integers(0, 6)), float(rng.integers(200, 4200)), [int(x) for x in rng.choice(12, int(rng.integers(1, 8)), replace=False)]) for i, c in enumerate(rng.integers(0, 12, 160))]
    df = spark.createDataFrame(rows, "cell long, id long, score double, metres double, eids array<long>")
    got = {}
    for r in select.ladder(df, ["cell"], "id", progress.BANDS, progress.TOP_N, progress.ALIKE).orderBy("rank").collect():
        got.setdefault(r.cell, []).append(r.id)
    for cell in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == cell), key=lambda r: (-r[2], r[1]))
        kept = []
        for low, high in [*progress.BANDS, (None, None)]:
            mark = len(kept)
            for r in own:
                fits = len(kept) < progress.TOP_N if low is None else low <= r[3] < high and len(kept) == mark
                if fits and all(len(set(r[4]) & set(k[4])) / max(len(r[4]), len(k[4])) < progress.ALIKE for k in kept):
                    kept.append(r)
        assert got[cell] == [r[1] for r in kept]


def test_delta_lines_keep_the_sign_of_zeros(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    line = [-0.000001, 0.000001, 0.0, -0.000005, 0.25]
    at = f"{tmp_path}/embeddings.parquet"
    duckdb.sql(f"COPY (SELECT 0::BIGINT AS vec_id, {line + [0.0] * (64 - len(line))}::FLOAT[] AS embedding) TO '{at}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}'")
    want = con.sql(f"SELECT line FROM ({ORACLES['delta_lines']})").fetchall()[0][0]
    got = QUERIES["delta_lines"](spark, str(tmp_path)).first()["line"]
    assert list(map(repr, got)) == list(map(repr, want))
    assert list(map(repr, got[:3])) == ["-0.0", "0.0", "0.0"]


def test_components_carry_no_estimates_from_round_to_round(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long")
    known, rounds = [], network.stars

    def spied(edges, write):
        def told(df, instead):
            known.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
            return write(df, instead)

        return rounds(edges, told)

    monkeypatch.setattr(network, "stars", spied)
    assert {r["component"] for r in network.components(path).collect()} == {0}
    assert max(known) < 1000, known  # bits of a round's estimated size


@pytest.fixture(scope="session")
def repeated(spark, tmp_path_factory):
    """The small tables with some orders twice and thrice, and a part twice."""
    to = tmp_path_factory.mktemp("repeated")
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        if t == "orders":
            df = df.unionByName(df.where("o_orderkey % 5 = 0")).unionByName(df.where("o_orderkey % 15 = 0"))
        df.coalesce(1).write.parquet(f"{to}/{t}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["best_hour", "shade_by_hour", "stretch_side", "circuit_facts", "circuit_quality"])
def test_ways_count_once_and_repeated_walks_as_often_as_they_are_there(spark, repeated, name):
    """equal to SQL where trips repeat."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, repeated)
    columns = sorted(df.columns)
    assert sorted_rows(df.select(*columns).collect()) == sorted_rows(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_edges_of_a_way_are_worked_out_once(spark):
    """rows of ways follow the places that walks start from, not the walks."""
    from pacegrid.sources import bindings as b

    walked = b.trodden(spark, DATA)
    assert b.ways(walked).count() == b.LEG * walked.select("origin", "copies").distinct().count() < b.steps(spark, DATA).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["diverse_three", "unlike_loops"])
def test_picks_of_many_small_queries_stay_in_the_jvm(spark, name):
    """no Python call for each query."""
    assert "Pandas" not in plan_of(QUERIES[name](spark, DATA))


def test_offers_without_a_score_come_last(spark):
    rows = [(1, 1, None, 1300, 0, [1]), (1, 2, 5.0, 1300, 8, [2]), (1, 3, float("nan"), 1300, 4, [3]), (1, 4, 6.0, 3000, 12, [4])]
    df = spark.createDataFrame(rows, "query long, cand long, score double, metres long, sector long, eids array<long>")
    assert [(r.rank, r.cand, r.score) for r in select.diverse(df, 3, 1300.0).orderBy("rank").collect()] == [(0, 2, 5.0), (1, 1, None), (2, 3, None)]
    assert [r.cand for r in select.unlike(df).collect()] == [2, 4, 1, 3]


def test_bands_are_written_as_rows_of_bytes(spark, tmp_path, monkeypatch):
    """a row for each edge and band, and every bucket in it."""
    from pacegrid.plans import stores
    from pacegrid.sources import bindings as b

    monkeypatch.setattr(stores, "shared", lambda *_: str(tmp_path / "bands"))
    stores.band_read(spark, DATA).collect()
    written, edges = spark.read.parquet(str(tmp_path / "bands")), b.edges(spark, DATA).count()
    assert written.count() == 7 * edges
    assert written.selectExpr("sum(size(shade))").first()[0] == b.BUCKETS * edges


def test_relaxation_broadcasts_nothing(spark, monkeypatch):
    """what a round joins is merged, however small it is taken for."""
    plans: list = []
    keep = network.stored
    monkeypatch.setattr(network, "stored", lambda df, *a, **k: plans.append(plan_of(df)) or keep(df, *a, **k))
    QUERIES["relaxed"](spark, DATA)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 1 and not any("known" in p and "BroadcastHashJoin [source" in p for p in joins)


def test_only_walks_of_sessions_get_places(spark):
    """places are worked out for the walks that sessions are on."""
    from pacegrid.plans import progress
    from pacegrid.sources import bindings as b

    sessions = b.table(spark, DATA, "events").select("user_id").distinct().count()
    assert 0 < progress._places(spark, DATA).count() <= sessions < b.walks(spark, DATA).count()
