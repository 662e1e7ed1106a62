"""Operators that SQL cannot check, and edge cases of the others, on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from xtalspark.functions import burgers as B
from xtalspark.functions import cell as C
from xtalspark.functions import linalg as la
from xtalspark.operators import boxes, delaunay, elastic, ghosts, lines, mesh, network, paths, reach, regions, tess
from xtalspark.plans import queries, views
from xtalspark.plans.options import DxaOptions
from xtalspark.sources import lammps, lattices

DATA = "/root/testdata/sf0.001"
BOX = C.Cell(((10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (0.0, 0.0, 10.0)))
LINE = "frame_id bigint, segment_id int, line array<struct<x:double,y:double,z:double>>, core_size array<int>, is_loop boolean, is_infinite boolean"


def polyline(points):
    return [{"x": float(a), "y": float(b), "z": float(c)} for a, b, c in points]


def length(points):
    p = np.array([[q["x"], q["y"], q["z"]] for q in points])
    return float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())


@pytest.mark.parametrize("name", ["wrap_points", "family_summary", "burgers_family", "line_length", "network_statistics", "junction_arms", "half_edge_link", "replaced_chain", "clip_pbc_lines", "lattice_catalogue", "crystal_path_vectors", "compatible_cells", "transition_compose", "circuit_burgers", "edge_direction_lookup", "defect_slots"])
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


@pytest.fixture(scope="module")
def few_orders(spark, tmp_path_factory):
    """Folder of the first 60 orders and their items."""
    d = str(tmp_path_factory.mktemp("few"))
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{DATA}/{name}.parquet").filter(F.col(key) < 60).write.parquet(f"{d}/{name}.parquet")
    return d


def test_bbox_overlap_takes_cells_of_any_size(spark, few_orders):
    at = {r["atom_idx"]: (r["x"], r["y"], r["z"]) for r in views.atoms(spark, few_orders).collect()}
    want = set()
    for r in views.tets(spark, few_orders).collect():
        corners = np.array([at[r[f"v{i}"]] for i in range(4)])
        lo, hi = corners.min(0), corners.max(0)
        want |= {(r["cell"], k) for k, p in at.items() if (lo <= np.array(p) + 1).all() and (np.array(p) - 1 <= hi).all()}
    boxes = tess.bounding_boxes(queries._tet_points(spark, few_orders))
    around = views.atoms(spark, few_orders)
    for x in "xyz":
        around = around.withColumn(f"lo_{x}", F.col(x) - 1).withColumn(f"hi_{x}", F.col(x) + 1)
    for size in (6.0, 25.0):
        got = [tuple(r) for r in tess.box_overlaps(boxes, around, size, "cell", "atom_idx").select("cell", "atom_idx").collect()]
        assert want and len(got) == len(set(got)) and set(got) == want
    told = {r["cell"]: (r["n_atoms"], r["atom_sum"], r["last_atom"]) for r in queries.bbox_overlap(spark, few_orders).collect()}
    by = {c: [k for d, k in want if d == c] for c in {c for c, _ in want}}
    assert told == {c: (len(k), sum(k), max(k)) for c, k in by.items()}


def test_box_totals_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for n, m, grid in ((300, 400, 9), (5000, 200, 60), (4000, 200, 2000), (1, 5, 3)):
        at, ids = rng.integers(0, grid, (n, 3)).astype(float), rng.permutation(3 * n)[:n]
        ends = rng.integers(-3, grid + 3, (m, 2, 3)).astype(float)
        ends[: m // 2, 1] = ends[: m // 2, 0] + rng.integers(0, 3, (m // 2, 3))
        lo, hi = ends.min(1), ends.max(1)
        hits = [((lo[i] <= at + 1) & (at - 1 <= hi[i])).all(1) for i in range(m)]
        for tried in (0, 64, 4096):
            monkeypatch.setattr(boxes, "TRIED", tried)
            count, total, last = boxes.Points(ids, at, 1.0).totals(lo, hi)
            assert count.tolist() == [h.sum() for h in hits] and total.tolist() == [ids[h].sum() for h in hits]
            assert [x for x, h in zip(last.tolist(), hits) if h.any()] == [ids[h].max() for h in hits if h.any()]
    plan = queries.bbox_overlap(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "lo_x" not in plan
    vertices = spark.createDataFrame([(f, v, float(v), float(f), 0.0) for f in (1, 2) for v in range(6 * f)], "frame_id bigint, vh bigint, x double, y double, z double")
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (2, 0, 7, 8, 9, 10), (2, 1, 0, 1, 2, 99), (3, 0, 0, 1, 2, 3)], "frame_id bigint, cell bigint, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
    assert sorted(tuple(r) for r in boxes.cell_box_totals(cells, vertices, 1.0).collect()) == [(1, 0, 5, 10, 4), (2, 0, 6, 51, 11)]


def test_box_totals_sweep_over_few_coordinates(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n, grid, m, gaps in ((500, 9, 300, 1), (5000, (40, 7, 9), 500, 3), (3000, (2000, 50, 3), 300, 1), (2000, (30, 1, 40), 3000, 2), (1, 3, 5, 1)):
        at, ids = rng.integers(0, grid, (n, 3)).astype(float), rng.permutation(gaps * n)[:n] + 5
        rows = [(f, int(i), *map(float, p)) for i, p in zip(ids, at) for f in (0, 1) if f == 0 or i % 2]
        spark.createDataFrame(rows, "frame_id bigint, v bigint, x double, y double, z double").write.parquet(uri := f"file://{tmp_path}/{n}")
        points = boxes.Grid.read(uri, 0, 1.0)
        pick = rng.integers(0, n, (m, 4))
        pick[m // 2 :, 1:] = pick[m // 2 :, :1]
        corners = ids[pick]
        corners[0, 0] = 10**7
        known, ends = points.boxes(corners)
        assert known.tolist() == [False] + [True] * (m - 1)
        for i, told in zip(range(1, m), zip(*points.totals(ends), strict=True), strict=True):
            lo, hi = at[pick[i]].min(0), at[pick[i]].max(0)
            hit = ids[((lo <= at + 1) & (at - 1 <= hi)).all(1)]
            assert told == (len(hit), hit.sum(), hit.max())
    # What is held for each point, besides what hangs on the number of ranks, is 8 bytes where ids have no gaps.
    held = boxes.Grid.read(f"file://{tmp_path}/500", 0, 1.0)
    assert held.ids is None and held.order.nbytes + held.x.nbytes + held.p.nbytes == 8 * 500
    assert boxes.Grid.work(1 << 16, 1 << 16, 1 << 16) > boxes.WORK and boxes.Grid.read(uri, 7, 1.0) is None


def test_tets_are_dealt_once(spark, few_orders):
    plan = views.tets(spark, few_orders)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("__range" in x for x in dealt) and not any("v0" in x for x in dealt)


def test_reachability_starts_from_every_vertex(spark, few_orders):
    near = {}
    for r in views.edges(spark, few_orders).collect():
        near.setdefault(r["v1"], set()).add(r["v2"])
        near.setdefault(r["v2"], set()).add(r["v1"])
    want = {}
    for v in near:
        for n, reached in enumerate([{v}, near[v], {y for x in near[v] for y in near[x]}]):
            for x in reached:
                want.setdefault((v, x), n)
    e = views.edges(spark, few_orders)
    every = elastic.both_ways(e).select("frame_id", "v").distinct()
    got = [tuple(r) for r in elastic.reachable(e, every, 2).select("src", "at", "hops").collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    for r in queries.reachability_depth2(spark, few_orders).collect():
        at = [[b for (a, b), n in want.items() if a == r["src"] and n == k] for k in (1, 2)]
        assert (r["n1"], r["n2"], r["sum1"], r["sum2"] or 0) == (*map(len, at), *map(sum, at))


def test_reach_totals_store_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(reach, "BLOCK", 60)
    rng = np.random.default_rng(5)
    rows = [(f, min(a, b) + off, max(a, b) + off) for f, off in ((1, 0), (2, 1 << 40)) for a, b in rng.integers(0, 60, (70, 2)).tolist() if a != b]
    got = reach.reach_totals(spark.createDataFrame([*rows, *rows[:20]], "frame_id bigint, v1 bigint, v2 bigint"), 3)
    want = {}
    for f in (1, 2):
        near = {}
        for _, a, b in (r for r in rows if r[0] == f):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for v in near:
            seen, level = {v}, [{v}]
            for _ in range(3):
                level.append({y for x in level[-1] for y in near[x]} - seen)
                seen |= level[-1]
            want[f, v] = [len(x) for x in level], [sum(x) if x else None for x in level]
    assert {(r["frame_id"], r["src"]): (r["n"], r["total"]) for r in got.collect()} == want
    plan = queries.reachability_depth2(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_every_family_is_named_and_near_misses_are_not(spark):
    rows, want = [], []
    for structure, table in B.FAMILIES.items():
        for values, name, _ in table:
            v = (values[0], 0.0, values[1]) if len(values) == 2 else values
            rows += [(structure, *map(float, v), name), (structure, *(float(x) * -1 for x in v), name), (structure, v[0] + 0.02, v[1] + 0.02, float(v[2]) + 0.02, "Other")]
    rows += [("unknown", 0.5, 0.5, 0.0, "Other"), (None, 0.5, 0.5, 0.0, "Other"), (" FCC ", 0.5, 0.0, 0.5, "1/2<110>")]
    df = spark.createDataFrame(rows, "s string, x double, y double, z double, want string")
    got = df.select("want", B.family((F.col("x"), F.col("y"), F.col("z")), F.col("s"))["name"].alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_alpha_test_is_the_squared_circumradius(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(40):
        p = rng.random((4, 3)) * 5
        m, rhs = 2 * (p[1:] - p[0]), ((p[1:] - p[0]) ** 2).sum(axis=1)
        r2 = float(np.sum(np.linalg.solve(m, rhs) ** 2))
        rows.append(([polyline([q])[0] for q in p], r2))
    rows.append(([polyline([q])[0] for q in ((0, 0, 0), (1e-3, 0, 0), (0, 1e-3, 0), (1e-3, 1e-3, 0))], None))
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double,z:double>>, r2 double")
    corners = [la.xyz(F.col("p")[i]) for i in range(4)]
    got = df.select("r2", tess.alpha_test(corners, F.col("r2") * 1.001).alias("above"), tess.alpha_test(corners, F.col("r2") * 0.999).alias("below")).collect()
    assert all((r["above"], r["below"]) == ((True, False) if r["r2"] is not None else (None, None)) for r in got)


def test_tilted_cell_wraps_and_keeps_reduced_coordinates(spark):
    box = C.Cell(((4.0, 0.0, 0.0), (1.0, 5.0, 0.0), (0.5, -1.0, 6.0)), (1.0, 2.0, 3.0), (True, False, True))
    pts = np.random.default_rng(1).normal(size=(30, 3)) * 20
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "frame_id bigint, i int, x double, y double, z double")
    j, cell, p = C.with_cell(df, C.prepare_cells(box.table(spark))), F.col("cell"), (F.col("x"), F.col("y"), F.col("z"))
    m = np.array(box.vectors)
    for r in j.select("i", la.packed(C.wrap_point(cell, p)).alias("w"), la.packed(C.reduced(cell, p)).alias("r"), cell["volume"].alias("v")).collect():
        want = np.linalg.solve(m.T, pts[r["i"]] - box.origin)
        assert np.allclose(r["r"], want)
        folded = want - np.floor(want) * np.array([1, 0, 1])
        assert np.allclose(np.array(r["w"]), folded @ m + box.origin) and math.isclose(r["v"], abs(np.linalg.det(m)))


def test_rescale_text():
    assert C.parse_rescale("1,2.5e0, 3abc,-4") == (1.0, 2.5, 3.0)
    for bad in ("1,2", "1,2,x", "1,0,2", "1,-1,2", ""):
        with pytest.raises(ValueError):
            C.parse_rescale(bad)


def test_ghost_images_equal_brute_force(spark):
    pts = np.random.default_rng(2).random((40, 3)) * 10
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(pts)], "frame_id bigint, particle bigint, x double, y double, z double")
    got = {(r["particle"], r["shift_a"], r["shift_b"], r["shift_c"]) for r in ghosts.ghost_images(df, C.prepare_cells(BOX.table(spark)), 2.0).collect()}
    want = {(i, *s) for i, p in enumerate(pts) for s in itertools.product((-1, 0, 1), repeat=3) if s != (0, 0, 0) and all(-2 <= p[d] + 10 * s[d] <= 12 for d in range(3))}
    assert got == want
    assert ghosts.cover_corners(df).count() == 8


def test_delaunay_fills_the_hull_with_empty_spheres(spark):
    pts = np.random.default_rng(3).random((120, 3))
    df = spark.createDataFrame([(f, i, *map(float, p)) for f in (0, 1) for i, p in enumerate(pts)], "frame_id bigint, vh int, x double, y double, z double")
    cells = delaunay.delaunay(df).filter("frame_id = 1").toPandas()
    finite = cells[cells.is_finite]
    for t in finite[["v0", "v1", "v2", "v3"]].to_numpy():
        p = pts[t]
        c = np.linalg.solve(2 * (p[1:] - p[0]), ((p[1:] - p[0]) ** 2).sum(axis=1))
        assert (((pts - p[0] - c) ** 2).sum(axis=1) < c @ c * (1 - 1e-9)).sum() == 0
    near = finite[["n0", "n1", "n2", "n3"]].to_numpy()
    for c, row in zip(finite.cell, near):
        for n in row:
            assert n in set(cells.cell)
            if n in set(finite.cell):
                assert c in near[list(finite.cell).index(n)]
    hull = cells[~cells.is_finite]
    v, f = len(set(hull[["v0", "v1", "v2"]].to_numpy().ravel())), len(hull)
    e = len({tuple(sorted(p)) for t in hull[["v0", "v1", "v2"]].to_numpy() for p in itertools.combinations(t, 2)})
    assert v - e + f == 2


def test_labels_spread_to_the_highest_neighbour(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 1, 4), (0, 5, 6)], "frame_id bigint, v1 int, v2 int")
    labels = spark.createDataFrame([(0, 0, 7), (0, 1, 0), (0, 2, 0), (0, 3, 0), (0, 4, 9), (0, 5, 0), (0, 6, 0)], "frame_id bigint, v int, cluster_id int")
    got = {r["v"]: r["cluster_id"] for r in elastic.propagate_labels(edges, labels).collect()}
    assert got == {0: 7, 1: 9, 2: 9, 3: 9, 4: 9, 5: 0, 6: 0}


def chain(spark):
    """Atoms 0-1-2-3 on a line, one lattice vector apart; atom 2 has no cluster."""
    n = [(0, a, s, b, [float(b - a), 0.0, 0.0]) for a in range(4) for s, b in enumerate(x for x in (a - 1, a + 1) if 0 <= x < 4)]
    neighbors = spark.createDataFrame(n, "frame_id bigint, atom_idx int, slot int, nbr_idx int, lv array<double>")
    clusters = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 0), (0, 3, 1)], "frame_id bigint, atom_idx int, cluster_id int")
    moves = spark.createDataFrame([(0, 1, 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 0)], "frame_id bigint, c1 int, c2 int, tm array<double>, distance int")
    return neighbors, clusters, moves


def test_crystal_paths(spark):
    pairs = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 0, 3), (0, 2, 1)], "frame_id bigint, a int, b int")
    got = {(r["a"], r["b"]): (r["pv"][0], r["n_steps"]) for r in elastic.crystal_paths(pairs, *chain(spark), steps=3).collect()}
    assert got == {(0, 1): (1.0, 1), (0, 2): (2.0, 2), (0, 3): (3.0, 3), (2, 1): (-1.0, 1)}
    short = elastic.crystal_paths(pairs, *chain(spark), steps=2).collect()
    assert {(r["a"], r["b"]) for r in short} == {(0, 1), (0, 2), (2, 1)}


def test_path_searches_keep_only_atoms_on_the_way(spark, monkeypatch):
    sizes, cut = [], elastic.cut_lineage

    def counted(df):
        out = cut(df)
        if "route" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(elastic, "cut_lineage", counted)
    # Atom 0 has 50 neighbours; one of them leads on to atom 100.
    steps = [(0, 0, k - 1, k, [1.0, 0.0, 0.0]) for k in range(1, 51)] + [(0, 7, 0, 100, [0.0, 1.0, 0.0])]
    near = spark.createDataFrame(steps, "frame_id bigint, atom_idx int, slot int, nbr_idx int, lv array<double>")
    clusters = spark.createDataFrame([(0, k, 1) for k in [*range(51), 100]], "frame_id bigint, atom_idx int, cluster_id int")
    moves = spark.createDataFrame([], "frame_id bigint, c1 int, c2 int, tm array<double>, distance int")
    pairs = spark.createDataFrame([(0, 0, 100)], "frame_id bigint, a int, b int")
    got = elastic.crystal_paths(pairs, near, clusters, moves).collect()
    assert [(r["b"], r["pv"], r["n_steps"]) for r in got] == [(100, [1.0, 1.0, 0.0], 2)]
    assert sizes == [1]


QUARTER = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
BACK = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
TURNS = "frame_id bigint, c1 int, c2 int, tm array<double>, distance int"


def test_paths_over_ranges_equal_those_of_joins(spark, monkeypatch):
    monkeypatch.setattr(paths, "SOURCES", 20)
    rng, near, clusters, pairs = np.random.default_rng(7), [], [], []
    for f, first, n in ((0, (1 << paths.BITS) - 40, 80), (3, 5, 30)):
        for a in range(first, first + n):
            to = rng.integers(first, first + n, rng.integers(0, 5))
            near += [(f, a, s, int(b), rng.integers(-3, 4, 3).astype(float).tolist()) for s, b in enumerate(to) if b != a]
            clusters += [(f, a, int(rng.integers(0, 4)))] if a % 7 else []
        pairs += [(f, *rng.integers(first, first + n, 2).tolist()) for _ in range(4 * n)]
    near = spark.createDataFrame(near, "frame_id bigint, atom_idx int, slot int, nbr_idx int, lv array<double>")
    clusters = spark.createDataFrame(clusters, "frame_id bigint, atom_idx int, cluster_id int")
    moves = spark.createDataFrame([(f, a, b, t, 1) for f in (0, 3) for a, b, t in ((1, 2, QUARTER), (2, 1, BACK), (2, 3, BACK))], TURNS)
    pairs = spark.createDataFrame(pairs, "frame_id bigint, a int, b int")
    told = lambda df: sorted((r["frame_id"], r["a"], r["b"], [x + 0.0 for x in r["pv"]], r["cluster"], r["n_steps"]) for r in df.collect())
    want = told(elastic.crystal_paths(pairs, near, clusters, moves))
    assert {r[-1] for r in want} == {1, 2, 3, 4}
    got = paths.crystal_paths(pairs, near, clusters, moves)
    assert told(got) == want and dict(got.dtypes)["a"] == "int"
    assert told(paths.crystal_paths(pairs.distinct(), near, clusters, moves, near=True)) == want
    assert told(paths.crystal_paths(pairs, near.limit(0), clusters.limit(0), moves.limit(0))) == []


def test_cells_over_ranges_equal_those_of_joins(spark):
    rng, first = np.random.default_rng(8), (1 << paths.BITS) - 10
    at = rng.integers(0, 5, (20, 3)).astype(float)
    turn = {1: np.eye(3), 2: np.array(QUARTER).reshape(3, 3), 3: np.array(BACK).reshape(3, 3)}
    cells = [(0, i, *(int(v) + first for v in rng.choice(20, 4, replace=i % 10 == 0))) for i in range(300)]
    found = [(0, a + first, b + first, (turn[c] @ (at[b] - at[a] + (rng.random() < 0.02))).tolist(), c) for a, b in itertools.combinations(range(20), 2) for c in [int(rng.choice((1, 1, 2, 3), p=(0.4, 0.4, 0.15, 0.05)))] if rng.random() < 0.97]
    cells = spark.createDataFrame(cells, "frame_id bigint, cell bigint, v0 int, v1 int, v2 int, v3 int")
    labels = spark.createDataFrame([(0, i + first, (1, 1, 2, 1, 2, 3, 0)[i % 7]) for i in range(20)], "frame_id bigint, v int, cluster_id int")
    found = spark.createDataFrame(found, "frame_id bigint, a int, b int, pv array<double>, cluster int")
    moves = spark.createDataFrame([(0, 1, 2, QUARTER, 1), (0, 2, 1, BACK, 1), (0, 3, 1, QUARTER, 1)], TURNS)
    edges = tess.tessellation_edges(cells)
    want = {r["cell"]: r["compatible"] for r in elastic.compatible_cells(cells, elastic.ideal_vectors(edges, labels, found, moves)).collect()}
    got = {r["cell"]: r["compatible"] for r in paths.compatible_cells(cells, labels, found, moves).collect()}
    assert got == want and 20 < sum(got.values()) < 280
    near = {(r["v1"], r["v2"]) for r in paths.near_edges(cells).collect()}
    assert near == {(r["v1"], r["v2"]) for r in edges.collect()}
    ways = {(r["v"], r["nbr"]) for r in paths.open_ways(edges, labels).collect()}
    lone = {i + first for i in range(6, 20, 7)}
    assert ways == {(a, b) for e in near for a, b in (e, e[::-1]) if a in lone}


def test_compatible_cells_store_no_joined_rows(spark):
    plan = queries.compatible_cells(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan and "hashpartitioning" not in plan


def test_compatible_cell_closes(spark):
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, a, b, (p[b] - p[a]).tolist(), 1, 1, eye, eye) for a, b in itertools.combinations(range(4), 2)]
    rows += [(0, a + 4, b + 4, (p[b] - p[a] + (0.5 if (a, b) == (1, 2) else 0)).tolist(), 1, 1, eye, eye) for a, b in itertools.combinations(range(4), 2)]
    rows += [(0, 8, 9, None, None, None, None, None)]
    edges = spark.createDataFrame(rows, "frame_id bigint, v1 int, v2 int, cv array<double>, c1 int, c2 int, tm array<double>, rtm array<double>")
    cells = spark.createDataFrame([(0, 0, 0, 1, 2, 3), (0, 1, 3, 1, 0, 2), (0, 2, 4, 5, 6, 7), (0, 3, 8, 9, 10, 11), (0, 4, 0, 0, 1, 2)], "frame_id bigint, cell bigint, v0 int, v1 int, v2 int, v3 int")
    got = {r["cell"]: r["compatible"] for r in elastic.compatible_cells(cells, edges).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_clipping_keeps_length_and_stays_inside(spark):
    pts = np.cumsum(np.random.default_rng(4).normal(size=(50, 3)) * 2, axis=0)
    chunks = lines.clip_polyline(pts, np.array(BOX.vectors), np.zeros(3), [True, True, True])
    assert math.isclose(sum(np.linalg.norm(np.diff(c, axis=0), axis=1).sum() for c in chunks), np.linalg.norm(np.diff(pts, axis=0), axis=1).sum(), rel_tol=1e-9)
    assert all((c > -1e-6).all() and (c < 10 + 1e-6).all() for c in chunks) and len(chunks) > 1
    df = spark.createDataFrame([(0, 1, polyline(pts)), (0, 2, polyline([(1, 1, 1)]))], "frame_id bigint, segment_id int, line array<struct<x:double,y:double,z:double>>")
    got = lines.clip_lines(df, BOX.table(spark)).collect()
    assert len(got) == len(chunks) and {r["segment_id"] for r in got} == {1}


def test_smoothing_and_coarsening_limits(spark):
    zig = [(i, i % 2, 0) for i in range(9)]
    loop3 = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)]
    rows = [(0, 1, polyline(zig), [3] * 9, False, False), (0, 2, polyline(loop3), [3] * 4, True, False), (0, 3, polyline(zig[:2]), [3] * 2, False, False), (0, 4, polyline(zig[:1]), [3], False, False), (0, 5, polyline(zig), [], False, False)]
    df = spark.createDataFrame(rows, LINE)
    got = {r["segment_id"]: r for r in lines.smooth_lines(df, 1.0, 2.5).collect()}
    ends = got[1]["line"]
    assert (ends[0]["x"], ends[-1]["x"]) == (0.0, 8.0) and len(ends) < 9 and length(ends) < length(polyline(zig))
    assert [p["x"] for p in got[2]["line"]] == [0, 1, 0, 0] and len(got[3]["line"]) == 2 and len(got[4]["line"]) == 0
    assert len(got[5]["line"]) == 9 and got[1]["core_size"] == []


def test_orientation_and_length_of_short_lines(spark):
    df = spark.createDataFrame([(0, 1, polyline([(0, 0, 0), (-5, 1, 0)]), 1.0), (0, 2, polyline([(0, 0, 0), (5, -5, 0)]), 1.0), (0, 3, polyline([(0, 0, 0), (0, 0, 0)]), 1.0), (0, 4, [], 1.0)], "frame_id bigint, segment_id int, line array<struct<x:double,y:double,z:double>>, bx double")
    got = {r["segment_id"]: (r["flipped"], r["bx"]) for r in lines.orient(df).collect()}
    assert got == {1: (True, -1.0), 2: (True, -1.0), 3: (False, 1.0), 4: (False, 1.0)}
    assert [r[0] for r in df.orderBy("segment_id").select(lines.line_length(F.col("line"))).collect()][2:] == [0.0, 0.0]


def test_rings(spark):
    nodes = [(0, i, "fwd", r, 4, r == 0, False) for i, r in enumerate([0, 1, 1, 2, 2, 2, 3, 3, 3, 3])]
    df = spark.createDataFrame(nodes, "frame_id bigint, segment_id int, side string, ring_id bigint, edge_count int, is_dangling boolean, is_blocked boolean")
    assert {r["arms"]: (r["n_nodes"], r["total"]) for r in network.junction_arms(df).collect()} == {2: (2, 9), 3: (3, 9), 4: (4, 9)}
    alone = df.filter("ring_id = 0")
    assert [tuple(r)[1:] for r in network.junction_arms(alone).collect()] == [(0, 0, 0)]
    assert network.count_junctions(df).first()["n_junctions"] == 4
    assert {r["ring_id"] for r in network.dissolve(df, F.col("segment_id") == 3).filter("segment_id in (3, 4, 5)").collect()} == {None}
    links = spark.createDataFrame([(0, i, i + 1) for i in range(30)] + [(1, 5, 6)], "frame_id bigint, a bigint, b bigint")
    got = network.ring_classes(links).collect()
    assert {r["ring_id"] for r in got if r["frame_id"] == 0} == {0} and {r["ring_id"] for r in got if r["frame_id"] == 1} == {5}


def test_bowtie_is_split_into_manifolds(spark):
    tetra = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    other = [tuple({0: 0, 1: 4, 2: 5, 3: 6}[v] for v in t) for t in tetra]
    faces = spark.createDataFrame([(0, i, *t) for i, t in enumerate(tetra + other)], "frame_id bigint, face int, a int, b int, c int")
    linked = mesh.link_opposites(mesh.half_edges(faces))
    assert mesh.watertight(linked).first()["is_closed"]
    assert {r["v"]: r["n_manifolds"] for r in mesh.manifold_counts(linked).collect()} == {0: 2, **dict.fromkeys(range(1, 7), 1)}
    split, vertices = mesh.make_manifold(faces, linked)
    assert vertices.count() == 8 and split.count() == 8
    again = mesh.link_opposites(mesh.half_edges(split))
    assert {r["n_manifolds"] for r in mesh.manifold_counts(again).collect()} == {1}
    assert tess.euler_characteristic(split).first()["euler"] == 4
    open_mesh = mesh.link_opposites(mesh.half_edges(faces.filter("face <> 0")))
    assert mesh.watertight(open_mesh).first()["n_open"] == 3


def test_unwrapped_corners_become_new_points(spark):
    points = spark.createDataFrame([(0, 0, 0.5, 1.0, 1.0), (0, 1, 9.5, 1.0, 1.0), (0, 2, 0.5, 2.0, 1.0)], "frame_id bigint, v int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 0, 1, 2)], "frame_id bigint, face int, a int, b int, c int")
    pts, facets = mesh.unwrap_faces(faces, points, C.prepare_cells(BOX.table(spark)))
    new = pts.filter("point = 3").first()
    assert math.isclose(new["x"], -0.5) and new["of"] == 1 and tuple(facets.first())[2:] == (0, 3, 2)


def test_triangles_overlap():
    base = ((0, 0, 0), (2, 0, 0), (0, 2, 0))
    cases = [(((0.5, 0.5, -1), (0.5, 0.5, 1), (0.6, 0.5, 1)), True), (((3, 3, -1), (3, 3, 1), (4, 3, 1)), False), (((0, 0, 1), (2, 0, 1), (0, 2, 1)), False), (((0.2, 0.2, 0), (0.4, 0.2, 0), (0.2, 0.4, 0)), True), (((5, 5, 0), (6, 5, 0), (5, 6, 0)), False)]
    p, q = np.array([base] * len(cases), float), np.array([t for t, _ in cases], float)
    assert mesh.triangles_meet(p, q).tolist() == [w for _, w in cases] == mesh.triangles_meet(q, p).tolist()


def test_core_atoms_and_regions(spark):
    claims = spark.createDataFrame([(0, 1, 5, 0, 1, 2, 3), (0, 9, 6, 3, 4, 5, 0)], "frame_id bigint, cell bigint, segment_id int, v0 int, v1 int, v2 int, v3 int")
    atoms = spark.createDataFrame([(0, i, None, None, 1.0, 2.0, 1, i % 2) for i in range(8)], "frame_id bigint, atom_idx int, id int, x double, y double, z double, structure_type int, cluster_id int")
    marked = regions.core_atom_ids(claims, atoms)
    assert {r["atom_idx"]: r["dislocation_id"] for r in marked.collect()} == {0: 6, 1: 5, 2: 5, 3: 6, 4: 6, 5: 6, 6: -1, 7: -1}
    assert {(r["id"], r["x"]) for r in regions.core_atoms(marked).collect()} == {(i, 0.0) for i in range(6)}
    assert regions.count_marked(marked).first()["n_core_atoms"] == 6
    assert tuple(regions.region_totals(atoms).first())[1:] == (8, 1, 4, 4, 4)


def test_replaced_segments_lead_to_their_root(spark):
    df = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(40)], "frame_id bigint, segment_id int, replaced_with int")
    assert {r["root"] for r in network.chase_replaced(df).collect()} == {0}


def test_options():
    o, rest = DxaOptions.from_arguments(["in.dump", "out", "--max_trial_circuit_size", "12.9", "--mark_core_atoms", "--clip_pbc_segments=false", "--metric-rescale", "1,2,3"])
    assert rest == ["in.dump", "out"] and o.max_trial_circuit_size == 12 and o.mark_core_atoms and not o.clip_pbc_segments and o.metric_rescale == (1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        o.require()
    with pytest.raises(ValueError):
        DxaOptions.from_mapping({"nothing": 1})


DUMP = """ITEM: TIMESTEP
{step}
ITEM: NUMBER OF ATOMS
3
ITEM: BOX BOUNDS pp pp ff
0 10
0 20
-5 5
ITEM: ATOMS id type x y z structure_type cluster_id
7 1 1.0 2.0 3.0 1 2
8 1 4.0 5.0 0.5 1 2
9 1 9.0 19.0 -4.0 0 0
"""


@pytest.mark.parametrize("split", [1 << 20, 50])
def test_dump_frames_are_read_once(spark, tmp_path, split):
    (tmp_path / "a.dump").write_text("".join(DUMP.format(step=s) for s in range(0, 50, 10)))
    spark.dataSource.register(lammps.LammpsDump)
    df = spark.read.format("lammpsdump").option("split_bytes", str(split)).load(str(tmp_path / "*.dump"))
    rows = df.collect()
    assert sorted((r["frame_id"], r["id"]) for r in rows) == [(s, i) for s in range(0, 50, 10) for i in (7, 8, 9)]
    assert rows[0]["matrix"][1] == [0.0, 20.0, 0.0] and rows[0]["origin"] == [0.0, 0.0, -5.0] and rows[0]["pbc"] == [True, True, False]
    atoms, cells = lammps.read_dump(spark, str(tmp_path / "a.dump"))
    assert lammps.validate_frames(atoms, cells).count() == 0
    assert lammps.validate_frames(atoms, cells.filter("frame_id > 0")).first()["error"] == "not one simulation cell"


def test_lattices_have_their_vectors(spark, tmp_path):
    (tmp_path / "own.yml").write_text("name: own\ncoordination_number: 2\nneighbor_vectors:\n  - [1, 0, 0]\n  - [-1, 0, 0]\n")
    (tmp_path / "bad.yml").write_text("nothing")
    rows = {r["name"]: r for r in lattices.catalogue(spark, str(tmp_path)).collect()}
    assert rows["own"]["coordination"] == 2 and "bad" not in rows and len(rows) == 11
    for r in rows.values():
        v = {tuple(round(x, 6) for x in n) for n in r["nv"]}
        assert len(v) == len(r["nv"]) and v == {tuple(round(0.0 - x, 6) for x in n) for n in v}
    names = spark.createDataFrame([(" FCC",), ("odd",)], "name string")
    assert [r["canonical"] for r in lattices.canonical_names(names, lattices.catalogue(spark)).orderBy("name").collect()] == ["fcc", "odd"]
