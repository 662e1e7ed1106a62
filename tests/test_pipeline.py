"""Whole analyses of small crystals, junctions, and crystals' tessellations."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from xtalspark.functions import cell as C
from xtalspark.operators import delaunay, elastic, mesh, network, tess, tracer
from xtalspark.plans.options import DxaOptions
from xtalspark.plans.pipeline import DxaPipeline, analyse
from xtalspark.sources import lattices, sinks, tables
from xtalspark.streaming import frames

R2 = 2**0.5
#: Rows are the axes [1-10], [001], [110] of a crystal in the frame of the box.
AXES = np.array([[1, -1, 0], [0, 0, R2], [1, 1, 0]]) / R2
IDEAL = np.array([v for v in itertools.product((-0.5, 0, 0.5), repeat=3) if np.abs(v).sum() == 1])


def block(n, screw=False):
    """(positions, box, pbc) of fcc with the third axis along [110]; with a screw, one of
    Burgers vector 1/2[110] stands in the middle and the sides are free."""
    size = np.array(n) * np.array([1 / R2, 1, 1 / R2])
    g = np.array(list(itertools.product(*map(range, n))), float)
    pts = np.concatenate([g, g + 0.5]) * np.array([1 / R2, 1, 1 / R2])
    if screw:
        x, y = (pts[:, :2] - size[:2] / 2 + np.array([0.13, 0.21])).T
        pts[:, 2] += np.arctan2(y, x) / (2 * np.pi) / R2
    pbc = np.array([not screw, not screw, True])
    return np.where(pbc, pts - np.floor(pts / size) * size, pts), size, pbc


def identify(pts, size, pbc):
    """Neighbour rows (atom, slot, neighbour, lattice vector) and clusters: an atom whose twelve ideal
    vectors all have a neighbour is in cluster 1."""
    rows, cluster = [], np.zeros(len(pts), int)
    want = IDEAL @ AXES.T
    for i, p in enumerate(pts):
        d = pts - p
        d -= np.where(pbc, np.floor(d / size + 0.5) * size, 0)
        slots = [(k, j) for k, w in enumerate(want) for j in np.flatnonzero(((d - w) ** 2).sum(axis=1) < 0.06) if j != i]
        cluster[i] = len({k for k, _ in slots}) == 12 == len(slots)
        rows += [(i, s, int(j), IDEAL[k].tolist()) for s, (k, j) in enumerate(slots)]
    return rows, cluster


def pipeline(spark, base, frames_of, **given):
    """A pipeline over frames (pts, size, pbc), its tables written under base."""
    eye = np.eye(3).ravel().tolist()
    atoms, cells, near, clusters, moves = [], [], [], [], []
    for f, (pts, size, pbc) in enumerate(frames_of):
        rows, cluster = identify(pts, size, pbc)
        atoms += [(f, i, i + 1, *map(float, p), int(c), int(c)) for i, (p, c) in enumerate(zip(pts, cluster))]
        near += [(f, *r) for r in rows]
        cells.append((f, np.diag(size).tolist(), [0.0, 0.0, 0.0], [bool(x) for x in pbc]))
        clusters.append((f, 1, 1, "FCC", AXES.ravel().tolist()))
        moves.append((f, 1, 1, eye, 0))
    for name, rows, schema in (("clusters", clusters, tables.CLUSTERS), ("moves", moves, tables.TRANSITIONS), ("near", near, tables.NEIGHBORS)):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{base}/{name}")
    o = DxaOptions.from_mapping({"clusters_table": f"{base}/clusters", "clusters_transitions": f"{base}/moves", "neighbor_lattice": f"{base}/near", "reference_topology": "fcc"} | given)
    return DxaPipeline.from_paths(spark, o, spark.createDataFrame(atoms, tables.ATOMS), spark.createDataFrame(cells, tables.CELL))


def lattice(kind, n):
    g = np.array(list(itertools.product(range(n), repeat=3)), float)
    if kind == "hcp":
        a = np.array([(1, 0, 0), (0.5, 0.75**0.5, 0), (0, 0, (8 / 3) ** 0.5)])
        return np.concatenate([g @ a, g @ a + np.array([0.5, 0.75**0.5 / 3, (2 / 3) ** 0.5])])
    base = {"sc": [(0, 0, 0)], "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)], "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]}[kind]
    return np.concatenate([g + np.array(b) for b in base])


@pytest.mark.parametrize("jitter", [0.0, 1e-9])
@pytest.mark.parametrize("kind", ["sc", "bcc", "fcc", "hcp"])
def test_crystals_are_filled_with_sound_cells(kind, jitter):
    pts = lattice(kind, 4)
    pts = pts + np.random.default_rng(5).uniform(-jitter, jitter, pts.shape)
    corners, sides = delaunay.tessellate(pts)
    p = pts[corners]
    volume = np.linalg.det(p[:, 1:] - p[:, :1]) / 6
    assert (volume > 0).all() and len(np.unique(corners)) == len(pts)
    # The hull's volume by the divergence theorem over the facets without a neighbour.
    hull = sum(np.dot(a, np.cross(b, c)) / 6 for t, s in zip(corners, sides) for f in range(4) if s[f] < 0 for a, b, c in [pts[t[list(tess.FACETS[f])]]])
    assert np.isclose(volume.sum(), -hull)  # facets face the corner they leave out
    for c, row in enumerate(sides):
        for i, m in enumerate(row):
            assert m < 0 or (c in sides[m] and len({*corners[c]} & {*corners[m]}) == 3 and corners[c, i] not in corners[m])
    # No point is inside a sphere by more than the rounding.
    m = 2 * (p[:, 1:] - p[:, :1])
    fat = volume > 1e-6
    centre = np.linalg.solve(m[fat], ((p[fat, 1:] - p[fat, :1]) ** 2).sum(axis=2)[..., None])[..., 0]
    r2 = (centre**2).sum(axis=1)
    d2 = ((pts[None] - (p[fat, 0] + centre)[:, None]) ** 2).sum(axis=2)
    assert (d2 > r2[:, None] - 1e-6).all()


def test_tessellation_does_not_depend_on_the_sweep(monkeypatch):
    pts = lattice("fcc", 3)
    as_sets = lambda c: {tuple(sorted(t)) for t in c.tolist()}
    one = as_sets(delaunay.tessellate(pts)[0])
    monkeypatch.setattr(delaunay, "_sweep_order", lambda p: np.random.default_rng(6).permutation(len(p)).tolist())
    assert as_sets(delaunay.tessellate(pts)[0]) == one


def test_points_in_a_plane_and_equal_points():
    flat = np.c_[np.random.default_rng(7).random((9, 2)), np.zeros(9)]
    assert len(delaunay.tessellate(flat)[0]) == 0 and len(delaunay.tessellate(flat[:2])[0]) == 0
    assert len(delaunay.tessellate(np.zeros((6, 3)))[0]) == 0
    pts = np.concatenate([lattice("sc", 2), lattice("sc", 2)])
    corners, _ = delaunay.tessellate(pts)
    assert len({tuple(pts[v]) for v in np.unique(corners)}) == 8 == len(np.unique(corners))


def test_screw_is_one_infinite_line_and_a_perfect_crystal_has_none(spark, tmp_path):
    """Frame 0 has a screw dislocation, frame 1 is perfect."""
    n, m = (10, 7, 5), (5, 4, 5)
    p = pipeline(spark, str(tmp_path / "in"), [block(n, screw=True), block(m)], mark_core_atoms=True, clip_pbc_segments=False, export_interface_mesh=True, export_delaunay_tessellation=True, export_structure_identification=True, export_coherent_crystalline_regions=True)
    assert p.interface.filter("frame_id = 1").count() == 0
    real = p.classified.filter("frame_id = 1 and is_finite and not is_ghost").select("region", "p0", "p1", "p2", "p3").collect()
    at = np.array([[[r[f"p{i}"][a] for a in "xyz"] for i in range(4)] for r in real])
    assert {r["region"] for r in real} == {1} and np.isclose(np.linalg.det(at[:, 1:] - at[:, :1]).sum() / 6, np.prod(m) / 2)
    rows = p.dislocations.collect()
    assert len(rows) == 1 and rows[0]["frame_id"] == 0
    r = rows[0]
    assert r["burgers_family"] == "1/2<110>" and np.isclose(r["magnitude"], 1 / R2) and r["crystal_structure"] == "fcc"
    b = np.array(r["burgers_vector_global"])
    assert np.allclose(np.abs(b), (0, 0, 1 / R2), atol=1e-6)
    # Before smoothing, which takes the ends of a line that winds through the cell for those of a closed ring.
    line = np.array([[q[a] for a in "xyz"] for q in p.finished.first()["line"]])
    assert p.segments.first()["is_infinite"] and np.allclose(np.abs(line[-1] - line[0]), (0, 0, n[2] / R2), atol=1e-6)
    mid = line[:, :2].mean(axis=0)
    assert np.abs(mid - np.array([n[0] / R2 / 2, n[1] / 2])).max() < 1.0 and np.abs(line[:, :2] - mid).max() < 1.0
    out = p.export(str(tmp_path / "out"))
    core = spark.read.parquet(out["core_atoms"]).toPandas()
    assert len(core) and (core.dislocation_id == 0).all() and np.hypot(core.x - mid[0], core.y - mid[1]).max() < 2.0
    stats = spark.read.parquet(out["network"]).first()
    assert stats["n_segments"] == 1 and stats["n_dangling_segments"] == 0
    assert spark.read.parquet(out["burgers_counts"]).first()["segment_count"] == 1
    assert spark.read.parquet(out["defect_mesh_topology"]).count() >= 1 and spark.read.parquet(out["interface_mesh_cell"]).count() == 2
    assert {x["n_lines"] for x in p.summary().collect()} == {0, 1}


def test_answers_name_what_went_wrong(spark, tmp_path):
    assert analyse(spark, ["a", "b"]) == {"is_failed": True, "error": "DXA failed: --reference_topology is required"}
    given = [x for k in ("clusters_table", "clusters_transitions", "neighbor_lattice") for x in (f"--{k}", str(tmp_path / k))] + ["--reference_topology", " FCC"]
    answer = analyse(spark, [*given, str(tmp_path / "none.dump"), str(tmp_path / "out")])
    assert answer["is_failed"] and json.dumps(answer)
    with pytest.raises(ValueError):
        DxaOptions(reference_topology="fcc", clusters_table="a", clusters_transitions="b", neighbor_lattice="c", crystal_path_steps=0).require()
    assert DxaOptions(reference_topology=" FCC").named(lattices.catalogue(spark)).reference_topology == "fcc"
    assert DxaOptions(reference_topology="Odd").named(lattices.catalogue(spark)).reference_topology == "Odd"


def tee(high=4):
    """Open tubes of one voxel's width along -x, +x and +y that meet; (positions, faces)."""
    voxels = {(x, 0, 0) for x in range(-high, high + 1)} | {(0, y, 0) for y in range(1, high + 1)}
    ends = {((-high, 0, 0), (-1, 0, 0)), ((high, 0, 0), (1, 0, 0)), ((0, high, 0), (0, 1, 0))}
    ids, faces = {}, []
    for v in sorted(voxels):
        for axis in range(3):
            for way in (-1, 1):
                step = tuple(way * (k == axis) for k in range(3))
                if tuple(a + b for a, b in zip(v, step)) in voxels or (v, step) in ends:
                    continue
                i, j = [k for k in range(3) if k != axis]
                corner = [list(v) for _ in range(4)]
                for c, (s, t) in zip(corner, ((0, 0), (1, 0), (1, 1), (0, 1))):
                    c[axis] += way > 0
                    c[i] += s
                    c[j] += t
                normal = np.cross(np.subtract(corner[1], corner[0]), np.subtract(corner[2], corner[0]))
                if normal[axis] * way < 0:
                    corner.reverse()
                q = [ids.setdefault(tuple(c), len(ids)) for c in corner]
                faces += [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
    return np.array(list(ids), float), faces


def test_three_lines_meet_in_a_junction(spark):
    """Two cuts run along the tubes' lower side; crossing one adds a Burgers vector."""
    at, faces = tee()
    b1, b2 = np.array([0.5, 0.5, 0.0]), np.array([0.0, -0.5, 0.5])
    side1 = (at[:, 1] >= 1).astype(float)
    side2 = ((at[:, 0] >= 1) & (at[:, 1] >= 1)).astype(float)
    low = at[:, 2] == 0
    points = spark.createDataFrame([(0, v, *map(float, p)) for v, p in enumerate(at)], "frame_id bigint, v int, x double, y double, z double")
    m = spark.createDataFrame([(0, i, *t) for i, t in enumerate(faces)], "frame_id bigint, face int, a int, b int, c int")
    e = mesh.link_opposites(mesh.half_edges(m)).toPandas()
    eye = np.eye(3).ravel().tolist()
    rows = []
    for r in e.itertuples():
        step = at[r.v2] - at[r.v1]
        jump = (low[r.v1] & low[r.v2]) * 1.0
        cv = step + jump * ((side1[r.v2] - side1[r.v1]) * b1 + (side2[r.v2] - side2[r.v1]) * b2)
        opp = (None, None) if np.isnan(r.opp_face) else (int(r.opp_face), int(r.opp_slot))
        rows.append((0, r.face, r.slot, r.v1, r.v2, *opp, *step.tolist(), cv.tolist(), 1, 1, eye))
    edges = spark.createDataFrame(rows, "frame_id bigint, face int, slot int, v1 int, v2 int, opp_face int, opp_slot int, px double, py double, pz double, cv array<double>, c1 int, c2 int, rtm array<double>")
    boxes = C.prepare_cells(C.Cell(((40.0, 0.0, 0.0), (0.0, 40.0, 0.0), (0.0, 0.0, 40.0)), pbc=(False, False, False)).table(spark))
    seg = tracer.trace(edges, points, boxes).collect()
    assert len(seg) == 3
    out, rings = [], []
    for s in seg:
        b = np.array([s["bx"], s["by"], s["bz"]])
        for n in s["nodes"]:
            if n["ring_id"] is not None:
                out.append(b if n["side"] == "fwd" else -b)
                rings.append(n["ring_id"])
                end = s["line"][-1 if n["side"] == "fwd" else 0]
                assert np.abs(np.array([end[a] for a in "xyz"]) - 0.5).max() < 1.5
    assert len(out) == 3 and len(set(rings)) == 1 and np.allclose(sum(out), 0)
    df = spark.createDataFrame([(0, i, n["side"], n["ring_id"], n["edge_count"], n["is_dangling"], n["is_blocked"]) for i, s in enumerate(seg) for n in s["nodes"]], tables.NODES)
    assert [tuple(r)[1:] for r in network.junction_arms(df).collect()] == [(3, 3, 3)]


def test_opposite_edges_are_found_by_turning_through_the_cells(spark):
    """Two pairs of cells share one edge; each pair's faces are joined to its own, whatever their numbers."""
    cells = [(0, 0, 1, 2, 3), (1, 0, 1, 3, 4), (2, 0, 1, 5, 6), (3, 0, 1, 6, 7)]
    rows = [(0, c, *v, *v, 1) for c, *v in cells]
    schema = "frame_id bigint, cell bigint, v0 int, v1 int, v2 int, v3 int, a0 int, a1 int, a2 int, a3 int, region int"
    df = spark.createDataFrame(rows, schema)
    outer = tess.neighbors_of(df, "region").filter("other_cell is null").select("frame_id", "cell", "face", "a", "b", "c")
    faces = mesh.mesh_from_interface(outer)
    got = mesh.link_around_edges(faces, df).toPandas()
    cell_of = {r["face"]: r["cell"] for r in faces.collect()}
    at_edge = got[[{a, b} == {0, 1} for a, b in zip(got.v1, got.v2)]]
    assert len(at_edge) == 4 and not got.opp_face.isna().any()
    assert all({cell_of[a] // 2, cell_of[b] // 2} in ({0}, {1}) for a, b in zip(at_edge.face, at_edge.opp_face))
    back = {(r.face, r.slot): (r.opp_face, r.opp_slot) for r in got.itertuples()}
    assert all(back[v] == k for k, v in back.items())


def test_reverse_step_needs_only_the_clustered_neighbours_list(spark):
    near = spark.createDataFrame([(0, 1, 0, 2, [1.0, 0.0, 0.0])], tables.NEIGHBORS)
    clusters = spark.createDataFrame([(0, 1, 1), (0, 2, 0)], "frame_id bigint, atom_idx int, cluster_id int")
    moves = spark.createDataFrame([], tables.TRANSITIONS)
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "frame_id bigint, a int, b int")
    got = {(r["a"], r["b"]): r["pv"][0] for r in elastic.crystal_paths(pairs, near, clusters, moves).collect()}
    assert got == {(1, 2): 1.0, (2, 1): -1.0}


def test_ideal_vectors_turn_between_clusters(spark):
    quarter = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    back = np.array(quarter).reshape(3, 3).T.ravel().tolist()
    moves = spark.createDataFrame([(0, 1, 2, quarter, 1), (0, 2, 1, back, 1)], tables.TRANSITIONS)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "frame_id bigint, v1 int, v2 int")
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 2), (0, 3, 0)], "frame_id bigint, v int, cluster_id int")
    paths = spark.createDataFrame([(0, 0, 1, [1.0, 0.0, 0.0], 2), (0, 1, 2, [0.0, 1.0, 0.0], 2), (0, 2, 3, [1.0, 1.0, 0.0], 2)], "frame_id bigint, a int, b int, pv array<double>, cluster int")
    got = {r["v1"]: r for r in elastic.ideal_vectors(edges, labels, paths, moves).collect()}
    assert np.allclose(got[0]["cv"], (0, -1, 0)) and got[0]["tm"] == quarter and np.allclose(got[0]["rtm"], back)
    assert np.allclose(got[1]["cv"], (0, 1, 0)) and np.allclose(got[1]["tm"], np.eye(3).ravel()) and got[2]["cv"] is None
    moved = network.to_cluster(spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1, 2), (0, 1.0, 2.0, 3.0, 1, 1), (0, 1.0, 2.0, 3.0, 1, 7)], "frame_id bigint, bx double, by double, bz double, cluster_id int, target int"), moves)
    assert sorted((r["cluster_id"], r["bx"], r["by"]) for r in moved.filter("bx is not null").collect()) == [(1, 1.0, 2.0), (2, -2.0, 1.0)]


def test_meshes_smooth_and_defect_meshes_are_capped(spark):
    tetra = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    faces = spark.createDataFrame([(0, i, *t, 5 if i == 3 else None, 1 if i == 3 else None, True) for i, t in enumerate(tetra)], "frame_id bigint, face int, a int, b int, c int, circuit_id int, flag int, circuit_dangling boolean")
    caps = spark.createDataFrame([(0, 4, b, a) for a, b in ((2, 1), (3, 2), (1, 3))], "frame_id bigint, apex int, v1 int, v2 int")
    out = mesh.defect_mesh(faces, caps.select("frame_id", "apex", F.col("v2").alias("v1"), F.col("v1").alias("v2")))
    assert out.count() == 6 and out.filter("face = 3").count() == 0
    assert mesh.watertight(mesh.link_opposites(mesh.half_edges(out))).first()["is_closed"] != mesh.watertight(mesh.link_opposites(mesh.half_edges(mesh.defect_mesh(faces, caps)))).first()["is_closed"]
    corners = [(0, i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])]
    v = spark.createDataFrame(corners, "frame_id bigint, v int, x double, y double, z double")
    got = {r["v"]: np.array([r["x"], r["y"], r["z"]]) for r in mesh.smooth_mesh(v, faces, 1).collect()}
    p = np.array([c[2:] for c in corners])
    for w in (0.5, -0.52):
        p = p + w * ((p.sum(axis=0) - p) / 3 - p)
    assert np.allclose([got[i] for i in range(4)], p)


def test_segments_are_discarded_and_nodes_have_ends(spark):
    line = [{"x": float(i), "y": 0.0, "z": 0.0} for i in range(3)]
    seg = spark.createDataFrame([(0, 1, line, [3] * 3, 1.0, 2.0, 3.0, 1), (0, 2, line, [3] * 3, 1.0, 0.0, 0.0, 1)], tables.SEGMENTS)
    assert [r["segment_id"] for r in network.discard_segments(seg, seg.filter("segment_id = 2").select("frame_id", "segment_id")).collect()] == [1]
    nodes = spark.createDataFrame([(0, 1, "fwd", None, 3, True, False), (0, 1, "bwd", None, 3, True, False)], tables.NODES)
    got = {r["side"]: (r["px"], r["nbx"]) for r in network.node_vectors(nodes, seg).collect()}
    assert got == {"fwd": (2.0, 1.0), "bwd": (0.0, -1.0)}


def test_structures_are_joined_and_written(spark, tmp_path):
    atoms = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 0.0, None, 1), (0, 1, 2, 9.0, 0.0, 0.0, None, 7), (0, 2, 3, 2.0, 0.0, 0.0, 4, None)], tables.ATOMS)
    clusters = spark.createDataFrame([(0, 1, 1, " FCC ", None)], tables.CLUSTERS)
    near = spark.createDataFrame([(0, 0, 0, 1, [1.0, 0.0, 0.0]), (0, 0, 1, 2, [1.0, 0.0, 0.0])], tables.NEIGHBORS)
    full, pairs = tables.reconstruct(atoms, tables.canonical_clusters(clusters, lattices.catalogue(spark)), near)
    assert [tuple(r) for r in full.orderBy("atom_idx").select("cluster_id", "structure_type", "topology_name").collect()] == [(1, 1, "fcc"), (0, 0, None), (0, 4, None)]
    box = C.prepare_cells(C.Cell(((10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (0.0, 0.0, 10.0))).table(spark))
    assert np.isclose(tables.max_neighbor_distance(pairs, box).first()["max_distance"], 2.0)
    base = str(tmp_path / "out")
    for paths in (sinks.structures(full, base), sinks.crystalline_regions(full, clusters, base), sinks.core_atoms(full.withColumn("dislocation_id", F.col("atom_idx") - 1), base)):
        assert all(spark.read.parquet(p).count() for p in paths.values())


def test_frames_stream_in_batches_once(spark, tmp_path):
    src, out, done = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = lambda f: spark.createDataFrame([(f, i, i, 0.0, 0.0, 0.0, 1, 1) for i in range(3)], tables.ATOMS)
    rows(0).write.parquet(src)
    count = lambda batch: batch.groupBy("frame_id").agg(F.count("*").alias("n"))
    frames.write_frames(frames.read_frames(spark, src), count, out, done, once=True).awaitTermination()
    rows(1).write.mode("append").parquet(src)
    frames.write_frames(frames.read_frames(spark, src), count, out, done, once=True).awaitTermination()
    assert sorted((r["frame_id"], r["n"]) for r in spark.read.parquet(out).collect()) == [(0, 3), (1, 3)]
