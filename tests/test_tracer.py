"""Lines around a tube whose ideal vectors do not close are found; perfect tubes have none."""

import numpy as np
from pyspark.sql import functions as F

from xtalspark.functions import cell as C
from xtalspark.operators import elastic, lines, mesh, network, regions, tracer

HIGH, N, LAYERS = 12.0, 6, 9
_made = {}


def tube(spark, burgers):
    """The half-edges of frame 0 of a tube, its vertices and cell; each is made once."""
    if burgers not in _made:
        e, points, boxes = make_tube(spark, burgers)
        _made[burgers] = elastic.cut_lineage(e), points, elastic.cut_lineage(boxes)
    return _made[burgers]


def make_tube(spark, burgers, frames=(0,)):
    """A tube along a periodic axis; going around it once misses by the Burgers vector."""
    at = {k * N + i: (5 + 2 * np.cos(2 * np.pi * i / N), 5 + 2 * np.sin(2 * np.pi * i / N), HIGH * k / LAYERS) for k in range(LAYERS) for i in range(N)}
    faces = []
    for k in range(LAYERS):
        for i in range(N):
            a, b, c, d = k * N + i, k * N + (i + 1) % N, (k + 1) % LAYERS * N + (i + 1) % N, (k + 1) % LAYERS * N + i
            faces += [(a, b, c), (a, c, d)]
    box = C.Cell(((20.0, 0.0, 0.0), (0.0, 20.0, 0.0), (0.0, 0.0, HIGH)), pbc=(False, False, True))
    boxes = None
    for f in frames:
        b = C.prepare_cells(box.table(spark, f))
        boxes = b if boxes is None else boxes.unionByName(b)
    points = spark.createDataFrame([(f, v, *map(float, p)) for f in frames for v, p in at.items()], "frame_id bigint, v int, x double, y double, z double")
    m = spark.createDataFrame([(f, i, *t) for f in frames for i, t in enumerate(faces)], "frame_id bigint, face int, a int, b int, c int")
    eye = F.array(*(F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)))
    share = lambda v: ((F.col(v) % N) / N)
    ahead = share("v2") - share("v1")
    ahead = ahead - F.floor(ahead + 0.5)
    empty = spark.createDataFrame([], "frame_id bigint, v1 int, v2 int, cv array<double>, c1 int, c2 int, tm array<double>, rtm array<double>")
    e = mesh.edge_vectors(mesh.link_opposites(mesh.half_edges(m)), points.withColumnRenamed("v", "atom_idx"), boxes, empty)
    ideal = F.array(*(F.col(f"p{a}") + ahead * float(b) for a, b in zip("xyz", burgers)))
    return e.withColumn("cv", ideal).withColumn("c1", F.lit(1)).withColumn("c2", F.lit(1)).withColumn("rtm", eye), points, boxes


def test_perfect_tube_has_no_line(spark):
    assert tracer.trace(*tube(spark, (0, 0, 0))).count() == 0


def test_tube_is_one_line_that_winds_through_the_cell(spark):
    e, points, boxes = tube(spark, (0.5, 0.5, 0.0))
    shifted = [df.withColumn("frame_id", F.col("frame_id") + 1) for df in (e, points, boxes)]
    rows = tracer.trace(*(x.unionByName(y) for x, y in zip((e, points, boxes), shifted))).collect()
    assert sorted(r["frame_id"] for r in rows) == [0, 1]
    for r in rows:
        assert np.allclose(np.abs([r["bx"], r["by"], r["bz"]]), (0.5, 0.5, 0.0)) and not any(n["is_dangling"] for n in r["nodes"])
        p = np.array([[q["x"], q["y"], q["z"]] for q in r["line"]])
        assert np.allclose(np.abs(p[-1] - p[0]), (0, 0, HIGH), atol=1e-6)
        assert (np.abs(p[:, :2] - 5) < 2.1).all() and len(r["core_size"]) == len(p)
        assert len({f["face"] for f in r["faces"]}) == len(r["faces"]) == 2 * N * LAYERS


def test_traced_lines_go_on_to_the_network(spark):
    seg = tracer.trace(*tube(spark, (0.5, 0.5, 0.0)))
    nodes = seg.select("frame_id", "segment_id", F.explode("nodes").alias("n")).select("frame_id", "segment_id", "n.*")
    kinds = network.line_kinds(seg, nodes)
    r = kinds.first()
    assert r["is_loop"] and r["is_infinite"]
    smooth = lines.smooth_lines(kinds.select("frame_id", "segment_id", "line", "core_size", "is_loop", "is_infinite"), 1.0, 20.0)
    assert abs(smooth.select(lines.line_length(F.col("line"))).first()[0] - HIGH) < 1e-6
    clusters = spark.createDataFrame([(0, 1, 1, "fcc", None)], "frame_id bigint, cluster_id int, structure int, topology_name string, orientation array<double>")
    moves = spark.createDataFrame([], "frame_id bigint, c1 int, c2 int, tm array<double>, distance int")
    done = network.finish_segments(seg, moves, clusters, "fcc")
    first, last = done.first()["line"][0], done.first()["line"][-1]
    assert last["z"] > first["z"]
    family = network.line_attributes(done, clusters).first()
    assert family["burgers_family_label"] == "1/2<110> (Perfect)" and family["crystal_structure"] == "fcc"


def test_edges_without_ideal_vectors_are_in_no_circuit(spark):
    e, points, boxes = tube(spark, (0.5, 0.5, 0.0))
    cut = e.withColumn("cv", F.when((F.col("v1") % N != 0) | (F.col("v2") % N != 1), F.col("cv")))
    assert tracer.trace(cut, points, boxes, 8, 2).count() == 0


def test_blocked_circuits(spark):
    e = tube(spark, (0, 0, 0))[0]
    ring = e.filter(f"v1 < {N} and v2 = (v1 + 1) % {N}").select("frame_id", F.lit(1).alias("circuit_id"), "face", "slot")
    back = e.filter(f"v2 < {N} and v1 = (v2 + 1) % {N}").select("frame_id", F.lit(2).alias("circuit_id"), "face", "slot")
    state, pairs = network.blocked_circuits(ring.unionByName(back), e)
    assert {r["is_blocked"] for r in state.collect()} == {True} and {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (2, 1)}
    assert not network.blocked_circuits(ring, e)[0].first()["is_blocked"]


def test_core_cells_are_claimed_by_the_first_fan(spark):
    p = lambda *v: dict(zip("xyz", map(float, v)))
    cells = spark.createDataFrame([(0, c, *range(4 * c, 4 * c + 4), *(p(x + 10 * c, y, z) for x, y, z in ((0, 0, 0), (2, 0, 0), (0, 2, 0), (0, 0, 2)))) for c in range(3)], "frame_id bigint, cell bigint, v0 int, v1 int, v2 int, v3 int, " + ", ".join(f"p{i} struct<x:double,y:double,z:double>" for i in range(4)))
    tri = [(0, 2, 7, p(-1, 0.5, 0.5), p(3, 0.5, 0.5), p(3, 0.6, 0.5)), (0, 1, 8, p(-1, 0.5, 0.5), p(13, 0.5, 0.5), p(13, 0.6, 0.5)), (0, 3, 9, p(20.2, 0.2, 0.2), p(20.3, 0.2, 0.2), p(20.2, 0.3, 0.2))]
    fans = spark.createDataFrame(tri, "frame_id bigint, fan int, segment_id int, " + ", ".join(f"q{i} struct<x:double,y:double,z:double>" for i in range(3)))
    claims = regions.claim_core_cells(fans, cells, 3.0)
    assert {(r["cell"], r["segment_id"]) for r in claims.collect()} == {(0, 8), (1, 8)}
