"""Meshes as tables: faces (frame_id, face, a, b, c), half-edges, watertightness, export points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cell as C
from ..functions import linalg as la
from . import tess
from .elastic import cut_lineage, lookup_edges
from .indexing import dense_index
from .tess import FACETS, rotated

UNWRAP_EPSILON = 1e-6


def half_edges(faces: DataFrame, *keep: str) -> DataFrame:
    """(frame_id, face, slot, v1, v2): the three directed sides of each face."""
    rows = F.posexplode(F.array(*(F.struct(F.col(x).alias("v1"), F.col(y).alias("v2")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("slot", "e")
    return faces.select("frame_id", "face", *keep, rows).select("frame_id", "face", "slot", "e.v1", "e.v2", *keep)


def link_opposites(edges: DataFrame) -> DataFrame:
    """Append opp_face, opp_slot: the n-th half-edge v1 -> v2 meets the n-th v2 -> v1 in
    the order of (face, slot); those left over have nulls."""
    nth = F.row_number().over(Window.partitionBy("frame_id", "v1", "v2").orderBy("face", "slot"))
    own = edges.withColumn("__n", nth)
    other = own.select("frame_id", F.col("v1").alias("v2"), F.col("v2").alias("v1"), "__n", F.col("face").alias("opp_face"), F.col("slot").alias("opp_slot"))
    return own.join(other, ["frame_id", "v1", "v2", "__n"], "left").select(*edges.columns, "opp_face", "opp_slot")


def link_around_edges(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """Half-edges of faces with opp_face, opp_slot: the face reached by turning around the
    edge through the cells of the face's own region.

    faces are (frame_id, face, a, b, c, cell, facet); cells (frame_id, cell, v0..v3, a0..a3, region)
    have the corners of the tessellation and their atoms. At each edge a cell has two facets;
    one enters by one and leaves by the other, into the next cell if that is of the same
    region, else that facet is the answer. Answers spread by pointer doubling. A facet of a
    cell outside the mesh (an image) stands for the face of the same atoms.
    """
    solid = tess.neighbors_of(cells, "region").filter("region <> 0")
    doors = solid.select("frame_id", "cell", F.col("face").alias("out"), (F.col("other_cell").isNotNull() & (F.col("other_region") == F.col("region"))).alias("inner"), (F.col("other_cell") * 4 + F.col("other_face")).alias("next"))
    turns = []
    for f, (x, y, z) in enumerate(FACETS):
        for slot, (i, j, k) in enumerate(((x, y, z), (y, z, x), (z, x, y))):
            turns.append(F.struct(F.lit(f).alias("facet"), F.lit(slot).alias("slot"), F.lit(k).alias("out"), F.least(f"v{i}", f"v{j}").alias("p"), F.greatest(f"v{i}", f"v{j}").alias("q")))
    darts = cells.filter("region <> 0").select("frame_id", "cell", F.explode(F.array(*turns)).alias("t")).select("frame_id", "cell", "t.*")
    own = faces.select("frame_id", "cell", "facet", "face")
    starts = cut_lineage(darts.join(own, ["frame_id", "cell", "facet"]).select("frame_id", "p", "q", "face", "slot", (F.col("cell") * 4 + F.col("facet")).alias("at")))
    around = darts.join(starts.select("frame_id", "p", "q").distinct(), ["frame_id", "p", "q"], "left_semi").join(doors, ["frame_id", "cell", "out"])
    here = F.col("cell") * 4
    walk = cut_lineage(around.select("frame_id", "p", "q", (here + F.col("facet")).alias("at"), F.when(F.col("inner"), F.col("next")).alias("next"), F.when(~F.col("inner"), here + F.col("out")).alias("end")))
    for _ in range(10):  # up to 1024 cells around an edge
        if walk.filter("end is null and next is not null").isEmpty():
            break
        far = walk.select("frame_id", "p", "q", F.col("at").alias("next"), F.col("next").alias("__next"), F.col("end").alias("__end"))
        walk = walk.join(far, ["frame_id", "p", "q", "next"], "left")
        walk = cut_lineage(walk.select("frame_id", "p", "q", "at", F.when(F.col("end").isNull(), F.col("__next")).alias("next"), F.coalesce("end", "__end").alias("end")))
    ends = starts.join(walk.select("frame_id", "p", "q", "at", "end"), ["frame_id", "p", "q", "at"], "left").withColumn("__cell", F.floor(F.col("end") / 4)).withColumn("__facet", (F.col("end") % 4).cast("int"))
    direct = own.select("frame_id", F.col("cell").alias("__cell"), F.col("facet").alias("__facet"), F.col("face").alias("__direct"))
    # Corners of facets as atoms, to name the face that an image stands for.
    named = cells.filter("region <> 0").select("frame_id", "cell", *(F.col(f"a{i}").alias(f"v{i}") for i in range(4)))
    image = canonical_faces(tess.facets(named).select("frame_id", F.col("cell").alias("__cell"), F.col("face").alias("__facet"), "a", "b", "c"))
    by_atoms = canonical_faces(faces.select("frame_id", "face", "a", "b", "c")).groupBy("frame_id", "a", "b", "c").agg(F.min("face").alias("__image"))
    found = ends.join(direct, ["frame_id", "__cell", "__facet"], "left").join(image, ["frame_id", "__cell", "__facet"], "left").join(by_atoms, ["frame_id", "a", "b", "c"], "left")
    across = found.select("frame_id", "face", "slot", F.coalesce("__direct", "__image").alias("opp_face"))
    half = half_edges(faces)
    back = half.select("frame_id", F.col("face").alias("opp_face"), F.col("slot").alias("opp_slot"), F.col("v1").alias("v2"), F.col("v2").alias("v1"))
    linked = half.join(across, ["frame_id", "face", "slot"], "left").join(back, ["frame_id", "opp_face", "v1", "v2"], "left")
    return linked.select(*half.columns, F.when(F.col("opp_slot").isNotNull(), F.col("opp_face")).alias("opp_face"), "opp_slot")


def watertight(linked: DataFrame) -> DataFrame:
    return linked.groupBy("frame_id").agg(F.bool_and(F.col("opp_face").isNotNull()).alias("is_closed"), F.count_if(F.col("opp_face").isNull()).alias("n_open"))


def canonical_faces(faces: DataFrame) -> DataFrame:
    """Faces with their smallest corner first, the sense of turning kept."""
    r = rotated(F.col("a"), F.col("b"), F.col("c"))
    return faces.select(*(c for c in faces.columns if c not in "abc"), *(x.alias(n) for x, n in zip(r, "abc")))


def mesh_from_interface(facets: DataFrame) -> DataFrame:
    """(frame_id, face, a, b, c, cell, facet): interface facets numbered in the order of (cell, facet)."""
    rows = facets.select("frame_id", F.floor(F.col("cell") / 4096).alias("__part"), "cell", F.col("face").alias("facet"), "a", "b", "c")
    numbered = dense_index(rows, ["frame_id"], "__part", ["cell", "facet"], "face")
    return numbered.select("frame_id", F.col("face").cast("int").alias("face"), "a", "b", "c", "cell", "facet")


def edge_vectors(edges: DataFrame, points: DataFrame, boxes: DataFrame, records: DataFrame) -> DataFrame:
    """Append to half-edges the physical minimum-image vector (px, py, pz) and the
    ideal vector and transition of the tessellation edge in that direction."""
    ends = [points.select("frame_id", F.col("atom_idx").alias(f"v{i}"), F.struct("x", "y", "z").alias(f"__p{i}")) for i in (1, 2)]
    j = C.with_cell(edges.join(ends[0], ["frame_id", "v1"]).join(ends[1], ["frame_id", "v2"]), boxes)
    d = C.wrap_vector(F.col("cell"), la.sub(la.xyz("__p2"), la.xyz("__p1")))
    j = j.select(*edges.columns, *(x.alias(f"p{a}") for x, a in zip(d, "xyz")))
    looked = lookup_edges(j.withColumnRenamed("v1", "a").withColumnRenamed("v2", "b"), records)
    return looked.withColumnRenamed("a", "v1").withColumnRenamed("b", "v2")


def vertex_fans(linked: DataFrame) -> DataFrame:
    """(frame_id, v, face, slot, fan): half-edges leaving a vertex by fan, where
    the next of the opposite edge is in the same fan. A fan is named by its smallest (face, slot).

    Fans are small (the faces around a vertex); names spread round by round
    until none changes, each round one join on the half-edge.
    """
    name = F.col("face").cast("bigint") * 3 + F.col("slot")
    nxt = F.when(F.col("opp_face").isNotNull(), F.col("opp_face").cast("bigint") * 3 + (F.col("opp_slot") + 1) % 3)
    e = cut_lineage(linked.select("frame_id", F.col("v1").alias("v"), "face", "slot", name.alias("he"), nxt.alias("nxt")))
    links = e.filter("nxt is not null").select("frame_id", "he", F.col("nxt").alias("to"))
    links = cut_lineage(links.union(links.select("frame_id", F.col("to").alias("he"), F.col("he").alias("to"))).distinct())
    fan = e.select("frame_id", "he", F.col("he").alias("fan"))
    while True:
        near = links.join(fan.withColumnRenamed("he", "to"), ["frame_id", "to"]).groupBy("frame_id", "he").agg(F.min("fan").alias("near"))
        step = cut_lineage(fan.join(near, ["frame_id", "he"], "left").select("frame_id", "he", F.least("fan", F.coalesce("near", "fan")).alias("mid"), F.col("fan").alias("old")))
        over = step.select("frame_id", F.col("he").alias("mid"), F.col("mid").alias("over"))
        new = cut_lineage(step.join(over, ["frame_id", "mid"], "left").select("frame_id", "he", F.least("mid", F.coalesce("over", "mid")).alias("fan"), "old"))
        fan = new.select("frame_id", "he", "fan")
        if new.filter("fan <> old").isEmpty():
            return e.join(fan, ["frame_id", "he"]).select("frame_id", "v", "face", "slot", "fan")


def manifold_counts(linked: DataFrame) -> DataFrame:
    """(frame_id, v, n_manifolds): edge fans around each vertex."""
    return vertex_fans(linked).groupBy("frame_id", "v").agg(F.countDistinct("fan").alias("n_manifolds"))


def make_manifold(faces: DataFrame, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces whose vertices have one fan each, and (frame_id, v, of): the vertices,
    new ones with the vertex they were split from.

    The fan of the smallest name keeps the vertex; a vertex of less than three
    edges is not split. New vertices follow the largest old one.
    """
    fans = vertex_fans(linked)
    size = fans.groupBy("frame_id", "v").agg(F.count("*").alias("n"), F.min("fan").alias("own"))
    split = fans.join(size, ["frame_id", "v"]).filter("n >= 3 and fan <> own").select("frame_id", "v", "fan").distinct()
    top = faces.select("frame_id", F.greatest("a", "b", "c").alias("m")).groupBy("frame_id").agg(F.max("m").alias("top"))
    number = dense_index(split.withColumn("__part", F.floor(F.col("v") / 4096)), ["frame_id"], "__part", ["v", "fan"], "number")
    named = number.join(top, "frame_id").select("frame_id", "v", "fan", (F.col("top") + 1 + F.col("number")).cast("int").alias("new"))
    moved = fans.join(named, ["frame_id", "v", "fan"], "left").select("frame_id", "face", "slot", F.coalesce("new", "v").alias("w"), "v")
    corner = moved.groupBy("frame_id", "face").agg(*(F.max(F.when(F.col("slot") == i, F.col("w"))).alias(n) for i, n in enumerate("abc")))
    rest = [c for c in faces.columns if c not in ("a", "b", "c")]
    new_faces = faces.select(*rest).join(corner, ["frame_id", "face"])
    vertices = moved.select("frame_id", F.col("w").alias("v"), F.col("v").alias("of")).distinct()
    return new_faces, vertices


def defect_mesh(faces: DataFrame, caps: DataFrame) -> DataFrame:
    """Faces of the defect mesh: faces (.., circuit_id, flag, circuit_dangling) without those
    that a traced line swept, and a fan of triangles over each cap (frame_id, apex, v1, v2)."""
    gone = F.col("circuit_id").isNotNull() & ((F.col("flag").bitwiseAND(F.lit(1)) != 0) | ~F.coalesce("circuit_dangling", F.lit(False)))
    kept = faces.filter(~gone).select("frame_id", "face", "a", "b", "c")
    top = faces.groupBy("frame_id").agg(F.max("face").alias("top"))
    number = dense_index(caps.withColumn("__part", F.floor(F.col("apex") / 4096)), ["frame_id"], "__part", ["apex", "v1", "v2"], "number")
    new = (F.coalesce("top", F.lit(-1)) + 1 + F.col("number")).cast("int")
    fan = number.join(top, "frame_id", "left").select("frame_id", new.alias("face"), F.col("v2").alias("a"), F.col("v1").alias("b"), F.col("apex").alias("c"))
    return kept.unionByName(fan)


def unwrap_faces(faces: DataFrame, points: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export points (frame_id, point, x, y, z, of) and facets (frame_id, face, a, b, c).

    Corners of a face are unwrapped against its first; a corner that moves becomes a
    new point, numbered after the vertices in the order of (face, corner).
    """
    corner = faces.select("frame_id", "face", F.posexplode(F.array("a", "b", "c")).alias("slot", "v")).join(points.select("frame_id", F.col("v"), "x", "y", "z"), ["frame_id", "v"])
    first = corner.filter("slot = 0").select("frame_id", "face", *(F.col(a).alias(f"f{a}") for a in "xyz"))
    j = C.with_cell(corner.join(first, ["frame_id", "face"]), boxes)
    d = C.wrap_vector(F.col("cell"), tuple(F.col(a) - F.col(f"f{a}") for a in "xyz"))
    at = tuple(F.col(f"f{a}") + x for a, x in zip("xyz", d))
    moved = ~la.is_zero(tuple(x - F.col(a) for x, a in zip(at, "xyz")), UNWRAP_EPSILON)
    j = j.select("frame_id", "face", "slot", "v", moved.alias("moved"), *(F.when(moved, x).otherwise(F.col(a)).alias(a) for x, a in zip(at, "xyz")))
    top = points.groupBy("frame_id").agg(F.max("v").alias("top"))
    number = dense_index(j.filter("moved").withColumn("__part", F.floor(F.col("face") / 4096)), ["frame_id"], "__part", ["face", "slot"], "number")
    new = number.join(top, "frame_id").select("frame_id", "face", "slot", (F.col("top") + 1 + F.col("number")).cast("int").alias("point"), "x", "y", "z", F.col("v").alias("of"))
    all_points = points.select("frame_id", F.col("v").alias("point"), "x", "y", "z", F.col("v").alias("of")).unionByName(new.select("frame_id", "point", "x", "y", "z", "of"))
    named = j.join(new.select("frame_id", "face", "slot", "point"), ["frame_id", "face", "slot"], "left").withColumn("point", F.coalesce("point", "v"))
    facets = named.groupBy("frame_id", "face").agg(*(F.max(F.when(F.col("slot") == i, F.col("point"))).alias(n) for i, n in enumerate("abc")))
    return all_points, facets


def smooth_mesh(vertices: DataFrame, faces: DataFrame, rounds: int, lam: float = 0.5, mu: float = -0.52) -> DataFrame:
    """(frame_id, v, x, y, z) after rounds of two neighbour-average passes."""
    e = half_edges(faces).select("frame_id", "v1", "v2")
    near = cut_lineage(e.union(e.select("frame_id", F.col("v2").alias("v1"), F.col("v1").alias("v2"))).distinct())
    now = vertices
    for _ in range(rounds):
        for w in (lam, mu):
            other = now.select("frame_id", F.col("v").alias("v2"), *(F.col(a).alias(f"n{a}") for a in "xyz"))
            mean = near.join(other, ["frame_id", "v2"]).groupBy("frame_id", F.col("v1").alias("v")).agg(*(F.avg(f"n{a}").alias(f"m{a}") for a in "xyz"))
            now = cut_lineage(now.join(mean, ["frame_id", "v"], "left").select("frame_id", "v", *((F.col(a) + w * (F.coalesce(f"m{a}", a) - F.col(a))).alias(a) for a in "xyz")))
    return now


def triangles_meet(p: np.ndarray, q: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Whether pairs of triangles (n, 3 corners, 3) overlap: no axis among their normals,
    edge cross products and in-plane edge normals parts them."""
    ep, eq = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    n, m = np.cross(ep[:, 0], ep[:, 1]), np.cross(eq[:, 0], eq[:, 1])
    axes = [n, m, *(np.cross(ep[:, i], eq[:, j]) for i in range(3) for j in range(3)), *(np.cross(n, ep[:, i]) for i in range(3)), *(np.cross(m, eq[:, i]) for i in range(3))]
    parted = np.zeros(len(p), bool)
    for axis in axes:
        a, b = np.einsum("nk,nck->nc", axis, p), np.einsum("nk,nck->nc", axis, q)
        live = (axis * axis).sum(axis=1) > eps
        parted |= live & ((a.max(axis=1) < b.min(axis=1)) | (b.max(axis=1) < a.min(axis=1)))
    return ~parted


@F.pandas_udf(T.BooleanType())
def triangle_meets_cell(corners: pd.Series, triangle: pd.Series) -> pd.Series:
    """Whether a triangle (nine numbers) overlaps a facet of a cell (twelve numbers)."""
    t = np.array(triangle.tolist(), float).reshape(-1, 3, 3)
    c = np.array(corners.tolist(), float).reshape(-1, 4, 3)
    hit = np.zeros(len(t), bool)
    for f in FACETS:
        hit |= triangles_meet(c[:, list(f)], t)
    return pd.Series(hit)
