"""Tessellation cells, facets and edges as tables (frame_id, cell, v0, v1, v2, v3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cell as C
from ..functions import linalg as la
from ..functions.linalg import Vec
from .indexing import dense_index

# Local corners of the facet opposite each corner; in a positively oriented cell they turn
# counterclockwise as that corner sees them.
FACETS = ((1, 3, 2), (0, 2, 3), (0, 3, 1), (0, 1, 2))
# Local corners of the six edges.
EDGES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
CORE_ALPHA_SCALE = 3.5
DEGENERATE = 1e-9


def unpack_cells(cells: DataFrame) -> DataFrame:
    """(.., vh, adj, ..) with corners v0..v3 as columns of their own."""
    return cells.select(*(c for c in cells.columns if c != "vh"), *(F.get("vh", F.lit(i)).alias(f"v{i}") for i in range(4)))


def corner_positions(cells: DataFrame, vertices: DataFrame, key: str = "vh") -> DataFrame:
    """Append p0..p3, structs of each corner's position (and particle, is_ghost if there).

    One join: corners are exploded, looked up and grouped back by cell.
    """
    extra = [c for c in ("particle", "is_ghost") if c in vertices.columns]
    at = vertices.select("frame_id", F.col(key).alias("__v"), F.struct("x", "y", "z", *extra).alias("__p"))
    corners = cells.select("frame_id", "cell", F.posexplode(F.array("v0", "v1", "v2", "v3")).alias("__i", "__v"))
    looked = corners.join(at, ["frame_id", "__v"], "left")
    back = looked.groupBy("frame_id", "cell").agg(*(F.max(F.when(F.col("__i") == i, F.col("__p"))).alias(f"p{i}") for i in range(4)))
    return cells.join(back, ["frame_id", "cell"])


def edge_rows(cells: DataFrame) -> DataFrame:
    """The six edges (frame_id, v1 < v2) of each cell that is not a ghost; those that cells share repeat."""
    real = cells.filter(~F.col("is_ghost")) if "is_ghost" in cells.columns else cells
    ends = F.explode(F.array(*(F.struct(F.least(f"v{a}", f"v{b}").alias("v1"), F.greatest(f"v{a}", f"v{b}").alias("v2")) for a, b in EDGES))).alias("e")
    return real.select("frame_id", ends).select("frame_id", "e.v1", "e.v2").filter("v1 <> v2")


def tessellation_edges(cells: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Distinct undirected edges (frame_id, v1 < v2) of cells that are not ghosts.

    With prepared cells of the frames, edges longer than half the box on a periodic
    dimension go, measured between the corners p0..p3: an image stands where it is.
    """
    if boxes is None:
        return edge_rows(cells).distinct()
    real = cells.filter(~F.col("is_ghost")) if "is_ghost" in cells.columns else cells
    ends = lambda a, b: (F.least(f"v{a}", f"v{b}").alias("v1"), F.greatest(f"v{a}", f"v{b}").alias("v2"))
    step = lambda a, b: [x.alias(n) for x, n in zip(la.sub(la.xyz(f"p{b}"), la.xyz(f"p{a}")), "xyz")]
    rows = F.explode(F.array(*(F.struct(*ends(a, b), *step(a, b)) for a, b in EDGES))).alias("e")
    joined = C.with_cell(real.select("frame_id", rows).select("frame_id", "e.*").filter("v1 <> v2"), boxes)
    return joined.filter(~C.is_wrapped(F.col("cell"), (F.col("x"), F.col("y"), F.col("z")))).select("frame_id", "v1", "v2").distinct()


def ghost_cell(particles: list[Column], ghosts: list[Column]) -> Column:
    """A cell is a ghost if its corner of the smallest particle index is one; a
    corner without a particle makes it one as well."""
    corner = lambda p, g, i: F.struct(F.coalesce(p.cast("bigint"), F.lit(-1).cast("bigint")).alias("p"), F.lit(i).alias("i"), (F.coalesce(g, F.lit(True)) | p.isNull()).alias("g"))
    return F.array_min(F.array(*(corner(p, g, i) for i, (p, g) in enumerate(zip(particles, ghosts)))))["g"]


def _square(x: Column) -> Column:
    return la.let(x, lambda v: v * v)


def _radius(sides: list[Vec], squares: Vec) -> tuple[Column, Column]:
    """Numerator and denominator of the squared circumradius of a tetrahedron, from the three
    edges that leave a corner and their squared lengths."""
    q, r, s = sides
    q2, r2, s2 = squares
    part = lambda i, j: _square(la.det3((q[i], q[j], q2), (r[i], r[j], r2), (s[i], s[j], s2)))
    return part(1, 2) + part(0, 2) + part(0, 1), 4.0 * _square(la.det3(q, r, s))


def squared_radius(p: list[Vec]) -> tuple[Column, Column]:
    """Numerator and denominator of the squared circumradius of a tetrahedron."""
    sides = [la.sub(x, p[0]) for x in p[1:]]
    return _radius(sides, tuple(la.dot(x, x) for x in sides))


def alpha_test(p: list[Vec], alpha) -> Column:
    """Squared circumradius < alpha; null if the tetrahedron is degenerate.

    Differences and their squares, then the two determinants' squares, are bound as
    variables: written out, the expression would be too large to compile.
    """
    q, r, s = (la.sub(x, p[0]) for x in p[1:])
    sides = F.struct(*(x.alias(f"{n}{a}") for n, v in zip("qrs", (q, r, s)) for x, a in zip(v, "xyz")))

    def from_sides(d: Column) -> Column:
        v = [tuple(d[f"{n}{a}"] for a in "xyz") for n in "qrs"]
        return la.let(F.array(*(la.dot(x, x) for x in v)), lambda w: la.let(la.packed(_radius(v, la.vec(w))), tell))

    def tell(f: Column) -> Column:
        num, den = F.get(f, F.lit(0)), F.get(f, F.lit(1))
        flat = (F.abs(num) < DEGENERATE) & (F.abs(den) < DEGENERATE)
        return F.when(flat, F.lit(None).cast("boolean")).when(den == 0.0, F.lit(False)).otherwise(num / F.nullif(den, F.lit(0.0)) < alpha)

    return la.let(sides, from_sides)


def facets(cells: DataFrame, *keep: str) -> DataFrame:
    """(frame_id, cell, face, a, b, c, lo, mid, hi, keep...): four facets of each
    cell, corners in the order of FACETS and sorted."""
    rows = []
    for f, corners in enumerate(FACETS):
        a, b, c = (F.col(f"v{i}") for i in corners)
        lo, hi = F.least(a, b, c), F.greatest(a, b, c)
        rows.append(F.struct(F.lit(f).alias("face"), a.alias("a"), b.alias("b"), c.alias("c"), lo.alias("lo"), (a + b + c - lo - hi).alias("mid"), hi.alias("hi")))
    return cells.select("frame_id", "cell", *keep, F.explode(F.array(*rows)).alias("f")).select("frame_id", "cell", "f.*", *keep)


def rotated(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The triple turned so that its smallest entry leads; the sense of turning stays."""
    lo = F.least(a, b, c)
    pick = lambda x, y, z: F.when(a == lo, x).when(b == lo, y).otherwise(z)
    return pick(a, b, c), pick(b, c, a), pick(c, a, b)


def neighbors_of(cells: DataFrame, *keep: str) -> DataFrame:
    """Facets with the cell across: facet columns, other_cell, other_face and
    other_<keep>; outer facets have nulls. Facets are matched by sorted corners."""
    own = facets(cells, *keep)
    other = own.select("frame_id", "lo", "mid", "hi", F.col("cell").alias("other_cell"), F.col("face").alias("other_face"), *(F.col(k).alias(f"other_{k}") for k in keep))
    on = [own[k] == other[k] for k in ("frame_id", "lo", "mid", "hi")] + [own["cell"] != other["other_cell"]]
    return own.join(other, on, "left").select(own["*"], *(c for c in other.columns if c.startswith("other_")))


def filled_cells(cells: DataFrame) -> DataFrame:
    """(frame_id, cell, is_filled) of cells with columns is_finite and alpha_ok.

    Finite, and the alpha test holds, or cannot tell while all four neighbours
    are finite and none fails it.
    """
    near = neighbors_of(cells, "is_finite", "alpha_ok")
    around = near.groupBy("frame_id", "cell").agg(
        F.bool_and(F.coalesce("other_is_finite", F.lit(False))).alias("all_finite"),
        F.bool_or(F.coalesce(~F.col("other_alpha_ok"), F.lit(False))).alias("any_fails"),
        F.first("is_finite").alias("fin"),
        F.first("alpha_ok").alias("ok"),
    )
    filled = F.col("fin") & (F.coalesce("ok", F.lit(False)) | (F.col("ok").isNull() & F.col("all_finite") & ~F.col("any_fails")))
    return around.select("frame_id", "cell", filled.alias("is_filled"))


def interface_facets(cells: DataFrame) -> DataFrame:
    """Facets of solid cells (region <> 0) whose neighbour's region differs."""
    rows = neighbors_of(cells, "region", *(["is_ghost"] if "is_ghost" in cells.columns else []))
    solid = rows.filter((F.col("region") != 0) & F.col("other_cell").isNotNull() & (F.col("region") != F.col("other_region")))
    if "is_ghost" in cells.columns:
        solid = solid.filter(~F.col("is_ghost"))
    return solid.select("frame_id", "cell", "face", "a", "b", "c", "region", "other_cell", "other_region")


def distinct_facets(cells: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Distinct facets by sorted corners; is_boundary as the first cell sees it."""
    rows = near if near is not None else neighbors_of(cells)
    seen = F.min(F.struct("cell", "face", F.col("other_cell").isNull().alias("is_boundary"))).alias("s")
    return rows.groupBy("frame_id", "lo", "mid", "hi").agg(seen).select("frame_id", "lo", "mid", "hi", F.col("s.cell").alias("first_cell"), F.col("s.is_boundary").alias("is_boundary"))


def facet_counters(cells: DataFrame) -> DataFrame:
    """Per frame: cells, facets, boundary and internal facets, vertices."""
    f = distinct_facets(cells)
    by_frame = f.groupBy("frame_id").agg(F.count("*").alias("n_facets"), F.count_if("is_boundary").alias("n_boundary"), F.count_if(~F.col("is_boundary")).alias("n_internal"))
    nodes = f.select("frame_id", F.explode(F.array("lo", "mid", "hi")).alias("v")).distinct().groupBy("frame_id").agg(F.count("*").alias("n_nodes"))
    n = cells.groupBy("frame_id").agg(F.count("*").alias("n_cells"))
    return n.join(by_frame, "frame_id").join(nodes, "frame_id")


def euler_characteristic(faces: DataFrame) -> DataFrame:
    """Per frame V - E + F of a mesh of faces (frame_id, a, b, c)."""
    sides = F.explode(F.array(*(F.struct(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("e")
    n_edges = faces.select("frame_id", sides).select("frame_id", "e.*").distinct().groupBy("frame_id").agg(F.count("*").alias("n_edges"))
    n_vertices = faces.select("frame_id", F.explode(F.array("a", "b", "c")).alias("v")).distinct().groupBy("frame_id").agg(F.count("*").alias("n_vertices"))
    n_faces = faces.groupBy("frame_id").agg(F.count("*").alias("n_faces"))
    return n_faces.join(n_edges, "frame_id").join(n_vertices, "frame_id").withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def space_filling_region(cells: DataFrame) -> DataFrame:
    """Per frame the region that all real cells share, -1 if there are several, 0 if no cells."""
    real = F.when(~F.col("is_ghost"), F.col("region"))
    low, high = F.min(real), F.max(real)
    return cells.groupBy("frame_id").agg(F.when(low.isNull(), 0).when(low == high, low).otherwise(-1).cast("int").alias("space_filling_region"))


def mesh_flags(cells: DataFrame) -> DataFrame:
    """Per frame: no filled cell is incompatible (good), none is compatible (bad)."""
    filled = F.when(F.col("is_filled"), F.col("compatible"))
    return cells.groupBy("frame_id").agg(F.coalesce(F.bool_and(filled), F.lit(True)).alias("completely_good"), F.coalesce(F.bool_and(~filled), F.lit(True)).alias("completely_bad"))


def bounding_boxes(cells: DataFrame) -> DataFrame:
    """Append lo_x .. hi_z of the corners p0..p3."""
    out = cells
    for a in "xyz":
        at = [F.col(f"p{i}")[a] for i in range(4)]
        out = out.withColumn(f"lo_{a}", F.least(*at)).withColumn(f"hi_{a}", F.greatest(*at))
    return out


def box_overlaps(left: DataFrame, right: DataFrame, size: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of closed boxes (lo_x .. hi_z) that meet, within a frame.

    Boxes are put into the cells of a grid of the given size and joined on the
    cell; a pair is kept only in the first grid cell the two share, so nothing
    has to be made distinct.
    """

    def gridded(df: DataFrame, name: str, side: str) -> DataFrame:
        spans = {a: F.sequence(F.floor(F.col(f"lo_{a}") / size), F.floor(F.col(f"hi_{a}") / size)) for a in "xyz"}
        out = df.select("frame_id", F.col(name).alias(f"{side}_id"), *(F.col(f"{e}_{a}").alias(f"{side}_{e}_{a}") for e in ("lo", "hi") for a in "xyz"), *(s.alias(f"__s{a}") for a, s in spans.items()))
        for a in "xyz":
            out = out.withColumn(f"g{a}", F.explode(f"__s{a}")).drop(f"__s{a}")
        return out

    a, b = gridded(left, left_id, "l"), gridded(right, right_id, "r")
    pairs = a.join(b, ["frame_id", "gx", "gy", "gz"])
    meets = la.all_true((F.col(f"l_lo_{x}") <= F.col(f"r_hi_{x}")) & (F.col(f"r_lo_{x}") <= F.col(f"l_hi_{x}")) for x in "xyz")
    once = la.all_true(F.col(f"g{x}") == F.floor(F.greatest(F.col(f"l_lo_{x}"), F.col(f"r_lo_{x}")) / size) for x in "xyz")
    return pairs.filter(meets & once).select("frame_id", F.col("l_id").alias(left_id), F.col("r_id").alias(right_id))


def defect_cells(region: Column, finite: Column, corners: list[Vec], distance) -> Column:
    """Whether a cell is of a defect: finite, in no crystal, and small for the neighbour distance."""
    return finite & (region == 0) & F.coalesce(alpha_test(corners, CORE_ALPHA_SCALE * distance), F.lit(False))


def defect_slots(cells: DataFrame, condition: Column, bucket: str = "v0") -> DataFrame:
    """Append slot: dense index of cells that meet the condition, -1 for others."""
    hit = dense_index(cells.filter(condition), ["frame_id"], bucket, ["cell"], "slot").select("frame_id", "cell", "slot")
    return cells.join(hit, ["frame_id", "cell"], "left").withColumn("slot", F.coalesce("slot", F.lit(-1)).cast("bigint"))
