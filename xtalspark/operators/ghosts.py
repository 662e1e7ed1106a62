"""Points for a tessellation: wrapping, jitter, selection, ghost images, cover corners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cell as C
from ..functions import linalg as la

#: Jitter, as a share of |a + b + c| of the cell's edges.
JITTER = 1e-10


def primary_points(atoms: DataFrame, cells: DataFrame, selected: str | None = None, jitter: float = JITTER) -> DataFrame:
    """(frame_id, particle, ux, uy, uz, x, y, z): wrapped and jittered atoms.

    ux, uy, uz are the positions as given. selected names a flag column that
    leaves atoms out; the jitter keeps the original index.
    """
    rows = atoms if selected is None else atoms.filter(F.col(selected))
    joined = C.with_cell(rows, cells)
    cell = F.col("cell")
    wrapped = C.wrap_point(cell, (F.col("x"), F.col("y"), F.col("z")))
    eps = F.lit(jitter) * la.length(la.add(la.add(C.edge(cell, 0), C.edge(cell, 1)), C.edge(cell, 2)))
    moved = [w + (C.jitter(F.col("atom_idx"), k, 1.0) * eps) for k, w in enumerate(wrapped)] if jitter else wrapped
    return joined.select("frame_id", F.col("atom_idx").alias("particle"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"), *(m.alias(n) for m, n in zip(moved, "xyz")))


def _slabs(cells: DataFrame, ghost: float) -> DataFrame:
    """What the images of a frame's points need, as plain columns beside frame_id: edges e,
    face normals n, heights h, slab limits lo and hi, the most shifts c, periodic p."""
    cell, fields = F.col("cell"), []
    for d in range(3):
        n, e = C.normal(cell, d), C.edge(cell, d)
        low = la.dot(n, C.origin(cell))
        height = la.dot(n, e)
        count = F.when(C.periodic(cell, d), F.ceil(F.lit(ghost) / F.abs(height))).otherwise(F.lit(0)).cast("int")
        fields += [x.alias(f"e{d}{a}") for x, a in zip(e, "xyz")] + [x.alias(f"n{d}{a}") for x, a in zip(n, "xyz")]
        fields += [height.alias(f"h{d}"), (F.least(low, low + height) - ghost).alias(f"lo{d}"), (F.greatest(low, low + height) + ghost).alias(f"hi{d}"), count.alias(f"c{d}"), C.periodic(cell, d).alias(f"p{d}")]
    return cells.select("frame_id", *fields)


def ghost_images(points: DataFrame, cells: DataFrame, ghost: float) -> DataFrame:
    """Images of points (frame_id, particle, x, y, z) within ghost of the cell.

    A frame's slabs are worked out once; a point's shifts along an edge are filtered
    before they are exploded, so rows grow by the ghost layer's share of the volume only.
    """
    out = points.select("frame_id", "particle", "x", "y", "z").join(_slabs(cells, ghost), "frame_id")
    s = {c: F.col(c) for c in out.columns}
    for d, axis in enumerate("abc"):
        at = F.col("x") * s[f"n{d}x"] + F.col("y") * s[f"n{d}y"] + F.col("z") * s[f"n{d}z"]
        out = out.withColumn(f"__at{d}", at)

    def within(d: int):
        place = lambda k: F.col(f"__at{d}") + k * s[f"h{d}"]
        return lambda k: ~s[f"p{d}"] | ((place(k) >= s[f"lo{d}"]) & (place(k) <= s[f"hi{d}"]))

    for d, axis in enumerate("abc"):
        out = out.withColumn(f"__{axis}", F.explode(F.filter(F.sequence(-s[f"c{d}"], s[f"c{d}"]), within(d))))
    k = [F.col(f"__{axis}") for axis in "abc"]
    image = [F.col(a) + (k[0] * s[f"e0{a}"] + k[1] * s[f"e1{a}"] + k[2] * s[f"e2{a}"]) for a in "xyz"]
    out = out.filter((k[0] != 0) | (k[1] != 0) | (k[2] != 0))
    return out.select("frame_id", "particle", *(v.alias(n) for v, n in zip(image, "xyz")), *(x.alias(f"shift_{a}") for x, a in zip(k, "abc")))


def cover_corners(points: DataFrame) -> DataFrame:
    """Eight corners of each frame's bounding box, without a particle."""
    box = points.groupBy("frame_id").agg(*(f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)))
    corner = F.explode(F.array(*(F.struct(*(F.col(f"{'max' if k >> i & 1 else 'min'}_{a}").alias(a) for i, a in enumerate("xyz"))) for k in range(8)))).alias("p")
    return box.select("frame_id", corner).select("frame_id", F.lit(None).cast("bigint").alias("particle"), "p.x", "p.y", "p.z")


def tessellation_points(atoms: DataFrame, cells: DataFrame, ghost: float, cover: bool = False, selected: str | None = None) -> DataFrame:
    """Primary points, ghost images and, if asked for, cover corners: (frame_id,
    particle, x, y, z, is_ghost)."""
    primary = primary_points(atoms, cells, selected)
    out = primary.select("frame_id", "particle", "x", "y", "z", F.lit(False).alias("is_ghost"))
    images = ghost_images(primary, cells, ghost).select("frame_id", "particle", "x", "y", "z", F.lit(True).alias("is_ghost"))
    out = out.unionByName(images)
    return out.unionByName(cover_corners(out).withColumn("is_ghost", F.lit(True))) if cover else out
