"""Crystalline regions, structure counts and core atoms: grouped aggregations over atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import burgers as B
from ..functions import linalg as la
from . import mesh, tess


def structure_counts(atoms: DataFrame) -> DataFrame:
    """Per structure type: atoms and their share."""
    by = atoms.groupBy("frame_id", "structure_type").agg(F.count("*").alias("n_atoms"))
    total = by.groupBy("frame_id").agg(F.sum("n_atoms").alias("__all"))
    return by.join(total, "frame_id").select("frame_id", "structure_type", "n_atoms", (F.col("n_atoms") / F.greatest("__all", F.lit(1))).alias("fraction")).orderBy("frame_id", "structure_type")


def region_table(atoms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Per cluster other than 0: atoms, structure of the atom of the lowest index, name."""
    by = atoms.filter("cluster_id <> 0").groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n_atoms"), F.min_by("structure_type", "atom_idx").alias("structure_type"), F.min("atom_idx").alias("first_atom"))
    own = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    if clusters is None:
        return by.withColumn("name", own)
    names = clusters.select("frame_id", "cluster_id", "topology_name")
    return by.join(names, ["frame_id", "cluster_id"], "left").withColumn("name", own).withColumn("topology_name", B.topology_name(F.col("topology_name"), F.col("structure_type").cast("string")))


def region_totals(atoms: DataFrame) -> DataFrame:
    """Per frame: atoms, regions, assigned and unassigned atoms, the largest region."""
    by = atoms.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n"))
    real = F.when(F.col("cluster_id") != 0, F.col("n"))
    return by.groupBy("frame_id").agg(
        F.sum("n").alias("n_atoms"),
        F.count(real).alias("n_regions"),
        F.coalesce(F.sum(real), F.lit(0)).alias("n_assigned"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == 0, F.col("n"))), F.lit(0)).alias("n_unassigned"),
        F.coalesce(F.max(real), F.lit(0)).alias("largest"),
    )


def core_atom_ids(claims: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Segment of each atom: that of the last claiming cell in the order of cells.

    claims are (frame_id, cell, segment_id, v0..v3). With atoms, every atom is returned and
    those of no claimed cell have -1.
    """
    corner = claims.select("frame_id", "cell", "segment_id", F.explode(F.array("v0", "v1", "v2", "v3")).alias("atom_idx"))
    ids = corner.groupBy("frame_id", "atom_idx").agg(F.max_by("segment_id", "cell").alias("dislocation_id"))
    if atoms is None:
        return ids
    return atoms.join(ids, ["frame_id", "atom_idx"], "left").withColumn("dislocation_id", F.coalesce("dislocation_id", F.lit(-1).cast(dict(ids.dtypes)["dislocation_id"])))


def core_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms on a dislocation, with ids and positions filled in."""
    zero = F.lit(0.0)
    return atoms.filter("dislocation_id >= 0").select("frame_id", "atom_idx", F.coalesce("id", "atom_idx").alias("id"), *(F.coalesce(a, zero).alias(a) for a in "xyz"), "structure_type", "dislocation_id")


def count_marked(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("frame_id").agg(F.count_if(F.col("dislocation_id") >= 0).alias("n_core_atoms"))


def claim_core_cells(triangles: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(frame_id, cell, segment_id, v0..v3): cells claimed by the first circuit fan that
    overlaps one of their facets.

    triangles are (frame_id, fan, segment_id, q0, q1, q2), fan in the order of tracing;
    cells have corners v0..v3 at p0..p3. Boxes that meet come from a grid join of the
    given size; only those pairs are tested exactly.
    """
    t = triangles
    for a in "xyz":
        at = [F.col(f"q{i}")[a] for i in range(3)]
        t = t.withColumn(f"lo_{a}", F.least(*at)).withColumn(f"hi_{a}", F.greatest(*at))
    t = t.withColumn("triangle", F.struct("fan", "segment_id", "q0", "q1", "q2"))
    near = tess.box_overlaps(tess.bounding_boxes(cells), t, size, "cell", "triangle")
    j = near.join(cells.select("frame_id", "cell", *(f"{k}{i}" for k in "vp" for i in range(4))), ["frame_id", "cell"])
    flat = lambda points: F.array(*(x for p in points for x in la.xyz(p)))
    hit = j.filter(mesh.triangle_meets_cell(flat([F.col(f"p{i}") for i in range(4)]), flat([F.col("triangle")[f"q{i}"] for i in range(3)])))
    first = hit.groupBy("frame_id", "cell").agg(F.min_by(F.col("triangle")["segment_id"], F.struct(F.col("triangle")["fan"].alias("f"), F.col("triangle")["segment_id"].alias("s"))).alias("segment_id"))
    return first.join(cells.select("frame_id", "cell", *(f"v{i}" for i in range(4))), ["frame_id", "cell"])


def circuit_triangles(segments: DataFrame) -> DataFrame:
    """Triangles (frame_id, fan, stored, dangling, segment_id, q0, q1, q2) of the fans of traced segments."""
    f = segments.select("frame_id", "segment_id", F.explode("fans").alias("f")).select("frame_id", "segment_id", "f.*")
    at = lambda i: F.get("ring", i)
    sides = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda i: F.struct(at(i).alias("p"), at((i + 1) % F.size("ring")).alias("q")))
    t = f.select("frame_id", "fan", "stored", "dangling", "segment_id", "centre", F.explode(sides).alias("s"))
    corner = lambda c: F.struct(*(F.get(c, F.lit(i)).alias(a) for i, a in enumerate("xyz")))
    return t.select("frame_id", "fan", "stored", "dangling", "segment_id", corner(F.col("s.p")).alias("q0"), corner(F.col("s.q")).alias("q1"), corner(F.col("centre")).alias("q2"))


def core_claims(segments: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Cells claimed by traced segments; a claim made after its dangling end was capped is void."""
    t = circuit_triangles(segments)
    claims = claim_core_cells(t.withColumn("segment_id", F.struct("segment_id", (F.col("stored") & F.col("dangling")).alias("void"))), cells, size)
    return claims.filter("not segment_id.void").withColumn("segment_id", F.col("segment_id.segment_id"))
