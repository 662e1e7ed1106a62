"""Tables of an analysis from Parquet, with their schemas, and the joined structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = "frame_id bigint, atom_idx int, id int, x double, y double, z double, structure_type int, cluster_id int"
CELL = "frame_id bigint, matrix array<array<double>>, origin array<double>, pbc array<boolean>"
CLUSTERS = "frame_id bigint, cluster_id int, structure int, topology_name string, orientation array<double>"
TRANSITIONS = "frame_id bigint, c1 int, c2 int, tm array<double>, distance int"
NEIGHBORS = "frame_id bigint, atom_idx int, slot int, nbr_idx int, lv array<double>"
CELLS = "frame_id bigint, cell bigint, vh array<int>, adj array<bigint>, is_finite boolean, is_ghost boolean"
SEGMENTS = "frame_id bigint, segment_id int, line array<struct<x:double,y:double,z:double>>, core_size array<int>, bx double, by double, bz double, cluster_id int"
NODES = "frame_id bigint, segment_id int, side string, ring_id bigint, edge_count int, is_dangling boolean, is_blocked boolean"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with the given columns; a missing path is an error."""
    if not path:
        raise ValueError("a path is required")
    return spark.read.schema(schema).parquet(path)


def neighbor_rows(lists: DataFrame) -> DataFrame:
    """Long rows of (frame_id, atom_idx, neighbors array<struct<nbr_idx, lv>>), slots in order."""
    return lists.select("frame_id", "atom_idx", F.posexplode("neighbors").alias("slot", "n")).select("frame_id", "atom_idx", "slot", "n.nbr_idx", "n.lv")


def canonical_clusters(clusters: DataFrame, lattices: DataFrame) -> DataFrame:
    """Clusters with topology names in the catalogue's spelling where it has them."""
    known = lattices.select(F.lower("name").alias("__k"), F.col("name").alias("__n"))
    named = clusters.join(known, F.lower(F.trim("topology_name")) == F.col("__k"), "left")
    return named.withColumn("topology_name", F.coalesce("__n", "topology_name")).drop("__k", "__n")


def reconstruct(atoms: DataFrame, clusters: DataFrame, neighbors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms with the structure and topology of their cluster (cluster 0 where it is not
    known), and the neighbour pairs with both positions, as max_neighbor_distance takes them."""
    c = clusters.select("frame_id", "cluster_id", F.col("structure").alias("__s"), "topology_name")
    known = atoms.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0))).join(c, ["frame_id", "cluster_id"], "left")
    full = known.withColumn("cluster_id", F.when(F.col("__s").isNull(), 0).otherwise(F.col("cluster_id"))).withColumn("structure_type", F.coalesce("structure_type", "__s", F.lit(0))).drop("__s")
    p = atoms.select("frame_id", "atom_idx", "x", "y", "z")
    q = atoms.select("frame_id", F.col("atom_idx").alias("nbr_idx"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    return full, neighbors.join(p, ["frame_id", "atom_idx"]).join(q, ["frame_id", "nbr_idx"])


def max_neighbor_distance(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(frame_id, max_distance) of neighbour pairs by minimum image."""
    from ..functions import cell as C
    from ..functions import linalg as la

    j = C.with_cell(pairs, boxes)
    d = C.wrap_vector(F.col("cell"), tuple(F.col(f"q{a}") - F.col(a) for a in "xyz"))
    return j.groupBy("frame_id").agg(F.max(la.length(d)).alias("max_distance"))
