"""Exports: each listing is a Parquet folder of its own under a base path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import network, regions, tess


def write(df: DataFrame, base: str, name: str, partition: list[str] | None = None) -> str:
    path = f"{base.rstrip('/')}_{name}"
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    return path


def dislocations(lines: DataFrame, base: str) -> dict[str, str]:
    """Lines with attributes, the listings made of them and two chart series, counts and lengths by Burgers vector."""
    from ..operators.lines import line_totals

    totals = line_totals(lines.select("frame_id", "length", F.col("num_points").alias("n_points")))
    burgers = network.burgers_summary(lines)
    return {
        "lines": write(lines, base, "dislocations"),
        "summary": write(totals, base, "dislocation_summary"),
        "burgers": write(burgers, base, "burgers_summary"),
        "burgers_counts": write(burgers.select("frame_id", "burgers_vector", F.col("n_lines").alias("segment_count")), base, "chart_burgers_counts"),
        "burgers_lengths": write(burgers.select("frame_id", "burgers_vector", "total_length"), base, "chart_burgers_lengths"),
        "families": write(network.family_summary(lines), base, "family_summary"),
    }


def network_reports(segments: DataFrame, nodes: DataFrame, boxes: DataFrame, base: str, circuits: bool = True, stats: bool = True, junctions: bool = True) -> dict[str, str]:
    out = {}
    if stats:
        out["network"] = write(network.network_statistics(segments, nodes, boxes), base, "network_statistics")
    if circuits:
        out["circuits"] = write(network.circuit_statistics(nodes), base, "circuit_information")
    if junctions:
        out["junctions"] = write(network.junction_arms(nodes), base, "junctions")
    return out


def mesh_tables(points: DataFrame, facets: DataFrame, base: str, name: str, faces: DataFrame, cells: DataFrame, flags: DataFrame) -> dict[str, str]:
    """Points and facets of a mesh as exported, their totals and the cell by frame, the Euler
    characteristic of the faces before unwrapping, and flags (frame_id, ...)."""
    n = points.groupBy("frame_id").agg(F.count("*").alias("total_nodes")).join(facets.groupBy("frame_id").agg(F.count("*").alias("total_facets")), "frame_id", "left")
    topology = tess.euler_characteristic(faces).select("frame_id", F.col("euler").alias("euler_characteristic"))
    return {
        f"{name}_points": write(points, base, f"{name}_points"),
        f"{name}_facets": write(facets, base, f"{name}_facets"),
        f"{name}_totals": write(n, base, f"{name}_totals"),
        f"{name}_cell": write(cells.select("frame_id", "matrix", "origin", "pbc"), base, f"{name}_cell"),
        f"{name}_topology": write(flags.join(topology, "frame_id", "left"), base, f"{name}_topology"),
    }


def tessellation(cells: DataFrame, base: str) -> dict[str, str]:
    return {"facets": write(tess.distinct_facets(cells), base, "delaunay_facets"), "counters": write(tess.facet_counters(cells), base, "delaunay_counters")}


def crystalline_regions(atoms: DataFrame, clusters: DataFrame | None, base: str) -> dict[str, str]:
    return {
        "regions": write(regions.region_table(atoms, clusters), base, "regions"),
        "totals": write(regions.region_totals(atoms), base, "region_totals"),
        "atoms": write(atoms.filter("cluster_id <> 0"), base, "region_atoms", ["cluster_id"]),
    }


def structures(atoms: DataFrame, base: str) -> dict[str, str]:
    return {"atoms": write(atoms, base, "structure_atoms"), "counts": write(regions.structure_counts(atoms), base, "structure_counts")}


def core_atoms(atoms: DataFrame, base: str) -> dict[str, str]:
    return {"core_atoms": write(regions.core_atoms(atoms), base, "core_atoms")}
