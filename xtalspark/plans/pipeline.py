"""An analysis as one bundle of lazy DataFrames: nothing runs until a result is read or exported."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cell as C
from ..functions import linalg as la
from ..operators import delaunay, elastic, ghosts, lines, mesh, network, regions, tess, tracer
from ..operators.elastic import cut_lineage
from ..operators.indexing import dense_index
from ..sources import lammps, lattices, sinks, tables
from .options import DxaOptions

#: Grid of the join of circuit triangles with cells, in neighbour distances.
CORE_GRID = 2.0


@dataclass
class DxaPipeline:
    """Stages from atoms to dislocation lines for any number of frames.

    atoms, cells, clusters, transitions and neighbors have the schemas of
    sources.tables; distances (frame_id, max_distance) holds each frame's longest
    neighbour bond. Every stage is keyed by frame_id. own_vectors says that the
    neighbour vectors are the frame's own, not the ideal lattice's: only then do
    they and the distances follow a metric rescale.
    """

    options: DxaOptions
    atoms: DataFrame
    cells: DataFrame
    clusters: DataFrame
    transitions: DataFrame
    neighbors: DataFrame
    distances: DataFrame
    own_vectors: bool = True

    @classmethod
    def from_paths(cls, spark: SparkSession, options: DxaOptions, atoms: DataFrame, cells: DataFrame, distances: DataFrame | None = None, own_vectors: bool = True) -> DxaPipeline:
        """Tables named in the options; all of them are required."""
        options.require()
        read = tables.read
        clusters = tables.canonical_clusters(read(spark, options.clusters_table, tables.CLUSTERS), lattices.catalogue(spark, options.lattice_dir or None))
        neighbors = read(spark, options.neighbor_lattice, tables.NEIGHBORS)
        full, pairs = tables.reconstruct(atoms, clusters, neighbors)
        if distances is None:
            distances = tables.max_neighbor_distance(pairs, C.prepare_cells(cells))
        return cls(options, full, cells, clusters, read(spark, options.clusters_transitions, tables.TRANSITIONS), neighbors, distances, own_vectors)

    # -- the crystal

    @cached_property
    def reach(self) -> DataFrame:
        """(frame_id, d): the neighbour distance in the rescaled metric."""
        near = C.rescale_neighbors(self.neighbors, self.options.metric_rescale, 1.0, self.own_vectors)[1]
        return cut_lineage(self.cells.select("frame_id").join(self.distances, "frame_id", "left").select("frame_id", (F.coalesce("max_distance", F.lit(0.0)) * near).alias("d")))

    @cached_property
    def boxes(self) -> DataFrame:
        return C.prepare_cells(C.rescale_cells(self.cells, self.options.metric_rescale))

    @cached_property
    def points(self) -> DataFrame:
        """Atoms in the rescaled metric."""
        p = C.rescale_points((F.col("x"), F.col("y"), F.col("z")), self.options.metric_rescale)
        rest = [c for c in self.atoms.columns if c not in ("x", "y", "z")]
        return self.atoms.select(*rest, *(v.alias(a) for v, a in zip(p, "xyz")))

    @cached_property
    def vertices(self) -> DataFrame:
        """Points of the tessellation with handles (vh): primary points first."""
        o = self.options
        boxes = self.boxes.join(self.reach, "frame_id")
        pts = ghosts.tessellation_points(self.points, boxes, o.ghost_layer_scale * F.col("d"), o.cover_domain_with_finite_tets)
        part = F.when(F.col("is_ghost"), 1 << 40).otherwise(0) + F.floor(F.coalesce("particle", F.lit(-1)) / 4096)
        order = ["is_ghost", "__p", "x", "y", "z"]
        numbered = dense_index(pts.withColumn("__part", part).withColumn("__p", F.coalesce("particle", F.lit(-1))), ["frame_id"], "__part", order, "vh")
        return cut_lineage(numbered.drop("__part", "__p"))

    @cached_property
    def tessellation(self) -> DataFrame:
        """Cells (frame_id, cell, v0..v3 handles, p0..p3, is_finite, is_ghost, a0..a3 atoms)."""
        raw = delaunay.delaunay(self.vertices)
        placed = tess.corner_positions(raw, self.vertices)
        p = [F.col(f"p{i}") for i in range(4)]
        ghost = ~F.col("is_finite") | tess.ghost_cell([x["particle"] for x in p], [x["is_ghost"] for x in p])
        return cut_lineage(placed.withColumn("is_ghost", ghost).select("*", *(x["particle"].cast("int").alias(f"a{i}") for i, x in enumerate(p))))

    @cached_property
    def atom_cells(self) -> DataFrame:
        """The tessellation with atoms as corners."""
        t = self.tessellation
        return t.select("frame_id", "cell", "is_finite", "is_ghost", *(F.col(f"a{i}").alias(f"v{i}") for i in range(4)))

    @cached_property
    def moves(self) -> DataFrame:
        """Cluster transitions, composed."""
        return elastic.close_transitions(self.transitions)

    @cached_property
    def edges(self) -> DataFrame:
        """Tessellation edges with ideal vectors and transitions."""
        t = self.tessellation.filter(la.all_true(F.col(f"a{i}").isNotNull() for i in range(4)))
        named = t.select("frame_id", "is_ghost", *(F.col(f"a{i}").alias(f"v{i}") for i in range(4)), *(f"p{i}" for i in range(4)))
        plain = cut_lineage(tess.tessellation_edges(named, self.boxes))
        own = self.atoms.select("frame_id", "atom_idx", "cluster_id")
        labels = elastic.propagate_labels(plain, own.withColumnRenamed("atom_idx", "v"))
        near, _ = C.rescale_neighbors(self.neighbors, self.options.metric_rescale, 1.0, self.own_vectors)
        paths = elastic.crystal_paths(plain.select("frame_id", F.col("v1").alias("a"), F.col("v2").alias("b")), near, own, self.moves, self.options.crystal_path_steps)
        return cut_lineage(elastic.ideal_vectors(plain, labels, paths, self.moves))

    @cached_property
    def classified(self) -> DataFrame:
        """Cells with is_filled, compatible and region."""
        corners = [la.xyz(F.col(f"p{i}")) for i in range(4)]
        t = self.tessellation.join(self.reach, "frame_id")
        t = t.withColumn("alpha_ok", F.when(F.col("is_finite"), tess.alpha_test(corners, self.options.interface_alpha_scale * F.col("d")))).drop("d")
        fill = tess.filled_cells(t.select("frame_id", "cell", "v0", "v1", "v2", "v3", "is_finite", "alpha_ok"))
        good = elastic.compatible_cells(self.atom_cells, self.edges)
        j = t.join(fill, ["frame_id", "cell"]).join(good, ["frame_id", "cell"], "left")
        ok = F.coalesce("compatible", F.lit(False))
        return cut_lineage(j.withColumn("compatible", ok).withColumn("region", (F.col("is_filled") & ok).cast("int")))

    # -- the interface mesh

    @cached_property
    def interface(self) -> DataFrame:
        """Faces (frame_id, face, a, b, c, cell, facet) of the interface between good and bad crystal; corners are atoms."""
        cells = self.classified.select("frame_id", "cell", *(f"v{i}" for i in range(4)), "region", "is_ghost")
        f = tess.interface_facets(cells).select("frame_id", "cell", "face")
        named = self.atom_cells.select("frame_id", "cell", *(f"v{i}" for i in range(4)))
        corners = tess.facets(named).select("frame_id", "cell", "face", "a", "b", "c")
        return cut_lineage(mesh.mesh_from_interface(f.join(corners, ["frame_id", "cell", "face"])))

    @cached_property
    def interface_half_edges(self) -> DataFrame:
        """Half-edges with their opposites, found by turning around the edges."""
        return cut_lineage(mesh.link_around_edges(self.interface, self.classified))

    @cached_property
    def manifold(self) -> tuple[DataFrame, DataFrame]:
        """Faces whose vertices have one fan each, and vertices (frame_id, v, of, x, y, z)."""
        faces, vertices = mesh.make_manifold(self.interface.select("frame_id", "face", "a", "b", "c"), self.interface_half_edges)
        at = self.points.select("frame_id", F.col("atom_idx").alias("of"), "x", "y", "z")
        return cut_lineage(faces), cut_lineage(vertices.join(at, ["frame_id", "of"]))

    @cached_property
    def surface(self) -> DataFrame:
        """Half-edges between the manifold's vertices with physical and ideal vectors."""
        at = self.points.select("frame_id", "atom_idx", "x", "y", "z")
        vectors = mesh.edge_vectors(self.interface_half_edges, at, self.boxes, self.edges).drop("v1", "v2")
        return cut_lineage(mesh.half_edges(self.manifold[0]).join(vectors, ["frame_id", "face", "slot"]))

    # -- the lines

    @cached_property
    def traced(self) -> DataFrame:
        o = self.options
        vertices = self.manifold[1].select("frame_id", "v", "x", "y", "z")
        return cut_lineage(tracer.trace(self.surface, vertices, self.boxes, o.max_trial_circuit_size, o.circuit_stretchability, o.mark_core_atoms))

    @cached_property
    def nodes(self) -> DataFrame:
        """(frame_id, segment_id, side, ring_id, edge_count, is_dangling, is_blocked, cap); sides are those of the finished lines."""
        n = self.traced.select("frame_id", "segment_id", F.explode("nodes").alias("n")).select("frame_id", "segment_id", "n.*")
        turned = self.finished.select("frame_id", "segment_id", "flipped")
        side = F.when(F.coalesce("flipped", F.lit(False)), F.when(F.col("side") == "fwd", "bwd").otherwise("fwd")).otherwise(F.col("side"))
        return n.join(turned, ["frame_id", "segment_id"], "left").withColumn("side", side).drop("flipped")

    @cached_property
    def finished(self) -> DataFrame:
        """Segments in the reference topology, oriented."""
        s = self.traced.drop("nodes", "faces", "fans")
        return cut_lineage(network.finish_segments(s, self.moves, self.clusters, self.options.reference_topology))

    @cached_property
    def segments(self) -> DataFrame:
        """Smoothed segments in the frame's own metric, with is_loop and is_infinite."""
        o = self.options
        s = self.finished.withColumn("line", C.unrescale_line(F.col("line"), o.metric_rescale))
        kinds = network.line_kinds(s, self.nodes)
        return cut_lineage(lines.smooth_lines(kinds, o.line_smoothing_level, o.line_point_interval))

    @cached_property
    def dislocations(self) -> DataFrame:
        """The exported lines: one row for each line, or for each part of it within the cell."""
        s = lines.nondegenerate(self.segments)
        if self.options.clip_pbc_segments:
            own = s.select("frame_id", "segment_id", "bx", "by", "bz", "cluster_id")
            s = lines.clip_lines(s.select("frame_id", "segment_id", "line"), self.cells).join(own, ["frame_id", "segment_id"])
            s = lines.nondegenerate(s)
        ends = s.withColumn("head_vertex", la.packed(la.xyz(F.get("line", F.lit(0))))).withColumn("tail_vertex", la.packed(la.xyz(F.get("line", F.size("line") - 1))))
        return cut_lineage(network.line_attributes(ends, self.clusters, dict(enumerate(lattices.STRUCTURES))))

    @cached_property
    def core_atoms(self) -> DataFrame:
        """Atoms with dislocation_id, -1 off the cores."""
        corners = [la.xyz(F.col(f"p{i}")) for i in range(4)]
        t = self.classified.join(self.reach, "frame_id")
        defect = tess.defect_cells(F.col("region"), F.col("is_finite"), corners, F.col("d"))
        longest = self.reach.agg(F.max("d")).first()[0] or 1.0
        claims = regions.core_claims(self.traced, cut_lineage(t.filter(defect)), CORE_GRID * longest)
        by_atom = t.select("frame_id", "cell", *(f"a{i}" for i in range(4)))
        named = claims.select("frame_id", "cell", "segment_id").join(by_atom, ["frame_id", "cell"])
        named = named.select("frame_id", "cell", "segment_id", *(F.col(f"a{i}").alias(f"v{i}") for i in range(4)))
        return regions.core_atom_ids(named, self.atoms)

    @cached_property
    def defect_mesh(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Points (frame_id, v, x, y, z) and faces of the defect mesh: the interface without what the lines
        swept, capped where they dangle; and whether it is closed, by frame."""
        faces, vertices = self.manifold
        circuit = self.traced.select("frame_id", "segment_id", F.explode("faces").alias("f"))
        circuit = circuit.select("frame_id", F.col("f.face").alias("face"), F.col("segment_id").alias("circuit_id"), F.col("f.flag").alias("flag"), F.col("f.dangling").alias("circuit_dangling"))
        ends = network.node_vectors(self.nodes.filter("is_dangling and size(cap) >= 2"), self.finished)
        top = vertices.groupBy("frame_id").agg(F.max("v").alias("top"))
        ends = dense_index(ends, ["frame_id"], "segment_id", ["side"], "n").join(top, "frame_id")
        ends = cut_lineage(ends.filter("px is not null").select("frame_id", (F.col("top") + 1 + F.col("n")).cast("int").alias("apex"), "cap", *(F.col(f"p{a}").alias(a) for a in "xyz")))
        sides = ends.select("frame_id", "apex", F.explode("cap").alias("h")).select("frame_id", "apex", F.floor(F.col("h") / 3).cast("int").alias("face"), (F.col("h") % 3).alias("slot"))
        rim = mesh.half_edges(faces)
        caps = sides.join(rim, ["frame_id", "face", "slot"]).select("frame_id", "apex", "v1", "v2")
        out = cut_lineage(mesh.defect_mesh(faces.join(circuit, ["frame_id", "face"], "left"), caps))
        points = vertices.select("frame_id", "v", "x", "y", "z").unionByName(ends.select("frame_id", F.col("apex").alias("v"), "x", "y", "z"))
        return points, out, mesh.watertight(mesh.link_opposites(mesh.half_edges(out)))

    # -- results

    def flags(self) -> DataFrame:
        """Per frame: whether all, or none, of the filled cells are compatible."""
        return tess.mesh_flags(self.classified)

    def export(self, base: str) -> dict[str, str]:
        """What the options ask for, as Parquet; names to paths."""
        o, out = self.options, {}
        if o.export_defect_mesh:
            points, faces, closed = self.defect_mesh
            pts, facets = mesh.unwrap_faces(faces, points, self.boxes)
            out |= sinks.mesh_tables(pts, facets, base, "defect_mesh", faces, self.cells, closed)
        if o.export_dislocations:
            out |= sinks.dislocations(self.dislocations, base)
            out |= sinks.network_reports(lines.nondegenerate(self.segments), self.nodes.drop("cap"), C.prepare_cells(self.cells), base, o.export_circuit_information, o.export_dislocation_network_stats, o.export_junctions)
            out |= {"structure_counts": sinks.write(regions.structure_counts(self.atoms), base, "dislocation_structure_counts")}
        if o.export_interface_mesh:
            faces, vertices = self.manifold
            pts, facets = mesh.unwrap_faces(faces, vertices.select("frame_id", "v", "x", "y", "z"), self.boxes)
            out |= sinks.mesh_tables(pts, facets, base, "interface_mesh", faces, self.cells, self.flags())
        if o.export_delaunay_tessellation:
            real = self.tessellation.filter("is_finite and not is_ghost").select("frame_id", "cell", "v0", "v1", "v2", "v3")
            out |= sinks.tessellation(real, base)
        if o.export_structure_identification:
            out |= sinks.structures(self.atoms, base)
        if o.mark_core_atoms:
            out |= sinks.core_atoms(self.core_atoms, base)
        if o.export_coherent_crystalline_regions:
            out |= sinks.crystalline_regions(self.atoms, self.clusters, base)
        return out

    def summary(self) -> DataFrame:
        """Per frame: mesh flags, faces, structure totals, lines."""
        faces = self.interface.groupBy("frame_id").agg(F.count("*").alias("n_faces"))
        found = self.dislocations.groupBy("frame_id").agg(F.count("*").alias("n_lines"), F.sum("length").alias("total_length"))
        j = regions.region_totals(self.atoms).join(self.flags(), "frame_id", "left").join(faces, "frame_id", "left").join(found, "frame_id", "left")
        return j.fillna(0, ["n_faces", "n_lines"]).fillna(0.0, ["total_length"])


def analyse(spark: SparkSession, argv: list[str]) -> dict[str, object]:
    """Run an analysis from a command line (options, a dump, a base path for results); what goes
    wrong is in the answer: {"is_failed": false, "exports": ...} or {"is_failed": true, "error": ...}."""
    try:
        options, rest = DxaOptions.from_arguments(argv)
        options.require()
        if len(rest) != 2:
            raise ValueError("a dump and a base path for results are needed")
        options = options.named(lattices.catalogue(spark, options.lattice_dir or None))
        atoms, cells = lammps.read_dump(spark, rest[0])
        atoms, cells = cut_lineage(atoms), cut_lineage(cells)
        bad = lammps.validate_frames(atoms, cells).first()
        if bad is not None:
            raise ValueError(f"frame {bad['frame_id']}: {bad['error']}")
        return {"is_failed": False, "exports": DxaPipeline.from_paths(spark, options, atoms, cells).export(rest[1])}
    except Exception as e:  # noqa: BLE001
        return {"is_failed": True, "error": f"DXA failed: {e}"}


if __name__ == "__main__":
    answer = analyse(SparkSession.builder.getOrCreate(), sys.argv[1:])
    print(json.dumps(answer))
    sys.exit(int(answer["is_failed"]))
