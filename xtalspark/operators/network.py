"""Dislocation networks: segments, nodes (frame_id, segment_id, side, ring_id, edge_count,
is_dangling, is_blocked), junction rings, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import burgers as B
from ..functions import linalg as la
from .elastic import cut_lineage
from .lines import line_length, orient


def with_arms(nodes: DataFrame) -> DataFrame:
    """Append arms, the number of nodes in the ring; a node without a ring has one.

    Counts are grouped and joined back, so a ring of any size is no single task's.
    """
    counts = nodes.groupBy("frame_id", "ring_id").agg(F.count("*").cast("int").alias("__arms"))
    return nodes.join(counts, ["frame_id", "ring_id"], "left").withColumn("arms", F.coalesce("__arms", F.lit(1))).drop("__arms")


def junction_arms(nodes: DataFrame) -> DataFrame:
    """(frame_id, arms, n_nodes, total): histogram over nodes of more than one arm.

    Nodes are counted, not junctions. A frame without such nodes has the row (0, 0, 0).
    """
    many = with_arms(nodes).filter("arms > 1").groupBy("frame_id", "arms").agg(F.count("*").alias("n_nodes"))
    total = many.groupBy("frame_id").agg(F.sum("n_nodes").alias("total"))
    frames = nodes.select("frame_id").distinct()
    out = frames.join(many, "frame_id", "left").join(total, "frame_id", "left")
    return out.select("frame_id", F.coalesce("arms", F.lit(0)).alias("arms"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("total", F.lit(0)).alias("total"))


def circuit_statistics(nodes: DataFrame) -> DataFrame:
    """Per frame: circuits, dangling, blocked, mean, least and most edges."""
    zero = F.lit(0)
    return nodes.groupBy("frame_id").agg(
        F.count("edge_count").alias("n_circuits"),
        F.count_if("is_dangling").alias("n_dangling"),
        F.count_if("is_blocked").alias("n_blocked"),
        F.coalesce(F.avg("edge_count"), F.lit(0.0)).alias("mean_edges"),
        F.coalesce(F.min("edge_count"), zero).alias("min_edges"),
        F.coalesce(F.max("edge_count"), zero).alias("max_edges"),
    )


def count_junctions(nodes: DataFrame) -> DataFrame:
    """Per frame: half the nodes that do not dangle, rounded down."""
    free = F.count_if(F.col("arms") > 1)
    return with_arms(nodes).groupBy("frame_id").agg(F.floor(free / 2).cast("bigint").alias("n_junctions"))


def count_dangling_segments(nodes: DataFrame) -> DataFrame:
    """Per frame: segments of which at least one node dangles."""
    by = with_arms(nodes).groupBy("frame_id", "segment_id").agg(F.bool_or(F.col("arms") == 1).alias("d"))
    return by.groupBy("frame_id").agg(F.count_if("d").alias("n_dangling_segments"))


def network_statistics(segments: DataFrame, nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per frame over unclipped lines: length, counts, density by prepared cells' volume.

    Segments of less than two points count in n_all_segments only.
    """
    long = F.size("line") > 1
    s = segments.groupBy("frame_id").agg(
        F.coalesce(F.sum(F.when(long, line_length(F.col("line")))), F.lit(0.0)).alias("total_length"),
        F.count_if(long).alias("n_segments"),
        F.count("*").alias("n_all_segments"),
    )
    out = s.join(boxes, "frame_id").join(count_junctions(nodes), "frame_id", "left").join(count_dangling_segments(nodes), "frame_id", "left")
    volume = F.col("cell")["volume"]
    mean = F.when(F.col("n_segments") > 0, F.col("total_length") / F.nullif(F.col("n_segments"), F.lit(0))).otherwise(0.0)
    density = F.when(volume > 0, F.col("total_length") / F.nullif(volume, F.lit(0.0))).otherwise(0.0)
    return out.select("frame_id", "total_length", "n_segments", mean.alias("mean_length"), density.alias("density"), F.coalesce("n_junctions", F.lit(0)).alias("n_junctions"), F.coalesce("n_dangling_segments", F.lit(0)).alias("n_dangling_segments"), "n_all_segments")


def ring_classes(links: DataFrame) -> DataFrame:
    """(frame_id, v, ring_id): rings as connected components of links (frame_id, a, b);
    a ring's id is its smallest member. Labels spread and jump until none changes."""
    both = cut_lineage(links.select("frame_id", "a", "b").union(links.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("frame_id", "a").agg(F.least(F.min("b"), F.min("a")).alias("ring_id")).select("frame_id", F.col("a").alias("v"), "ring_id")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), ["frame_id", "b"]).groupBy("frame_id", "a").agg(F.min("ring_id").alias("near")).withColumnRenamed("a", "v")
        spread = cut_lineage(labels.join(near, ["frame_id", "v"]).select("frame_id", "v", F.least("ring_id", "near").alias("next"), "ring_id"))
        over = spread.select("frame_id", F.col("v").alias("next"), F.col("next").alias("over"))
        new = cut_lineage(spread.join(over, ["frame_id", "next"], "left").select("frame_id", "v", F.least("next", F.coalesce("over", "next")).alias("ring_id"), F.col("ring_id").alias("old")))
        labels = new.select("frame_id", "v", "ring_id")
        if new.filter("old <> ring_id").isEmpty():
            return labels


def dissolve(nodes: DataFrame, condition) -> DataFrame:
    """Rings with a node that meets the condition fall apart: each node is alone."""
    bad = nodes.filter(condition).select("frame_id", "ring_id").distinct().withColumn("__bad", F.lit(True))
    alone = F.concat_ws(":", F.lit("alone"), "segment_id", "side") if dict(nodes.dtypes)["ring_id"] == "string" else F.lit(None).cast(dict(nodes.dtypes)["ring_id"])
    out = nodes.join(bad, ["frame_id", "ring_id"], "left")
    return out.withColumn("ring_id", F.when(F.col("__bad"), alone).otherwise(F.col("ring_id"))).select(*nodes.columns)


def chase_replaced(pairs: DataFrame) -> DataFrame:
    """(frame_id, segment_id, root) from (frame_id, segment_id, replaced_with): pointers
    are doubled until none moves; null or own pointers are roots."""
    now = cut_lineage(pairs.select("frame_id", "segment_id", F.coalesce("replaced_with", "segment_id").alias("root")))
    while True:
        nxt = now.select("frame_id", F.col("segment_id").alias("root"), F.col("root").alias("far"))
        new = cut_lineage(now.join(nxt, ["frame_id", "root"], "left").select("frame_id", "segment_id", F.coalesce("far", "root").alias("far"), "root"))
        done = new.filter("far <> root").isEmpty()
        now = new.select("frame_id", "segment_id", F.col("far").alias("root"))
        if done:
            return now


def line_kinds(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Append is_loop (the two nodes ring each other only) and is_infinite (a loop
    whose ends differ, so that it winds through the cell)."""
    ring = nodes.groupBy("frame_id", "ring_id").agg(F.count("*").alias("n"), F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi"))
    closed = ring.filter("n = 2 and lo = hi").select("frame_id", F.col("lo").alias("segment_id"), F.lit(True).alias("__closed"))
    gap = la.sub(la.xyz(F.get("line", F.size("line") - 1)), la.xyz(F.get("line", F.lit(0))))
    out = segments.join(closed, ["frame_id", "segment_id"], "left").withColumn("is_loop", F.coalesce("__closed", F.lit(False)))
    return out.withColumn("is_infinite", F.col("is_loop") & F.coalesce(~la.is_zero(gap, la.ATOM_EPSILON), F.lit(False))).drop("__closed")


def node_vectors(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Append to nodes px, py, pz, nbx, nby, nbz: a forward node has the line's last point
    and b, a backward one its first point and -b."""
    s = segments.select("frame_id", "segment_id", "line", "bx", "by", "bz")
    ahead = F.col("side") == "fwd"
    joined = nodes.join(s, ["frame_id", "segment_id"])
    at = F.when(ahead, F.get("line", F.size("line") - 1)).otherwise(F.get("line", F.lit(0)))
    return joined.select(*nodes.columns, *(at[a].alias(f"p{a}") for a in "xyz"), *(F.when(ahead, F.col(f"b{a}")).otherwise(-F.col(f"b{a}")).alias(f"nb{a}") for a in "xyz"))


def finish_segments(segments: DataFrame, transitions: DataFrame, clusters: DataFrame, reference: str) -> DataFrame:
    """Drop preliminary points (n_pre at the start, n_post at the end), bring b into the
    reference topology by a transition of distance 1 at most, orient, number anew."""
    keep = F.greatest(F.size("line") - F.col("n_pre") - F.col("n_post"), F.lit(0))
    cut = lambda c: F.slice(c, F.col("n_pre") + 1, keep)
    s = segments.withColumn("__line", cut("line")).withColumn("core_size", cut("core_size")).drop("line").withColumnRenamed("__line", "line")
    own = clusters.select("frame_id", "cluster_id", F.col("topology_name").alias("__name"))
    goal = own.filter(F.col("__name") == reference).select("frame_id", F.col("cluster_id").alias("c2"))
    first = transitions.filter("distance <= 1").join(goal, ["frame_id", "c2"]).groupBy("frame_id", F.col("c1").alias("cluster_id"))
    first = first.agg(F.min_by(F.struct("c2", "tm"), F.struct("distance", "c2")).alias("__to"))
    joined = s.join(own, ["frame_id", "cluster_id"], "left").join(first, ["frame_id", "cluster_id"], "left")
    move = (F.coalesce("__name", F.lit("")) != reference) & F.col("__to").isNotNull()
    b = la.matvec(la.mat(F.col("__to.tm")), (F.col("bx"), F.col("by"), F.col("bz")))
    out = joined
    new = [F.when(move, x).otherwise(F.col(n)).alias(n) for x, n in zip(b, ("bx", "by", "bz"))]
    rest = [c for c in s.columns if c not in ("bx", "by", "bz", "cluster_id", "n_pre", "n_post")]
    out = out.select(*rest, F.when(move, F.col("__to.c2")).otherwise(F.col("cluster_id")).alias("cluster_id"), *new)
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("segment_id")) - 1
    return orient(out).withColumn("segment_id", number)


def line_attributes(lines: DataFrame, clusters: DataFrame, structure_names: dict[int, str] | None = None) -> DataFrame:
    """The columns of the exported lines from (frame_id, segment_id, line, bx, by, bz, cluster_id, head_vertex, tail_vertex)."""
    c = clusters.select("frame_id", "cluster_id", "structure", "topology_name", "orientation")
    j = lines.join(c, ["frame_id", "cluster_id"], "left")
    b = (F.col("bx"), F.col("by"), F.col("bz"))
    names = F.create_map(*(F.lit(x) for kv in (structure_names or {}).items() for x in kv)) if structure_names else None
    fallback = F.element_at(names, F.col("structure")) if names is not None else F.col("structure").cast("string")
    structure = B.topology_name(F.col("topology_name"), F.coalesce(fallback, F.lit("other")))
    far = B.global_vector(b, F.col("orientation"))
    fam = B.family(b, structure)
    out = j.withColumn("crystal_structure", structure).withColumn("__f", fam)
    return out.select(
        "frame_id",
        "segment_id",
        line_length(F.col("line")).alias("length"),
        F.size("line").alias("num_points"),
        la.length(b).alias("magnitude"),
        la.packed(b).alias("burgers_vector_local"),
        la.packed(far).alias("burgers_vector_global"),
        "crystal_structure",
        F.col("__f.name").alias("burgers_family"),
        F.col("__f.label").alias("burgers_family_label"),
        "cluster_id",
        *(F.col(c).alias(c) for c in ("head_vertex", "tail_vertex") if c in lines.columns),
        "line",
    )


def burgers_summary(lines: DataFrame) -> DataFrame:
    """Per family label, or per vector where the family is Other: count and length."""
    own = B.label(la.vec("burgers_vector_local"))
    name = F.when(F.col("burgers_family") == B.OTHER, own).otherwise(F.col("burgers_family_label"))
    return lines.groupBy("frame_id", name.alias("burgers_vector")).agg(F.count("*").alias("n_lines"), F.sum("length").alias("total_length")).orderBy("frame_id", "burgers_vector")


def family_summary(lines: DataFrame) -> DataFrame:
    """Per family: the label seen last, count, length, share of the frame's length."""
    by = lines.groupBy("frame_id", "burgers_family").agg(F.max_by("burgers_family_label", "segment_id").alias("label"), F.count("*").alias("n_lines"), F.sum("length").alias("total_length"))
    total = by.groupBy("frame_id").agg(F.sum("total_length").alias("__all"))
    share = F.when(F.col("__all") > 0, F.col("total_length") / F.nullif(F.col("__all"), F.lit(0.0))).otherwise(0.0)
    return by.join(total, "frame_id").withColumn("fraction", share).drop("__all").orderBy("frame_id", "burgers_family")


def fold_circuit(edges: DataFrame) -> DataFrame:
    """Burgers vector and closing rotation of circuits: rows (frame_id, circuit_id, seq, cv,
    rtm, is_self) are folded in order: b += M v, then M = M * reverse of other transitions."""
    row = F.struct("seq", "cv", "rtm", "is_self")
    g = edges.groupBy("frame_id", "circuit_id").agg(F.array_sort(F.collect_list(row)).alias("e"))
    eye = F.array(*(F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)))
    start = F.struct(F.array(*[F.lit(0.0)] * 3).alias("b"), eye.alias("m"))

    def step(acc, x):
        b = la.add(la.vec(acc["b"]), la.matvec(la.mat(acc["m"]), la.vec(x["cv"])))
        m = F.when(x["is_self"], acc["m"]).otherwise(la.packed(la.matmul(la.mat(acc["m"]), la.mat(x["rtm"]))))
        return F.struct(la.packed(b).alias("b"), m.alias("m"))

    s = F.aggregate("e", start, step)
    return g.select("frame_id", "circuit_id", F.size("e").alias("edge_count"), s.alias("s")).select("frame_id", "circuit_id", "edge_count", "s.b", la.is_identity(la.mat("s.m")).alias("closes"))


def circuit_centres(edges: DataFrame) -> DataFrame:
    """(frame_id, circuit_id, x, y, z): the first vertex (sx, sy, sz) plus the mean of the
    running sums of physical vectors (px, py, pz), edges in order of seq."""
    w = Window.partitionBy("frame_id", "circuit_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = edges.select("frame_id", "circuit_id", "seq", *(F.col(f"s{a}") for a in "xyz"), *(F.sum(f"p{a}").over(w).alias(f"r{a}") for a in "xyz"))
    return run.groupBy("frame_id", "circuit_id").agg(*((F.min_by(f"s{a}", "seq") + F.avg(f"r{a}")).alias(a) for a in "xyz"))


def blocked_circuits(circuit_edges: DataFrame, half_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frame_id, circuit_id, is_blocked) and the pairs (frame_id, a, b) of circuits that
    meet a blocked one: a circuit is blocked if every opposite edge is on a circuit.

    circuit_edges are (frame_id, circuit_id, face, slot); half_edges have opp_face, opp_slot.
    """
    own = circuit_edges.select("frame_id", "circuit_id", "face", "slot")
    across = own.join(half_edges.select("frame_id", "face", "slot", "opp_face", "opp_slot"), ["frame_id", "face", "slot"])
    other = own.select("frame_id", F.col("face").alias("opp_face"), F.col("slot").alias("opp_slot"), F.col("circuit_id").alias("other"))
    met = across.join(other, ["frame_id", "opp_face", "opp_slot"], "left")
    state = met.groupBy("frame_id", "circuit_id").agg(F.bool_and(F.col("other").isNotNull() & (F.col("other") != F.col("circuit_id"))).alias("is_blocked"))
    pairs = met.join(state.filter("is_blocked"), ["frame_id", "circuit_id"]).select("frame_id", F.col("circuit_id").alias("a"), F.col("other").alias("b")).distinct()
    return state, pairs


def to_cluster(vectors: DataFrame, transitions: DataFrame, target: str = "target") -> DataFrame:
    """Vectors (.., bx, by, bz, cluster_id) in the frame of the cluster in the column
    target; nulls where no transition leads there."""
    t = transitions.select("frame_id", F.col("c1").alias("cluster_id"), F.col("c2").alias(target), F.col("tm").alias("__tm"))
    j = vectors.join(t, ["frame_id", "cluster_id", target], "left")
    turned = la.matvec(la.mat("__tm"), (F.col("bx"), F.col("by"), F.col("bz")))
    same = F.col("cluster_id") == F.col(target)
    new = [F.when(same, F.col(n)).otherwise(x).alias(n) for n, x in zip(("bx", "by", "bz"), turned)]
    rest = [c for c in vectors.columns if c not in ("bx", "by", "bz", "cluster_id", target)]
    return j.select(*rest, F.col(target).alias("cluster_id"), *new)


def discard_segments(segments: DataFrame, gone: DataFrame) -> DataFrame:
    """Segments without those of (frame_id, segment_id)."""
    return segments.join(gone, ["frame_id", "segment_id"], "left_anti")
