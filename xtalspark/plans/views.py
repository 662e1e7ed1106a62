"""Deterministic atoms, cells, lines and nodes made from the driver's tables, so
that operators can be checked against SQL: each view as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cell import Cell
from ..operators.indexing import dense_index

#: A periodic cube of 40.
BOX = Cell(((40.0, 0.0, 0.0), (0.0, 40.0, 0.0), (0.0, 0.0, 40.0)), (-20.0, -20.0, -20.0))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frame() -> object:
    return F.lit(0).cast("bigint").alias("frame_id")


def atoms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    at = lambda c, k: (((F.col(c) * k) % 8001).cast("double") / 100.0 - 20.0)
    return o.select(
        frame(),
        F.col("o_orderkey").alias("atom_idx"),
        at("o_custkey", 7919).alias("x"),
        at("o_orderkey", 104729).alias("y"),
        at("o_orderkey", 1299709).alias("z"),
        (F.col("o_custkey") % 11).cast("int").alias("cluster_id"),
        (F.col("o_orderkey") % 5).cast("int").alias("structure_type"),
    )


def _proper(df: DataFrame) -> DataFrame:
    pairs = [(i, j) for i in range(4) for j in range(i)]
    for i, j in pairs:
        df = df.filter(F.col(f"v{i}") != F.col(f"v{j}"))
    return df


def _tets(df: DataFrame) -> DataFrame:
    return dense_index(_proper(df), ["frame_id"], "v0", ["v1", "v2", "v3"], "cell").select("frame_id", "cell", "v0", "v1", "v2", "v3", *(c for c in df.columns if c == "region"))


def _corners(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the tets, some more than once."""
    n = table(spark, d, "orders").count()
    li = table(spark, d, "lineitem")
    c = F.col
    return li.select(frame(), c("l_orderkey").alias("v0"), ((c("l_orderkey") * 31 + c("l_linenumber") * 17) % n).alias("v1"), ((c("l_partkey") * 13 + c("l_suppkey")) % n).alias("v2"), ((c("l_partkey") + c("l_orderkey")) % n).alias("v3"))


def tets(spark: SparkSession, d: str) -> DataFrame:
    # Dealt once, by ranges of the first corner: rows are made distinct and numbered where they are then.
    dealt = _proper(_corners(spark, d)).withColumn("__range", F.floor(F.col("v0") / 4096)).repartition("__range")
    return dense_index(dealt.distinct(), ["frame_id"], "__range", ["v0", "v1", "v2", "v3"], "cell", few=True).select("frame_id", "cell", "v0", "v1", "v2", "v3")


def cells(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "lineitem").select(frame(), (c("l_orderkey") % 37).alias("v0"), (c("l_partkey") % 37).alias("v1"), ((c("l_suppkey") * 7 + c("l_linenumber")) % 37).alias("v2"), ((c("l_orderkey") + c("l_partkey")) % 37).alias("v3")).distinct()
    return _tets(rows).withColumn("region", ((c("v0") + c("v1") * 3 + c("v2") * 5 + c("v3") * 7) % 2).cast("int"))


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the tets, some more than once; they need no numbers of the tets."""
    from ..operators.tess import edge_rows

    return edge_rows(_proper(_corners(spark, d)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edge_rows(spark, d).distinct()


def line_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = lambda k: ((F.col("event_id") % k).cast("double") * 0.5)
    return e.select(frame(), F.col("user_id").alias("segment_id"), F.struct("ts", "event_id").alias("seq"), at(97).alias("x"), at(89).alias("y"), at(83).alias("z"), (3 + F.col("event_id") % 7).cast("int").alias("core"))


def burgers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    sixth = lambda x: ((x % 7 - 3).cast("double") / 6.0)
    names = ["fcc", "bcc", "hcp", "cubic_diamond", "sc", "hex_diamond"]
    return p.select(
        frame(),
        F.col("p_partkey").alias("segment_id"),
        sixth(F.col("p_partkey")).alias("bx"),
        sixth(F.col("p_size")).alias("by"),
        sixth(F.floor(F.col("p_partkey") / 7)).alias("bz"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("structure"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.select(frame(), k.alias("segment_id"), F.lit("fwd").alias("side"), F.col("o_custkey").cast("bigint").alias("ring_id"), (3 + k % 11).cast("int").alias("edge_count"))
    b = o.select(frame(), k.alias("segment_id"), F.lit("bwd").alias("side"), ((k * 31) % 1500).cast("bigint").alias("ring_id"), (3 + k % 7).cast("int").alias("edge_count"))
    return a.unionByName(b).withColumn("is_dangling", F.col("edge_count") % 4 == 0).withColumn("is_blocked", F.col("edge_count") % 3 == 0)


# The same views for the SQL side.
SQL = {
    "dv_atoms": """select 0::bigint frame_id, o_orderkey atom_idx, ((o_custkey*7919)%8001)::double/100.0::double-20.0::double x,
  ((o_orderkey*104729)%8001)::double/100.0::double-20.0::double y, ((o_orderkey*1299709)%8001)::double/100.0::double-20.0::double z,
  (o_custkey%11)::int cluster_id, (o_orderkey%5)::int structure_type from orders""",
    "dv_tets": """select (row_number() over (order by v0,v1,v2,v3)-1)::bigint cell, * from (
  select distinct l_orderkey v0, (l_orderkey*31+l_linenumber*17)%n v1, (l_partkey*13+l_suppkey)%n v2, (l_partkey+l_orderkey)%n v3
  from lineitem cross join (select count(*) n from orders)) where v0<>v1 and v0<>v2 and v0<>v3 and v1<>v2 and v1<>v3 and v2<>v3""",
    "dv_cells": """select (row_number() over (order by v0,v1,v2,v3)-1)::bigint cell, *, ((v0+v1*3+v2*5+v3*7)%2)::int region from (
  select distinct l_orderkey%37 v0, l_partkey%37 v1, (l_suppkey*7+l_linenumber)%37 v2, (l_orderkey+l_partkey)%37 v3 from lineitem)
  where v0<>v1 and v0<>v2 and v0<>v3 and v1<>v2 and v1<>v3 and v2<>v3""",
    "dv_edges": """select distinct least(a,b) v1, greatest(a,b) v2 from (
  select v0 a,v1 b from dv_tets union all select v0,v2 from dv_tets union all select v0,v3 from dv_tets
  union all select v1,v2 from dv_tets union all select v1,v3 from dv_tets union all select v2,v3 from dv_tets)""",
    "dv_facets": """select cell, region, face, a, b, c, least(a,b,c) lo, a+b+c-least(a,b,c)-greatest(a,b,c) mid, greatest(a,b,c) hi from (
  select cell, region, 0 face, v1 a, v3 b, v2 c from dv_cells union all select cell, region, 1, v0, v2, v3 from dv_cells
  union all select cell, region, 2, v0, v3, v1 from dv_cells union all select cell, region, 3, v0, v1, v2 from dv_cells)""",
    "dv_near": """select f.*, g.cell other_cell, g.region other_region from dv_facets f left join dv_facets g on f.lo=g.lo and f.mid=g.mid and f.hi=g.hi and f.cell<>g.cell""",
    "dv_line_points": """select user_id segment_id, row_number() over (partition by user_id order by ts,event_id)-1 seq, (event_id%97)::double*0.5::double x,
  (event_id%89)::double*0.5::double y, (event_id%83)::double*0.5::double z, (3+event_id%7)::int core from events""",
    "dv_burgers": """select p_partkey segment_id, (p_partkey%7-3)::double/6.0::double bx, (p_size%7-3)::double/6.0::double by_,
  ((p_partkey//7)%7-3)::double/6.0::double bz, (['fcc','bcc','hcp','cubic_diamond','sc','hex_diamond'])[p_partkey%6+1] structure from part""",
    "dv_nodes": """select *, edge_count%4=0 is_dangling, edge_count%3=0 is_blocked from (
  select o_orderkey segment_id, 'fwd' side, o_custkey::bigint ring_id, (3+o_orderkey%11)::int edge_count from orders union all
  select o_orderkey, 'bwd', ((o_orderkey*31)%1500)::bigint, (3+o_orderkey%7)::int from orders)""",
    "dv_both": "select v1 v, v2 nbr from dv_edges union all select v2, v1 from dv_edges",
}
ORDER = list(SQL)
NEEDS = {"dv_edges": ["dv_tets"], "dv_facets": ["dv_cells"], "dv_near": ["dv_facets", "dv_cells"], "dv_both": ["dv_edges", "dv_tets"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL of body with the named views (and those they need) in front."""
    wanted: set[str] = set()
    for n in names.split():
        wanted |= {n, *NEEDS.get(n, [])}
        for m in NEEDS.get(n, []):
            wanted |= set(NEEDS.get(m, []))
    parts = [f"{n} as materialized ({SQL[n]})" for n in ORDER if n in wanted]
    body = body.strip()
    if body.startswith("with "):
        parts.append(body[5:])
        text = ",\n".join(parts)
    else:
        text = ",\n".join(parts) + "\n" + body
    return f"with {'recursive ' if recursive else ''}{text}"
