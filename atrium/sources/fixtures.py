"""Scene tables derived from the supplied Parquet tables, lazily and column-pruned."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

D = "CAST({} AS DOUBLE)".format


class Tables:
    """The supplied tables of one folder and the scene tables computed from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        df = self.raw("orders").selectExpr(
            "o_orderkey % 4 AS scene_id",
            "o_orderkey AS frame_id",
            "concat('frame_', lpad(CAST(o_orderkey AS STRING), 6, '0'), '.png') AS name",
            "CAST(o_custkey % 20 AS DOUBLE) AS tx",
            "CAST(floor(o_custkey / 20.0) AS DOUBLE) AS ty",
            f"{D('1.5')} AS tz",
            "CAST(o_orderkey % 4 AS INT) AS yaw_quarter",
            "o_orderdate AS captured_at",
        )
        turn = "CAST(element_at(array({}), yaw_quarter + 1) AS DOUBLE)"
        cos, sin = turn.format("1, 0, -1, 0"), turn.format("0, 1, 0, -1")
        return df.withColumn(
            "c2w",
            F.expr(
                f"array(array({cos}, -{sin}, 0D, tx), array({sin}, {cos}, 0D, ty),"
                " array(0D, 0D, 1D, tz), array(0D, 0D, 0D, 1D))"
            ),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey % 4 AS scene_id",
            "l_orderkey AS frame_id",
            "CAST(l_linenumber * 60 + l_suppkey % 60 AS INT) AS pix_row",
            "CAST(l_partkey % 800 AS INT) AS pix_col",
            "CASE WHEN l_discount = 0 THEN 0D ELSE l_extendedprice / 5000 END AS depth",
            "CAST(l_partkey % 133 AS INT) AS coco_id",
            "l_quantity AS weight",
        )

    @cached_property
    def vertices(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey % 2 AS scene_id",
            "p_partkey AS vertex_id",
            f"p_size * {D('0.4')} AS x",
            f"(p_retailprice - 900) * {D('0.2')} AS y",
            f"(p_partkey % 30) * {D('0.1')} AS z",
            "CAST(p_partkey % 97 AS INT) AS segment_id",
        )

    @cached_property
    def rays(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_suppkey % 2 AS scene_id",
            "l_partkey AS hint_vertex",
            f"l_quantity * {D('0.4')} AS x",
            "l_extendedprice / 5250 AS y",
            "l_discount * 30 AS z",
            "CAST(l_suppkey % 9 AS INT) AS label",
        )

    @cached_property
    def quads(self) -> DataFrame:
        part = self.raw("part")
        total = part.agg(F.count("*").alias("total"))  # one row
        return (
            part.join(F.broadcast(total))
            .filter("p_partkey % 50 < 49 AND p_partkey + 50 < total AND p_size > 5")
            .selectExpr("p_partkey AS v")
        )

    @cached_property
    def triangles(self) -> DataFrame:
        pair = self.quads.selectExpr(
            "0L AS scene_id",
            "CAST(floor(v / 500.0) AS INT) AS polygon_id",
            "inline(array(struct(v * 2 AS triangle_id, v AS v0, v + 1 AS v1, v + 50 AS v2),"
            " struct(v * 2 + 1 AS triangle_id, v + 1 AS v0, v + 51 AS v1, v + 50 AS v2)))",
        )
        return pair.select("scene_id", "triangle_id", "v0", "v1", "v2", "polygon_id")

    @cached_property
    def mesh_vertices(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "0L AS scene_id",
            "p_partkey AS vertex_id",
            f"(p_partkey % 50) * {D('0.1')} AS x",
            f"floor(p_partkey / 50.0) * {D('0.1')} AS y",
            f"floor(p_partkey / 500.0) * {D('0.5')} AS z",
        )

    @cached_property
    def cells(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "CAST(floor(p_partkey / 1000.0) AS INT) AS level_id",
            "CAST(floor(p_partkey / 50.0) AS INT) AS r",
            "CAST(p_partkey % 50 AS INT) AS c",
            "p_size > 8 AS free",
            "CASE WHEN p_size > 8 THEN CAST(1 + floor((p_partkey % 50) / 13.0)"
            " + 4 * floor(p_partkey / 500.0) AS INT) ELSE 0 END AS label",
        )

    @cached_property
    def rooms(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "n_nationkey AS room_key",
            "n_regionkey AS level_key",
            "format_string('level_%d_room_%03d', n_regionkey, n_nationkey) AS room_id",
            "CAST(n_nationkey % 5 AS DOUBLE) * 4 AS x0",
            "CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 4 AS y0",
            "CAST(n_nationkey % 5 AS DOUBLE) * 4 + 4 AS x1",
            "CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 4 + 4 AS y1",
        )

    @cached_property
    def ceilings(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS polygon_id",
            "CAST(s_suppkey % 10 AS DOUBLE) * 2 AS x0",
            "CAST(floor((s_suppkey % 100) / 10.0) AS DOUBLE) * 2 AS y0",
            "CAST(s_suppkey % 10 AS DOUBLE) * 2 + 3 AS x1",
            "CAST(floor((s_suppkey % 100) / 10.0) AS DOUBLE) * 2 + 3 AS y1",
            f"(s_suppkey % 3) * {D('0.02')} AS a",
            f"(s_suppkey % 4) * {D('0.01')} AS b",
            "1D AS c",
            f"-({D('2.4')} + (s_nationkey % 5) * {D('0.1')}) AS d",
        )

    @cached_property
    def walls(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS wall_id",
            "CAST(c_nationkey % 5 AS DOUBLE) * 4 AS wx",
            "CAST(floor(c_nationkey / 5.0) AS DOUBLE) * 4 AS wy",
            "c_acctbal / 5000 AS z_min",
            f"c_acctbal / 5000 + {D('1.5')} AS z_max",
        )

    @cached_property
    def evidence(self) -> DataFrame:
        return self.raw("embeddings").selectExpr(
            "vec_id AS point_id",
            "CAST(embedding[0] AS DOUBLE) AS u",
            "CAST(embedding[1] AS DOUBLE) AS z",
            "label AS wall_id",
        )

    @cached_property
    def frame_events(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS record_index",
            "ts",
            "user_id AS scene_id",
            "event_type AS layout_name",
            "value AS depth_mean",
        )
