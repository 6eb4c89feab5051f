"""Imaging views derived from the test tables, on Spark and as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

MARKERS = ["NeuN", "S100", "Olig2", "Iba1", "RECA1"]
_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Base tables and derived views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def cells(self) -> DataFrame:
        """Box table; ``slide`` keeps the density of an image constant as data grows."""
        return (
            self.orders.selectExpr(
                "o_orderkey + 1 AS ID",
                "CAST(FLOOR(o_orderkey / 15000.0) AS BIGINT) AS slide",
                "(o_orderkey * 7919) % 4000 + 50 AS xmin",
                "(o_orderkey * 104729 + o_custkey * 31) % 3000 + 50 AS ymin",
            )
            .withColumn("xmax", F.expr("xmin + 12 + ID % 19"))
            .withColumn("ymax", F.expr("ymin + 12 + (ID * 3) % 17"))
            .selectExpr(
                "slide", "ID", "CAST(FLOOR((xmin + xmax) / 2.0) AS BIGINT) AS centroid_x",
                "CAST(FLOOR((ymin + ymax) / 2.0) AS BIGINT) AS centroid_y", "xmin", "ymin", "xmax", "ymax",
            )
        )

    @cached_property
    def features(self) -> DataFrame:
        mods = {"NeuN": (911, 0), "S100": (613, 7), "Olig2": (389, 3), "Iba1": (277, 1), "RECA1": (131, 5)}
        return self.orders.selectExpr(
            "o_orderkey + 1 AS ID",
            *(f"CAST((o_orderkey * {m} + {a}) % 1000 AS DOUBLE) / 1000.0 AS {n}" for n, (m, a) in mods.items()),
        )

    @cached_property
    def channel_info(self) -> DataFrame:
        return self.region.selectExpr(
            "CASE r_regionkey WHEN 0 THEN 'NeuN' WHEN 1 THEN 'S100' WHEN 2 THEN 'Olig2' WHEN 3 THEN 'Iba1' ELSE 'RECA1' END AS Biomarker",
            "concat('R1C', CAST(r_regionkey + 1 AS STRING), '.tif') AS Channel",
            "CASE WHEN r_regionkey = 4 THEN NULL ELSE 0.5D + CAST(r_regionkey AS DOUBLE) / 10.0D END AS Threshold",
        )

    @cached_property
    def regions(self) -> DataFrame:
        return self.nation.where("n_nationkey % 6 <> 5").selectExpr(
            "n_name AS region", "CAST(n_nationkey AS BIGINT) AS list_order",
            "CAST((n_nationkey % 5) * 800 AS BIGINT) AS x0", "CAST((n_nationkey % 5) * 800 + 859 AS BIGINT) AS x1",
            "CAST(FLOOR(n_nationkey / 5.0) AS BIGINT) * 600 AS y0",
            "CAST(FLOOR(n_nationkey / 5.0) AS BIGINT) * 600 + 649 AS y1",
        )

    @cached_property
    def gt(self) -> DataFrame:
        return self.customer.selectExpr(
            "c_custkey AS gt_id", "CAST(FLOOR(c_custkey / 25.0) AS BIGINT) AS image_id",
            "CAST(c_nationkey % 3 AS BIGINT) AS class_id",
            "CAST((c_custkey * 37) % 400 AS DOUBLE) AS ymin", "CAST((c_custkey * 53) % 400 AS DOUBLE) AS xmin",
            "CAST((c_custkey * 37) % 400 + 20 + c_custkey % 13 AS DOUBLE) AS ymax",
            "CAST((c_custkey * 53) % 400 + 20 + c_custkey % 11 AS DOUBLE) AS xmax",
            "c_custkey % 17 = 0 AS difficult", "c_custkey % 23 = 0 AS group_of",
        )

    @cached_property
    def det(self) -> DataFrame:
        return self.orders.join(self.gt, F.col("o_custkey") == F.col("gt_id")).selectExpr(
            "o_orderkey AS det_id", "image_id",
            "CASE WHEN o_orderkey % 11 = 0 THEN (class_id + 1) % 3 ELSE class_id END AS class_id",
            "CAST((o_orderkey * 7907) % 100003 AS DOUBLE) / 100003.0D AS score",
            "ymin + (o_orderkey % 9 - 4) AS ymin", "xmin + (o_orderkey % 7 - 3) AS xmin",
            "ymax + (o_orderkey % 5 - 2) AS ymax", "xmax + (o_orderkey % 13 - 6) AS xmax",
        )

    @cached_property
    def edges(self) -> DataFrame:
        n, s = self.nation, self.supplier
        return (
            n.selectExpr("concat('R', n_regionkey) AS parent", "concat('N', n_nationkey) AS child")
            .unionAll(
                n.where("n_nationkey % 7 = 0").selectExpr(
                    "concat('R', (n_regionkey + 1) % 5)", "concat('N', n_nationkey)"
                )
            )
            .unionAll(s.selectExpr("concat('N', s_nationkey)", "concat('S', s_suppkey)"))
        )

    @cached_property
    def raster(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v")).selectExpr(
            "vec_id AS y", "CAST(pos AS BIGINT) AS x",
            "CAST(FLOOR((CAST(v AS DOUBLE) + 1.0D) * 1000.0D) AS BIGINT) AS value",
        )

    @cached_property
    def relations(self) -> DataFrame:
        """Ground-truth relation tuples: neighbours ``gt_id`` and ``gt_id + 1`` of one image."""
        a, b = self.gt.alias("a"), self.gt.alias("b")
        return a.join(b, F.expr("a.image_id = b.image_id AND b.gt_id = a.gt_id + 1")).selectExpr(
            "a.gt_id AS gt_id", "a.image_id AS image_id", "a.class_id AS subject_label", "b.class_id AS object_label",
            "a.gt_id % 3 AS relation",
            "named_struct('xmin', a.xmin, 'ymin', a.ymin, 'xmax', a.xmax, 'ymax', a.ymax) AS subject",
            "named_struct('xmin', b.xmin, 'ymin', b.ymin, 'xmax', b.xmax, 'ymax', b.ymax) AS object",
        )

    @cached_property
    def relation_det(self) -> DataFrame:
        """Shifted copies of the relation tuples, one per order of the customer."""
        o = self.orders.alias("o")
        k = "o.o_orderkey"
        move = (
            "named_struct('xmin', r.{0}.xmin + {k} % 5 - 2, 'ymin', r.{0}.ymin + {k} % 3 - 1,"
            " 'xmax', r.{0}.xmax + {k} % 7 - 3, 'ymax', r.{0}.ymax + {k} % 4 - 1) AS {0}"
        )
        return o.join(self.relations.alias("r"), F.expr("o.o_custkey = r.gt_id")).selectExpr(
            f"{k} AS det_id", "r.image_id AS image_id", "r.subject_label AS subject_label",
            f"CASE WHEN {k} % 13 = 0 THEN (r.object_label + 1) % 3 ELSE r.object_label END AS object_label",
            "r.relation AS relation", f"CAST(({k} * 7907) % 100003 AS DOUBLE) / 100003.0D AS score",
            move.format("subject", k=k), move.format("object", k=k),
        )


_F = {n: f"CAST((o_orderkey * {m} + {a}) % 1000 AS DOUBLE) / 1000.0 AS {n}"
      for n, m, a in (("NeuN", 911, 0), ("S100", 613, 7), ("Olig2", 389, 3), ("Iba1", 277, 1), ("RECA1", 131, 5))}

VIEW_SQL = {
    "cells": """SELECT slide, ID, CAST(FLOOR((xmin + xmax) / 2.0) AS BIGINT) AS centroid_x,
       CAST(FLOOR((ymin + ymax) / 2.0) AS BIGINT) AS centroid_y, xmin, ymin, xmax, ymax
FROM (SELECT slide, ID, xmin, ymin, xmin + 12 + ID % 19 AS xmax, ymin + 12 + (ID * 3) % 17 AS ymax
      FROM (SELECT o_orderkey + 1 AS ID, CAST(FLOOR(o_orderkey / 15000.0) AS BIGINT) AS slide,
                   (o_orderkey * 7919) % 4000 + 50 AS xmin,
                   (o_orderkey * 104729 + o_custkey * 31) % 3000 + 50 AS ymin FROM orders) a) b""",
    "features": "SELECT o_orderkey + 1 AS ID, " + ", ".join(_F.values()) + " FROM orders",
    "channel_info": """SELECT CASE r_regionkey WHEN 0 THEN 'NeuN' WHEN 1 THEN 'S100' WHEN 2 THEN 'Olig2' WHEN 3 THEN 'Iba1' ELSE 'RECA1' END AS Biomarker,
       'R1C' || CAST(r_regionkey + 1 AS VARCHAR(10)) || '.tif' AS Channel,
       CASE WHEN r_regionkey = 4 THEN NULL ELSE 0.5::DOUBLE + CAST(r_regionkey AS DOUBLE) / 10.0 END AS Threshold FROM region""",
    "regions": """SELECT n_name AS region, CAST(n_nationkey AS BIGINT) AS list_order,
       CAST((n_nationkey % 5) * 800 AS BIGINT) AS x0, CAST((n_nationkey % 5) * 800 + 859 AS BIGINT) AS x1,
       CAST(FLOOR(n_nationkey / 5.0) AS BIGINT) * 600 AS y0, CAST(FLOOR(n_nationkey / 5.0) AS BIGINT) * 600 + 649 AS y1
FROM nation WHERE n_nationkey % 6 <> 5""",
    "gt": """SELECT c_custkey AS gt_id, CAST(FLOOR(c_custkey / 25.0) AS BIGINT) AS image_id, CAST(c_nationkey % 3 AS BIGINT) AS class_id,
       CAST((c_custkey * 37) % 400 AS DOUBLE) AS ymin, CAST((c_custkey * 53) % 400 AS DOUBLE) AS xmin,
       CAST((c_custkey * 37) % 400 + 20 + c_custkey % 13 AS DOUBLE) AS ymax,
       CAST((c_custkey * 53) % 400 + 20 + c_custkey % 11 AS DOUBLE) AS xmax,
       c_custkey % 17 = 0 AS difficult, c_custkey % 23 = 0 AS group_of FROM customer""",
    "det": """SELECT o_orderkey AS det_id, g.image_id,
       CASE WHEN o_orderkey % 11 = 0 THEN (g.class_id + 1) % 3 ELSE g.class_id END AS class_id,
       CAST((o_orderkey * 7907) % 100003 AS DOUBLE) / 100003.0 AS score,
       g.ymin + (o_orderkey % 9 - 4) AS ymin, g.xmin + (o_orderkey % 7 - 3) AS xmin,
       g.ymax + (o_orderkey % 5 - 2) AS ymax, g.xmax + (o_orderkey % 13 - 6) AS xmax
FROM orders JOIN gt g ON o_custkey = g.gt_id""",
    "edges": """SELECT 'R' || CAST(n_regionkey AS VARCHAR(10)) AS parent, 'N' || CAST(n_nationkey AS VARCHAR(10)) AS child FROM nation
UNION ALL SELECT 'R' || CAST((n_regionkey + 1) % 5 AS VARCHAR(10)), 'N' || CAST(n_nationkey AS VARCHAR(10)) FROM nation WHERE n_nationkey % 7 = 0
UNION ALL SELECT 'N' || CAST(s_nationkey AS VARCHAR(10)), 'S' || CAST(s_suppkey AS VARCHAR(10)) FROM supplier""",
    "raster": """SELECT vec_id AS y, CAST(pos - 1 AS BIGINT) AS x, CAST(FLOOR((CAST(v AS DOUBLE) + 1.0) * 1000.0) AS BIGINT) AS value
FROM (SELECT vec_id, UNNEST(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) t""",
    "relations": """SELECT a.gt_id, a.image_id, a.class_id AS subject_label, b.class_id AS object_label, a.gt_id % 3 AS relation,
       a.xmin AS sx0, a.ymin AS sy0, a.xmax AS sx1, a.ymax AS sy1, b.xmin AS ox0, b.ymin AS oy0, b.xmax AS ox1, b.ymax AS oy1
FROM gt a JOIN gt b ON a.image_id = b.image_id AND b.gt_id = a.gt_id + 1""",
    "relation_det": """SELECT o_orderkey AS det_id, image_id, subject_label,
       CASE WHEN o_orderkey % 13 = 0 THEN (object_label + 1) % 3 ELSE object_label END AS object_label, relation,
       CAST((o_orderkey * 7907) % 100003 AS DOUBLE) / 100003.0 AS score,
       sx0 + o_orderkey % 5 - 2 AS sx0, sy0 + o_orderkey % 3 - 1 AS sy0, sx1 + o_orderkey % 7 - 3 AS sx1, sy1 + o_orderkey % 4 - 1 AS sy1,
       ox0 + o_orderkey % 5 - 2 AS ox0, oy0 + o_orderkey % 3 - 1 AS oy0, ox1 + o_orderkey % 7 - 3 AS ox1, oy1 + o_orderkey % 4 - 1 AS oy1
FROM orders JOIN relations ON o_custkey = relations.gt_id""",
}
_NEEDS = {"det": ["gt"], "relations": ["gt"], "relation_det": ["relations"]}


def with_views(sql: str, views, recursive: bool = False) -> str:
    """Prefix ``sql`` with the definitions of the views it uses.

    ``sql`` may itself start with ``WITH``; its definitions are appended.
    """
    names: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in names:
            names.append(name)

    for v in views:
        add(v)
    body = sql.strip()
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names]
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = True, body[len("WITH RECURSIVE "):]
        head = ", ".join(parts) + (", " if parts else "")
    elif body.upper().startswith("WITH "):
        body = body[len("WITH "):]
        head = ", ".join(parts) + (", " if parts else "")
    else:
        if not parts:
            return body
        head = ", ".join(parts) + " "
    return ("WITH RECURSIVE " if recursive else "WITH ") + head + body
