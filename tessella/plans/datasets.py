"""Queries on sources, sinks, annotation data sets, scoring and streams.

Source queries write files derived from the tables to the shared folder and read
them back with the reader under test.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import boxes as fb, scoring as sc
from ..functions.boxes import Box
from ..operators import datasets as ds, evaluation as ev, overlap as ov, phenotype as ph
from ..runtime import scratch_path
from ..sources import annotations as an, tables as tb
from ..streaming import evaluate as st
from .evaluation import AP_SELECT, FLAGGED, GT_DET, SIMPLE, SMALL, sql_curve, sql_inter, sql_iou
from .fixtures import MARKERS
from .phenotype import GATED, gated
from .raster import CHANNELS, FILES, channels, files
from .registry import query

BOX_COLS = ["ID", "centroid_x", "centroid_y", "xmin", "ymin", "xmax", "ymax"]


def path(t, name):
    return scratch_path(t.spark, name)


# ----------------------------------------------------------------------- sources


@query("scan_box_table", "SELECT ID, centroid_x, centroid_y, xmin, ymin, xmax, ymax FROM cells", ["cells"])
def _(t):
    p = path(t, "boxes")
    t.cells.select(*BOX_COLS).write.csv(p, sep="\t", header=True)
    return tb.read_box_table(t.spark, p)


@query(
    "scan_marker_table",
    "SELECT * FROM (UNPIVOT (SELECT ID, NeuN, S100, Olig2, Iba1, RECA1 FROM features) ON NeuN, S100, Olig2, Iba1, RECA1 INTO NAME biomarker VALUE value)",
    ["features"],
)
def _(t):
    p = path(t, "features")
    tb.write_table(t.features, p)
    return tb.read_marker_table(t.spark, p, long=True).select("ID", "biomarker", "value")


@query(
    "scan_channel_script",
    f"WITH {FILES} SELECT DISTINCT filename, CASE WHEN filename LIKE '%C5.tif' THEN 'No' ELSE 'Yes' END AS correction, NULL::VARCHAR AS level, NULL::VARCHAR AS structure, 1200::BIGINT AS xmin FROM files",
)
def _(t):
    from ..operators.registration import make_channel_script

    p = path(t, "script")
    make_channel_script(files(t), (1200, 700, 5200, 3700), 5).drop("level").write.csv(p, header=True)
    s = tb.read_channel_script(t.spark, p)
    return s.select("filename", F.col("intra channel correction").alias("correction"), "level", "structure", "xmin")


@query(
    "scan_rule_table",
    "SELECT ROW_NUMBER() OVER (ORDER BY p_partkey % 2, p_partkey) AS rule_order, p_partkey % 2 AS sheet, p_name AS type, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS NeuN FROM part",
)
def _(t):
    from ..functions.pixels import rule_token

    token = "CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '' END AS NeuN"
    sheets = []
    for i in range(2):
        p = path(t, f"sheet{i}")
        t.part.where(f"p_partkey % 2 = {i}").orderBy("p_partkey").selectExpr("p_name AS Type", token).write.csv(p, header=True)
        sheets.append(p)
    r = tb.read_rule_table(t.spark, sheets)
    return r.select("rule_order", F.col("sheet").cast("long").alias("sheet"), F.col("Type").alias("type"), rule_token(F.col("NeuN")).alias("NeuN"))


def crop_table(t):
    c = ds.crop_objects(t.cells, 300, 250, 3100, 4100)
    return c.withColumns({"id": F.col("ID"), "class": F.lit("Nucleus")})


_CROPS = """k AS (SELECT ky * 250 AS corner_y, kx * 250 AS corner_x FROM (SELECT CAST(UNNEST(RANGE(13)) AS BIGINT) AS ky), (SELECT CAST(UNNEST(RANGE(17)) AS BIGINT) AS kx)),
l AS (SELECT slide, ID, corner_x, corner_y, xmin - corner_x AS x0, ymin - corner_y AS y0, xmax - corner_x AS x1, ymax - corner_y AS y1 FROM cells, k
 WHERE centroid_x > corner_x AND centroid_x < corner_x + 300 AND centroid_y > corner_y AND centroid_y < corner_y + 300),
f AS (SELECT *, x0 < 0 OR y0 < 0 OR x1 > 300 OR y1 > 300 AS c FROM l),
crops AS (SELECT slide, ID, corner_x, corner_y, CAST(c AS INT) AS truncated, CASE WHEN c THEN LEAST(GREATEST(x0, 1), 299) ELSE x0 END AS xmin, CASE WHEN c THEN LEAST(GREATEST(y0, 1), 299) ELSE y0 END AS ymin,
 CASE WHEN c THEN LEAST(GREATEST(x1, 1), 299) ELSE x1 END AS xmax, CASE WHEN c THEN LEAST(GREATEST(y1, 1), 299) ELSE y1 END AS ymax FROM f)"""
_NAMED = "CAST(slide AS VARCHAR) || '_' || LPAD(CAST(corner_x AS VARCHAR), 5, '0') || '_' || LPAD(CAST(corner_y AS VARCHAR), 5, '0') || '.jpeg' AS filename"


@query("build_crops_dataset", f"WITH {_CROPS} SELECT slide, ID, corner_x, corner_y, truncated, xmin, ymin, xmax, ymax FROM crops", ["cells"])
def _(t):
    return crop_table(t).select("slide", "ID", "corner_x", "corner_y", "truncated", "xmin", "ymin", "xmax", "ymax")


@query("scan_voc_xml", f"WITH {_CROPS} SELECT {_NAMED}, 300::BIGINT AS width, 300::BIGINT AS height, 'Nucleus' AS class, truncated, xmin, ymin, xmax, ymax FROM crops", ["cells"])
def _(t):
    p = path(t, "xml")
    an.write_voc_xml(crop_table(t), p, on=["slide"])
    return an.read_voc_xml(t.spark, p).select("filename", "width", "height", "class", "truncated", "xmin", "ymin", "xmax", "ymax")


@query("sink_voc_xml", f"WITH {_CROPS} SELECT CAST(slide AS VARCHAR) || '_' || LPAD(CAST(corner_x AS VARCHAR), 5, '0') || '_' || LPAD(CAST(corner_y AS VARCHAR), 5, '0') AS crop, COUNT(*) AS objects FROM crops GROUP BY slide, corner_x, corner_y", ["cells"])
def _(t):
    docs = an.crop_documents(crop_table(t), on=["slide"])
    return docs.groupBy("crop").agg(F.sum(F.size(F.split("value", "<object>")) - 1).alias("objects"))


@query("sink_labels_csv", f"WITH {_CROPS} SELECT {_NAMED}, 'Nucleus' AS class, xmin, ymax FROM crops", ["cells"])
def _(t):
    p, q = path(t, "xml"), path(t, "labels")
    an.write_voc_xml(crop_table(t), p, on=["slide"])
    tb.write_table(an.read_voc_xml(t.spark, p).select("filename", "width", "height", "class", "xmin", "ymin", "xmax", "ymax"), q)
    back = t.spark.read.csv(q, header=True)
    return back.select("filename", "class", F.col("xmin").cast("long").alias("xmin"), F.col("ymax").cast("long").alias("ymax"))


@query(
    "scan_dataset_xml",
    "SELECT s_name AS biomarker, 'R1C' || CAST(s_suppkey AS VARCHAR) || '.tif' AS FileName, s_suppkey % 7 / 10.0::DOUBLE AS red FROM supplier",
)
def _(t):
    p = path(t, "dataset")
    doc = F.struct(F.col("s_name").alias("_biomarker"), F.format_string("[%.1f,0.5,1]", F.col("s_suppkey") % 7 / 10).alias("_ImgColor"), F.format_string("R1C%d.tif", "s_suppkey").alias("FileName"))
    t.supplier.select(F.to_xml(doc, {"rowTag": "Image"}).alias("value")).write.text(p)
    d = an.read_dataset_xml(t.spark, p)
    color = F.split(F.regexp_extract("ImgColor", r"\[(.*)\]", 1), ",").cast("array<double>")
    return d.select("biomarker", "FileName", color[0].alias("red"))


@query(
    "scan_file_index",
    "SELECT DISTINCT (n_nationkey // 5 + 1)::BIGINT AS round, (n_nationkey % 5 + 1)::BIGINT AS channel, (o_orderkey // 100) % 9 * 300 AS corner_x FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
)
def _(t):
    p = path(t, "images")
    rows = t.nation.join(t.customer, F.expr("c_nationkey = n_nationkey")).join(t.orders, F.expr("o_custkey = c_custkey"))
    rows.selectExpr(
        "concat('R', n_nationkey DIV 5 + 1, 'C', n_nationkey % 5 + 1, '.tif') AS image", "lpad((o_orderkey DIV 100) % 9 * 300, 5, '0') AS corner", "CAST(o_orderkey AS STRING) AS value"
    ).write.partitionBy("image", "corner").text(p)
    index = tb.file_index(t.spark, p, "*.txt").select(F.regexp_replace(F.element_at(F.split("path", "image="), 2), "/corner=", "_").alias("filename"))
    parsed = tb.image_index(index).withColumn("corner_x", F.regexp_extract("filename", r"_(\d{5})/", 1).cast("long"))
    return parsed.select(F.col("round").cast("long").alias("round"), F.col("channel").cast("long").alias("channel"), "corner_x").distinct()


@query("scan_class_folders", "SELECT n_name AS class, DENSE_RANK() OVER (ORDER BY n_name) - 1 AS class_id FROM nation")
def _(t):
    p = path(t, "classes")
    t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).select(F.col("n_name").alias("class"), F.col("c_name").alias("value")).union(
        t.nation.select("n_name", "n_comment") if "n_comment" in t.nation.columns else t.nation.select("n_name", F.col("n_name"))
    ).write.partitionBy("class").text(p)
    f = tb.class_folders(t.spark, p).where("NOT endswith(path, '_SUCCESS')")
    return f.select(F.regexp_replace("class", "%20", " ").alias("class"), "class_id").distinct()


@query("scan_voc_txt", "SELECT class_id::VARCHAR AS class, score, xmin, ymin, xmax, ymax FROM det", GT_DET)
def _(t):
    p = path(t, "voc")
    line = F.concat_ws(" ", "class_id", F.format_string("%.17g", "score"), "xmin", "ymin", F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    t.det.select(line.alias("value")).write.text(p)
    return an.read_voc_txt(t.spark, p, True).drop("image")


_OID = "'img' || CAST(image_id AS VARCHAR) AS ImageID, 'N' || CAST(gt_id % 25 AS VARCHAR) AS LabelName"


def oid_boxes(t):
    return t.gt.selectExpr(
        "concat('img', image_id) AS ImageID", "'human' AS Source", "concat('N', gt_id % 25) AS LabelName", "1.0D AS Confidence", "xmin / 512 AS XMin", "xmax / 512 AS XMax",
        "ymin / 512 AS YMin", "ymax / 512 AS YMax", "0 AS IsOccluded", "0 AS IsTruncated", "CAST(group_of AS INT) AS IsGroupOf", "0 AS IsDepiction", "0 AS IsInside",
    )


def oid_labels(t):
    return t.gt.selectExpr("concat('img', image_id) AS ImageID", "'human' AS Source", "CASE WHEN gt_id % 4 = 0 THEN concat('R', gt_id % 5) ELSE concat('N', gt_id % 25) END AS LabelName", "CAST(gt_id % 3 <> 0 AS DOUBLE) AS Confidence")


@query("scan_oid_predictions", "SELECT 'img' || CAST(image_id AS VARCHAR) AS image_id, 'N' || CAST(class_id AS VARCHAR) AS label, ROUND(score, 6) AS score, xmin, ymax FROM det", GT_DET)
def _(t):
    p = path(t, "oid_predictions")
    t.det.selectExpr(
        "concat('img', image_id) AS ImageID", "concat('N', class_id) AS LabelName", "score AS Score", "xmin AS XMin", "xmax AS XMax", "ymin AS YMin", "ymax AS YMax"
    ).write.csv(p, header=True)
    return an.read_oid_predictions(t.spark, p).select("image_id", "label", F.round("score", 6).alias("score"), "xmin", "ymax")


@query(
    "scan_oid_relations",
    """SELECT 'img' || CAST(image_id AS VARCHAR) AS image_id, 'N' || CAST(subject_label AS VARCHAR) AS label, 'N' || CAST(object_label AS VARCHAR) AS other, 'is' || CAST(relation AS VARCHAR) AS relation, sx0 AS x0, oy1 AS y1 FROM relations
UNION ALL SELECT 'img' || CAST(image_id AS VARCHAR), 'N' || CAST(class_id AS VARCHAR), NULL, NULL, CAST(gt_id % 2 AS DOUBLE), NULL FROM gt""",
    ["relations", "gt"],
)
def _(t):
    p = path(t, "oid_relations")
    corners = [f"{part}.{c.lower()} AS {c}{n}" for n, part in ((1, "subject"), (2, "object")) for c in ("XMin", "XMax", "YMin", "YMax")]
    rows = t.relations.selectExpr(
        "concat('img', image_id) AS ImageID", "concat('N', subject_label) AS LabelName1", "concat('N', object_label) AS LabelName2", *corners,
        "concat('is', relation) AS RelationshipLabel", "CAST(NULL AS STRING) AS LabelName", "CAST(NULL AS DOUBLE) AS Confidence",
    )
    labels = t.gt.selectExpr("concat('img', image_id) AS ImageID", "concat('N', class_id) AS LabelName", "CAST(gt_id % 2 AS DOUBLE) AS Confidence")
    rows.unionByName(labels, allowMissingColumns=True).write.csv(p, header=True)
    relations, back = an.read_oid_relations(t.spark, p)
    first = relations.select("image_id", F.col("subject_label").alias("label"), F.col("object_label").alias("other"), "relation", F.col("subject.xmin").alias("x0"), F.col("object.ymax").alias("y1"))
    return first.unionByName(back.select("image_id", "label", F.col("confidence").alias("x0")), allowMissingColumns=True)


@query(
    "scan_oid_csv",
    f"SELECT {_OID}, NULL::DOUBLE AS ConfidenceImageLabel, ROUND(xmin / 512, 6) AS XMin FROM gt UNION ALL SELECT 'img' || CAST(image_id AS VARCHAR), CASE WHEN gt_id % 4 = 0 THEN 'R' || CAST(gt_id % 5 AS VARCHAR) ELSE 'N' || CAST(gt_id % 25 AS VARCHAR) END, CAST(gt_id % 3 <> 0 AS DOUBLE), NULL FROM gt",
    ["gt"],
)
def _(t):
    p, q = path(t, "oid_boxes"), path(t, "oid_labels")
    oid_boxes(t).write.csv(p, header=True)
    oid_labels(t).write.csv(q, header=True)
    both = an.merge_oid(an.read_oid_boxes(t.spark, p), an.read_oid_labels(t.spark, q))
    return both.select("ImageID", "LabelName", "ConfidenceImageLabel", F.round("XMin", 6).alias("XMin"))


_COCO_GT = "SELECT gt_id AS id, image_id, class_id AS category_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, ROUND((xmax - xmin) * (ymax - ymin), 4) AS area, CAST(group_of AS INT) AS iscrowd FROM gt"


def _coco_flat(df):
    return df.select("id", "image_id", "category_id", *(F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")), "area", "iscrowd")


def coco_rows(t):
    return an.coco_annotations(t.gt.withColumn("is_crowd", F.col("group_of")))


@query("scan_coco_json", _COCO_GT, ["gt"])
def _(t):
    # one document per thousand images, as the tools export subsets
    p = path(t, "coco")
    chunked = coco_rows(t).withColumn("chunk", F.floor(F.col("image_id") / 1000))
    rows = an.nested(chunked, ["chunk"], {"image_id": F.col("image_id"), **{c: F.col(c) for c in ("category_id", "bbox", "area", "iscrowd")}}, "id", "annotations")
    rows.select("chunk", F.to_json(F.struct("annotations")).alias("value")).write.partitionBy("chunk").text(p)
    return _coco_flat(an.read_coco(t.spark, p)["annotations"])


@query("sink_coco_json", _COCO_GT, ["gt"])
def _(t):
    p = path(t, "coco_lines")
    an.write_json_lines(coco_rows(t), p)
    return _coco_flat(an.read_coco_lines(t.spark, p))


@query("scan_kitti_txt", "SELECT 'class' || CAST(class_id AS VARCHAR) AS type, CAST(gt_id % 3 AS INT) AS occluded, xmin AS left, ymin AS top, xmax AS right, ymax AS bottom FROM gt", ["gt"])
def _(t):
    p = path(t, "kitti")
    line = F.concat_ws(
        " ", F.concat(F.lit("Class"), F.col("class_id").cast("string")), F.lit("0.0"), (F.col("gt_id") % 3).cast("string"), F.lit("0.5"),
        "xmin", "ymin", "xmax", "ymax", *(F.lit(str(float(i))) for i in range(7)),
    )
    t.gt.select(line.alias("value")).write.text(p)
    return an.read_kitti(t.spark, p).select("type", "occluded", "left", "top", "right", "bottom")


@query(
    "scan_label_map",
    """WITH used AS (SELECT p_partkey * 2 + 2 AS id, p_name AS name FROM part), every AS (SELECT CAST(UNNEST(RANGE(0, (SELECT MAX(id) + 1 FROM used))) AS BIGINT) AS id)
SELECT e.id, COALESCE(u.name, CASE WHEN e.id = 0 THEN 'background' ELSE 'class_' || CAST(e.id AS VARCHAR) END) AS name FROM every e LEFT JOIN used u ON u.id = e.id""",
)
def _(t):
    p = path(t, "label_map")
    an.label_map_text(t.part.selectExpr("p_partkey * 2 + 2 AS id", "p_name AS name")).write.text(p)
    return an.read_label_map(t.spark, p, fill_gaps=True)


@query("scan_lookup_tsv", "SELECT 's' || CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def _(t):
    p = path(t, "lookup")
    t.supplier.selectExpr("concat('s', s_suppkey) AS key", "s_name AS name").write.csv(p, sep="\t")
    return tb.read_lookup(t.spark, p)


@query("scan_mask_array", "SELECT y, x, CASE WHEN value > 1150 THEN 1 + (y + x) % 7 ELSE 0 END AS label FROM raster WHERE value > 1150", ["raster"])
def _(t):
    p = path(t, "mask")
    line = t.raster.groupBy("y").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.expr("CASE WHEN value > 1150 THEN 1 + (y + x) % 7 ELSE 0 END AS v")))), lambda s: s["v"].cast("string")), ",").alias("value")
    )
    # one matrix for each band of 64 rows, as one file
    banded = line.withColumn("band", F.floor(F.col("y") / 64)).repartition("band").sortWithinPartitions("band", "y")
    banded.select("band", "value").write.partitionBy("band").text(p)
    return tb.read_mask_array(t.spark, p).select((F.col("band") * 64 + F.col("y")).alias("y"), "x", "label")


@query("scan_raster_tiles", f"WITH {CHANNELS} SELECT channel, y, x, value FROM ch", ["raster"])
def _(t):
    p = path(t, "tiles")
    tb.write_raster_tiles(channels(t), p, 32)
    return tb.read_raster_tiles(t.spark, p, 32).select("channel", "y", "x", "value")


@query(
    "scan_shards",
    """WITH n AS (SELECT s_suppkey % 4 + 2 AS k, 'part' || CAST(s_suppkey AS VARCHAR) AS base FROM supplier)
SELECT base || '@' || CAST(k AS VARCHAR) AS name, base || '-' || LPAD(CAST(i AS VARCHAR), 5, '0') || '-of-' || LPAD(CAST(k AS VARCHAR), 5, '0') AS shard FROM (SELECT *, UNNEST(RANGE(k)) AS i FROM n)""",
)
def _(t):
    return tb.shard_names(t.supplier.selectExpr("concat('part', s_suppkey, '@', s_suppkey % 4 + 2) AS name"))


# ------------------------------------------------------------------------- sinks


@query("sink_box_table", "SELECT ROW_NUMBER() OVER (ORDER BY xmin, ymin, ID) AS ID, centroid_x, centroid_y, xmin, ymin, xmax, ymax FROM cells", ["cells"])
def _(t):
    p = path(t, "boxes")
    tb.write_box_table(t.cells.withColumnRenamed("ID", "old"), p, [F.col("xmin"), F.col("ymin"), F.col("old")])
    return tb.read_box_table(t.spark, p)


@query("sink_marker_table", f"WITH {GATED} SELECT ID, NeuN::DOUBLE AS NeuN, RECA1::DOUBLE AS RECA1 FROM gated", ["features"])
def _(t):
    p = path(t, "classification")
    tb.write_table(ph.to_wide(ph.to_long(gated(t)), MARKERS), p)
    return tb.read_marker_table(t.spark, p).select("ID", "NeuN", "RECA1")


@query(
    "sink_coco_segments_keypoints",
    """WITH m AS (SELECT gt_id, image_id, class_id, UNNEST(RANGE(FLOOR(ymin / 8)::BIGINT, FLOOR(ymax / 8)::BIGINT + 1)) AS y, FLOOR(xmin / 8)::BIGINT AS x, FLOOR(xmax / 8)::BIGINT - FLOOR(xmin / 8)::BIGINT + 1 AS length FROM gt)
SELECT m.gt_id, m.image_id, m.class_id AS category_id, y, x, length, 2::BIGINT AS num_keypoints FROM m""",
    ["gt"],
)
def _(t):
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 8), F.floor(F.col(b) / 8)))
    px = t.gt.withColumn("y", span("ymin", "ymax")).withColumn("x", span("xmin", "xmax")).select("image_id", "gt_id", "y", "x")
    pts = t.gt.select("image_id", "gt_id", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(k < 2).alias("visible")) for k, (x, y) in enumerate((("xmin", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")))))))
    p, q = path(t, "segments"), path(t, "keypoints")
    an.write_json_lines(an.coco_segments(t.gt, px), p)
    an.write_json_lines(an.coco_keypoints(pts), q)
    seg = t.spark.read.schema("image_id long, gt_id long, category_id long, y long, x long, length long").json(p)
    kp = t.spark.read.schema("gt_id long, num_keypoints long").json(q)
    return seg.join(kp, "gt_id").select("gt_id", "image_id", "category_id", "y", "x", "length", "num_keypoints")


@query("sink_metrics_csv", SIMPLE + f"SELECT 'AP@0.5/class_' || CAST(class_id AS VARCHAR) AS metric, ap AS value FROM ({AP_SELECT})", GT_DET)
def _(t):
    from .evaluation import average_precision

    p = path(t, "metrics")
    rows = average_precision(t).select(F.concat(F.lit("AP@0.5/class_"), F.col("class_id").cast("string")).alias("metric"), F.col("ap").alias("value"))
    an.write_metrics(rows, p)
    return an.read_metrics(t.spark, p)


def records(t):
    return an.example_records(t.gt)


_RECORDS = "SELECT image_id, COUNT(*) AS n, CAST(SUM(gt_id * (xmin + 2 * ymax)) AS BIGINT) AS checksum FROM gt GROUP BY image_id"


def _checked(df):
    total = F.aggregate("objects", F.lit(0.0), lambda acc, o: acc + o["gt_id"] * (o["xmin"] + 2 * o["ymax"]))
    return df.withColumns({"n": F.size("objects").cast("long"), "checksum": total.cast("long")})


@query("agg_parent_group", _RECORDS, ["gt"])
def _(t):
    return _checked(records(t)).select("image_id", "n", "checksum")


@query(
    "sink_sharded_examples",
    f"WITH r AS ({_RECORDS}) SELECT image_id, n, checksum, (ROW_NUMBER() OVER (ORDER BY image_id) - 1) % 4 AS shard, NTILE(4) OVER (ORDER BY image_id) - 1 AS block FROM r",
    ["gt"],
)
def _(t):
    p, q = path(t, "examples"), path(t, "blocks")
    order = [F.col("image_id")]
    an.write_shards(records(t), p, 4, order)
    an.write_shards(records(t), q, 4, order, contiguous=True)
    a = _checked(tb.read_shards(t.spark, p)).select("image_id", "n", "checksum", F.col("shard").cast("long").alias("shard"))
    b = tb.read_shards(t.spark, q).select("image_id", F.col("shard").cast("long").alias("block"))
    return a.join(b, "image_id")


@query(
    "build_examples",
    "SELECT i.image_id, COUNT(g.gt_id) AS n, CAST(COALESCE(SUM(g.gt_id * (g.xmin + 2 * g.ymax)), 0) AS BIGINT) AS checksum FROM (SELECT DISTINCT o_custkey // 25 AS image_id FROM orders) i LEFT JOIN (SELECT * FROM gt WHERE class_id <> 2 AND NOT difficult) g ON g.image_id = i.image_id GROUP BY i.image_id",
    ["gt"],
)
def _(t):
    # keep two classes, look up their ids by name, attach to all images
    names = t.region.where("r_regionkey < 2").selectExpr("concat('class', r_regionkey) AS name", "CAST(r_regionkey + 1 AS BIGINT) AS id")
    named = t.gt.where("class_id <> 2 AND NOT difficult").withColumn("text", F.concat(F.lit("class"), F.col("class_id").cast("string")))
    rec = an.example_records(an.label_ids(named, names, "text"))
    images = t.orders.selectExpr("CAST(FLOOR(o_custkey / 25.0) AS BIGINT) AS image_id").distinct()
    return _checked(an.with_annotations(images, rec)).select("image_id", "n", "checksum")


@query("join_image_annotations", "SELECT COUNT(*) AS images_without_annotation FROM (SELECT DISTINCT o_orderkey % 3000 AS image_id FROM orders) WHERE image_id NOT IN (SELECT image_id FROM gt)", ["gt"])
def _(t):
    return an.count_missing(t.orders.selectExpr("o_orderkey % 3000 AS image_id").distinct(), t.gt)


@query("join_label_lookup", "SELECT c_custkey AS gt_id, n_nationkey AS class_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    named = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("gt_id"), F.col("n_name").alias("class"))
    lookup = t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return an.label_ids(named, lookup, "class").select("gt_id", "class_id")


@query("sink_label_file", "SELECT p_partkey AS id, p_name || ':x' AS name FROM part")
def _(t):
    p = path(t, "labels")
    an.write_label_file(t.part.selectExpr("p_partkey AS id", "concat(p_name, ':x') AS name"), p)
    return an.read_label_file(t.spark, p)


@query("sink_patch_dataset")
def _(t):
    from ..operators import patches
    from .raster import zones

    p = path(t, "patches")
    rows = t.embeddings.agg((F.max("vec_id") + 1).alias("n")).first()["n"]
    patches.extract(zones(t), channels(t), rows, 64, size=8).join(zones(t), "ID").write.parquet(p)
    return t.spark.read.parquet(p).select("ID", "channel", "xmin", "ymin", F.size("patch").alias("n"), F.round(F.aggregate("patch", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query(
    "join_patch_update",
    """WITH c AS (SELECT *, xmin // 500 * 500 AS kx, ymin // 500 * 500 AS ky FROM cells), crops AS (SELECT s_suppkey % 4 AS slide, s_suppkey % 8 * 500 AS kx, s_suppkey % 6 * 500 AS ky FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY ALL),
keep AS (SELECT slide, xmin, ymin, xmax, ymax FROM c WHERE NOT (xmin > kx + 50 AND ymin > ky + 50 AND xmax < kx + 450 AND ymax < ky + 450 AND EXISTS (SELECT 1 FROM crops k WHERE k.slide = c.slide AND k.kx = c.kx AND k.ky = c.ky))),
new AS (SELECT k.slide, k.kx + x0 AS xmin, k.ky + y0 AS ymin, k.kx + x0 + 20 AS xmax, k.ky + y0 + 20 AS ymax FROM crops k JOIN (SELECT p_partkey % 4 AS slide, p_partkey % 8 * 500 AS kx, p_partkey % 6 * 500 AS ky, p_partkey * 37 % 460 AS x0, p_partkey * 53 % 460 AS y0 FROM part) r USING (slide, kx, ky) WHERE x0 >= 50 AND y0 >= 50 AND x0 + 20 <= 450 AND y0 + 20 <= 450)
SELECT * FROM keep UNION SELECT * FROM new""",
    ["cells"],
)
def _(t):
    crops = t.supplier.where("s_suppkey % 3 = 0").selectExpr("s_suppkey % 4 AS slide", "s_suppkey % 8 * 500 AS corner_x", "s_suppkey % 6 * 500 AS corner_y").distinct()
    new = t.part.selectExpr(
        "p_partkey % 4 AS slide", "p_partkey % 8 * 500 AS corner_x", "p_partkey % 6 * 500 AS corner_y", "p_partkey * 37 % 460 AS xmin", "p_partkey * 53 % 460 AS ymin"
    ).withColumns({"xmax": F.col("xmin") + 20, "ymax": F.col("ymin") + 20})
    return ds.update_reviewed(t.cells, crops, new.join(crops, ["slide", "corner_x", "corner_y"], "left_semi"), 500, 50, on=["slide"])


# --------------------------------------------------------------------- hierarchy

_CLOSURE = "cl(ancestor, descendant) AS (SELECT parent, child FROM edges UNION SELECT c.ancestor, e.child FROM cl c JOIN edges e ON e.parent = c.descendant)"


@query("hierarchy_closure", f"WITH RECURSIVE {_CLOSURE} SELECT ancestor, descendant FROM cl", ["edges"])
def closure(t):
    return ds.closure(t.edges)


_LABELS = "il AS (SELECT 'img' || CAST(image_id AS VARCHAR) AS ImageID, CASE WHEN gt_id % 4 = 0 THEN 'R' || CAST(gt_id % 5 AS VARCHAR) ELSE 'N' || CAST(gt_id % 25 AS VARCHAR) END AS LabelName, CAST(gt_id % 3 <> 0 AS DOUBLE) AS Confidence FROM gt)"


@query(
    "hierarchy_expand",
    f"""WITH RECURSIVE {_CLOSURE}, {_LABELS}, b AS (SELECT {_OID} FROM gt)
SELECT 'box' AS kind, ImageID, LabelName, 1.0::DOUBLE AS Confidence FROM b UNION ALL SELECT 'box', ImageID, ancestor, 1.0 FROM b JOIN cl ON descendant = LabelName
UNION ALL SELECT 'label', ImageID, LabelName, Confidence FROM il UNION ALL SELECT 'label', ImageID, ancestor, Confidence FROM il JOIN cl ON descendant = LabelName WHERE Confidence = 1
UNION ALL SELECT 'label', ImageID, descendant, Confidence FROM il JOIN cl ON ancestor = LabelName WHERE Confidence <> 1""",
    ["edges", "gt"],
)
def _(t):
    pairs = closure(t)
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "ImageID", "LabelName", "Confidence")
    return tag(ds.expand_boxes(oid_boxes(t), pairs), "box").unionByName(tag(ds.expand_labels(oid_labels(t), pairs), "label"))


@query(
    "expand_rows",
    f"WITH RECURSIVE {_CLOSURE}, b AS (SELECT gt_id, 'N' || CAST(gt_id % 25 AS VARCHAR) AS label FROM gt) SELECT gt_id, label FROM b UNION ALL SELECT gt_id, ancestor FROM b JOIN cl ON descendant = label",
    ["edges", "gt"],
)
def _(t):
    up = closure(t).groupBy(F.col("descendant").alias("label")).agg(F.collect_set("ancestor").alias("up"))
    b = t.gt.selectExpr("gt_id", "concat('N', gt_id % 25) AS label").join(up, "label", "left")
    values = F.concat(F.array("label"), F.coalesce("up", F.array().cast("array<string>")))
    return ds.expand_rows(b, "label", values).select("gt_id", "label")


# ----------------------------------------------------------------------- samples


@query(
    "split_train_test",
    "SELECT ID, CASE WHEN CAST('0x' || MD5(CAST(ID AS VARCHAR) || '-3')[1:8] AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM cells",
    ["cells"],
)
def _(t):
    return ds.train_test(t.cells, "ID", 20, 3).select("ID", "split")


@query(
    "sample_balanced",
    """WITH r AS (SELECT ID, NeuN >= 0.9 AS positive, ROW_NUMBER() OVER (PARTITION BY NeuN >= 0.9 ORDER BY MD5(CAST(ID AS VARCHAR) || '-0'), ID) AS rn FROM features),
n AS (SELECT LEAST(COUNT(*) FILTER (WHERE positive), 128) AS n FROM r)
SELECT ID, positive FROM r, n WHERE CASE WHEN positive THEN rn <= n ELSE rn <= 512 - n END""",
    ["features"],
)
def _(t):
    rows = t.features.select("ID", (F.col("NeuN") >= 0.9).alias("positive"))
    return ds.sample_balanced(rows, "ID", "positive", 512, 0.25).select("ID", "positive")


# ----------------------------------------------------------------- UDF surface


def _linear():
    """A tiny classifier: scaled inputs through a softmax."""
    scale = np.array([4.0, 3.0, 5.0])

    def predict(a, b, c):
        z = np.stack([a, b, c], 1) * scale
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    return predict


@query(
    "score_batches",
    "WITH z AS (SELECT ID, EXP(NeuN * 4) AS a, EXP(S100 * 3) AS b, EXP(Olig2 * 5) AS c FROM features) SELECT ID, ROUND(a / (a + b + c), 6) AS NeuN, ROUND(b / (a + b + c), 6) AS S100, ROUND(c / (a + b + c), 6) AS Olig2 FROM z",
    ["features"],
)
def _(t):
    names = ["NeuN", "S100", "Olig2"]
    scored = sc.classify(t.features.select("ID", *names), _linear, names)
    out = sc.spread_probabilities(scored.select("ID", "probabilities"), names)
    return out.select("ID", *(F.round(n, 6).alias(n) for n in names))


@query(
    "transform_chain",
    "SELECT gt_id, ROUND(GREATEST(LEAST(1 - xmax / 512, 0.9), 0.2), 6) AS xmin, ROUND(GREATEST(LEAST(1 - xmin / 512, 0.9), 0.2), 6) AS xmax FROM gt WHERE (LEAST(1 - xmin / 512, 0.9) - GREATEST(1 - xmax / 512, 0.2)) > 0 AND LEAST(ymax / 512, 0.8) - GREATEST(ymin / 512, 0.1) > 0",
    ["gt"],
)
def _(t):
    steps = [("normalize", {"height": 512, "width": 512}), ("flip_left_right", {}), ("clip", {"xmin": 0.2, "ymin": 0.1, "xmax": 0.9, "ymax": 0.8})]
    return sc.apply_chain(t.gt, steps, sc.default_steps()).select("gt_id", F.round("xmin", 6).alias("xmin"), F.round("xmax", 6).alias("xmax"))


@query(
    "similarity_registry",
    f"""SELECT d.det_id, g.gt_id, ROUND({sql_iou('d', 'g')}, 6) AS iou, ROUND({sql_inter('d', 'g')} / ((g.xmax - g.xmin) * (g.ymax - g.ymin)), 6) AS ioa,
-((d.xmin-g.xmin)**2 + (d.ymin-g.ymin)**2 + (d.xmax-g.xmax)**2 + (d.ymax-g.ymax)**2) AS neg_sq_dist, CASE WHEN {sql_iou('d', 'g')} >= 0.5 THEN d.score ELSE 0 END AS gated
FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {sql_inter('d', 'g')} > 0""",
    GT_DET,
)
def _(t):
    pairs = ov.box_pairs(t.det, t.gt, ["image_id"], **SMALL)
    a, b = Box.of("a"), Box.of("b")
    value = {n: fb.similarity(n)(a, b) for n in fb.SIMILARITIES}
    return pairs.select(
        F.col("a.det_id").alias("det_id"), F.col("b.gt_id").alias("gt_id"), F.round(value["iou"], 6).alias("iou"), F.round(value["ioa"], 6).alias("ioa"),
        value["neg_sq_dist"].alias("neg_sq_dist"), fb.thresholded_score(value["iou"], 0.5, F.col("a.score")).alias("gated"),
    )


@query("evaluator_registry", SIMPLE + AP_SELECT, GT_DET)
def _(t):
    plain = t.gt.drop("difficult", "group_of")
    return ev.evaluator("detection")(t.det, plain, **SMALL).select("class_id", "n_gt", F.round("ap", 6).alias("ap"))


# ----------------------------------------------------------------------- streams


def _stamped(df, key):
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("image_id") % 600 + F.col(key) % 5))


@query("stream_eval", f"WITH {FLAGGED.format(det='det', w='0.0')}, {sql_curve()} {AP_SELECT}", GT_DET)
def _(t):
    g, d, out = path(t, "gt_in"), path(t, "det_in"), path(t, "stream")
    gt, det = _stamped(t.gt, "gt_id"), _stamped(t.det, "det_id")
    # two deliveries: some detections come before their ground truth, every tenth box comes twice
    for half in range(2):
        gt.where(f"gt_id % 2 = {half} OR gt_id % 10 = 0").write.mode("append").parquet(g)
        det.where(f"det_id % 3 % 2 = {half} OR det_id % 10 = 0").write.mode("append").parquet(d)
        st.stream_eval(t.spark, g, d, out, **SMALL)
    return st.current_ap(t.spark, out).withColumn("ap", F.round("ap", 6))


@query(
    "stream_running_mean",
    """SELECT COUNT(*) AS n, ROUND(AVG(CAST(value AS DOUBLE)), 5) AS mean_loss, ROUND(AVG(CASE WHEN user_id % 2 = event_id % 2 THEN 1.0 ELSE 0.0 END), 5) AS accuracy
FROM events GROUP BY FLOOR(EPOCH(ts) / 86400)""",
)
def _(t):
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    means = st.running_mean(stream, "value", F.expr("user_id % 2 = event_id % 2"), "1 day")
    out = path(t, "means")
    st.upsert(means, out)
    means = st.latest(t.spark, out, means.schema, ["start"])
    return means.select("n", F.round("mean_loss", 5).alias("mean_loss"), F.round("accuracy", 5).alias("accuracy"))


@query("stream_new_files", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def _(t):
    src, out = path(t, "arrivals"), path(t, "processed")
    for half in range(2):  # two deliveries, each processed when it arrives
        t.events.where(f"event_id % 2 = {half}").write.mode("append").parquet(src)
        st.process_new_files(t.spark, src, t.events.schema, out)
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
