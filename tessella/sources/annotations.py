"""Readers and writers of annotation formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import contiguous_shards, numbered

_BNDBOX = "struct<xmin:long,ymin:long,xmax:long,ymax:long>"
XML_SCHEMA = (
    "filename string, source struct<database:string,corner:string>, size struct<width:long,height:long,depth:long>, "
    f"object array<struct<name:string,truncated:int,bndbox:{_BNDBOX}>>"
)


# ---------------------------------------------------------------------- grouping


def nested(df: DataFrame, keys, payload: dict[str, Column], id_col: str, name: str) -> DataFrame:
    """Group rows into one nested record ``keys, <name> array<struct>`` for each key, in id order.

    The number of objects does not change the form: a key of any size is one record.
    """
    rows = F.collect_list(F.struct(F.col(id_col), *(c.alias(k) for k, c in payload.items())))
    return df.groupBy(*keys).agg(F.array_sort(rows).alias(name))


def example_records(df: DataFrame, keys=("image_id",), id_col: str = "gt_id", columns=None) -> DataFrame:
    """Annotations per image as one nested record (boxes, class text and label)."""
    names = columns or {"xmin": "xmin", "ymin": "ymin", "xmax": "xmax", "ymax": "ymax", "label": "class_id"}
    return nested(df, keys, {k: F.col(v) for k, v in names.items()}, id_col, "objects")


# Column names of public formats, record field -> source column
MAPPINGS = {
    "crops": {"xmin": "xmin", "ymin": "ymin", "xmax": "xmax", "ymax": "ymax", "text": "class"},
    "open_images": {"xmin": "XMin", "ymin": "YMin", "xmax": "XMax", "ymax": "YMax", "text": "LabelName", "group_of": "IsGroupOf"},
    "voc": {"xmin": "xmin", "ymin": "ymin", "xmax": "xmax", "ymax": "ymax", "text": "name", "difficult": "difficult"},
    "pets": {"xmin": "xmin", "ymin": "ymin", "xmax": "xmax", "ymax": "ymax", "text": "name"},
    "kitti": {"xmin": "left", "ymin": "top", "xmax": "right", "ymax": "bottom", "text": "type"},
}


def with_annotations(images: DataFrame, records: DataFrame, key: str = "image_id", name: str = "objects") -> DataFrame:
    """All images with their objects; images without any get an empty list."""
    kind = dict(records.dtypes)[name]
    return images.join(records, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def count_missing(images: DataFrame, annotations: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(annotations.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("images_without_annotation"))


def label_ids(df: DataFrame, label_map: DataFrame, column: str) -> DataFrame:
    """Class text to id; a text that is not in the map is an error."""
    m = label_map.select(F.col("name").alias(column), F.col("id").alias("_id"))
    found = F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(column, F.lit("null"))))).otherwise(F.col("_id"))
    return df.join(m, column, "left").withColumn("class_id", found).drop("_id")


# --------------------------------------------------------------------------- XML


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` of XML files, one row each.

    Files are split at the closing tag, so a file of many documents is read by
    many tasks and needs no common root.
    """
    text = spark.read.option("lineSep", f"</{tag}>").text(path)
    body = F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)", 1)
    found = text.select(body.alias("value")).where("value <> ''")
    return found.select(F.from_xml(F.concat("value", F.lit(f"</{tag}>")), schema).alias("r")).select("r.*")


def read_voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per object: ``filename, width, height, class, box`` plus the crop corner."""
    docs = xml_records(spark, path, "annotation", XML_SCHEMA)
    o = docs.select("filename", "source.corner", "size.width", "size.height", F.explode("object").alias("o"))
    return o.select(
        "filename", "corner", "width", "height", F.col("o.name").alias("class"), F.col("o.truncated").alias("truncated"), "o.bndbox.*"
    )


def crop_documents(objects: DataFrame, database: str = "cells", on=()) -> DataFrame:
    """One annotation document per crop of an image; the image key ``on`` begins the name.

    ``objects``: ``corner_x, corner_y, width, height, id, class, truncated`` and a box.
    """
    keys = [*on, "corner_x", "corner_y", "width", "height"]
    payload = {
        "name": F.col("class"), "truncated": F.col("truncated"),
        "bndbox": F.struct(*(F.col(c).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax"))),
    }
    rec = nested(objects, keys, payload, "id", "objects")
    stem = F.concat_ws("_", *(F.col(c).cast("string") for c in on), F.format_string("%05d_%05d", F.col("corner_x"), F.col("corner_y")))
    doc = F.struct(
        F.concat(stem, F.lit(".jpeg")).alias("filename"),
        F.struct(F.lit(database).alias("database"), F.concat_ws(",", "corner_x", "corner_y").alias("corner")).alias("source"),
        F.struct("width", "height", F.lit(3).alias("depth")).alias("size"),
        F.lit(0).alias("segmented"),
        F.transform("objects", lambda o: F.struct(o["name"].alias("name"), o["truncated"].alias("truncated"), o["bndbox"].alias("bndbox"))).alias("object"),
    )
    return rec.select(stem.alias("crop"), F.to_xml(doc, {"rowTag": "annotation"}).alias("value"))


def write_voc_xml(objects: DataFrame, path: str, **options) -> None:
    """Annotation documents, many per text file; read back by their row tag."""
    crop_documents(objects, **options).select("value").write.text(path)


def read_dataset_xml(spark: SparkSession, path: str) -> DataFrame:
    """Data set definition: one row per ``Image`` with its marker, file and attributes."""
    docs = xml_records(spark, path, "Image", "_biomarker string, FileName string, _ImgColor string, _SeedColor string")
    return docs.select(F.col("_biomarker").alias("biomarker"), "FileName", F.col("_ImgColor").alias("ImgColor"), F.col("_SeedColor").alias("SeedColor"))


def channel_attribute(dataset: DataFrame, biomarker: str, key: str) -> DataFrame:
    """Attribute of one marker; bracketed lists become arrays of doubles."""
    row = dataset.where(F.col("biomarker") == biomarker)
    if key in ("ImgColor", "SeedColor"):
        return row.select(F.split(F.regexp_extract(key, r"\[(.*)\]", 1), ",").cast("array<double>").alias(key))
    return row.select(key)


# -------------------------------------------------------------------------- text


def read_voc_txt(spark: SparkSession, path: str, detections: bool) -> DataFrame:
    """``class [confidence] x y w h`` lines, image id = file stem, boxes as corners."""
    lines = spark.read.text(path).select(
        F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("image"),
        F.split(F.trim("value"), r"\s+").alias("f"),
    ).where("size(f) >= 5")
    k = 1 if detections else 0
    f = lambda i: F.col("f")[i + k].cast("double")
    cols = [F.col("image"), F.col("f")[0].alias("class")]
    if detections:
        cols.append(F.col("f")[1].cast("double").alias("score"))
    return lines.select(*cols, f(1).alias("xmin"), f(2).alias("ymin"), (f(1) + f(3)).alias("xmax"), (f(2) + f(4)).alias("ymax"))


KITTI = (
    "type string, truncated double, occluded int, alpha double, left double, top double, right double, bottom double, "
    "height double, width double, length double, x double, y double, z double, rot_y double"
)


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """15 fields per line, type in lower case, image id = file stem."""
    df = spark.read.csv(path, sep=" ", schema=KITTI)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return df.withColumns({"type": F.lower("type"), "image": stem})


OID_BOXES = (
    "ImageID string, Source string, LabelName string, Confidence double, XMin double, XMax double, YMin double, YMax double, "
    "IsOccluded int, IsTruncated int, IsGroupOf int, IsDepiction int, IsInside int"
)
OID_LABELS = "ImageID string, Source string, LabelName string, Confidence double"


def read_oid_boxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=OID_BOXES)


def read_oid_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=OID_LABELS)


#: Columns of the public prediction and relation files.
OID_PREDICTIONS = "ImageID string, LabelName string, Score double, XMin double, XMax double, YMin double, YMax double"
OID_RELATIONS = (
    "ImageID string, LabelName1 string, LabelName2 string, XMin1 double, XMax1 double, YMin1 double, YMax1 double, "
    "XMin2 double, XMax2 double, YMin2 double, YMax2 double, RelationshipLabel string, LabelName string, Confidence double"
)


def read_oid_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Detections ``image_id, label, score`` and a box, from a prediction file."""
    rows = spark.read.csv(path, header=True, schema=OID_PREDICTIONS)
    return rows.select(
        F.col("ImageID").alias("image_id"), F.col("LabelName").alias("label"), F.col("Score").alias("score"),
        *(F.col(c).alias(c.lower()) for c in ("XMin", "YMin", "XMax", "YMax")),
    )


def read_oid_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Relations (subject and object boxes with labels) and image labels, from a file that mixes both kinds of rows.

    A row without a relation is a label row: ``image_id, label, confidence``.
    """
    rows = spark.read.csv(path, header=True, schema=OID_RELATIONS)
    box = lambda n: F.struct(*(F.col(f"{c}{n}").alias(c.lower()) for c in ("XMin", "YMin", "XMax", "YMax")))
    relations = rows.where("RelationshipLabel IS NOT NULL").select(
        F.col("ImageID").alias("image_id"), F.col("LabelName1").alias("subject_label"), F.col("LabelName2").alias("object_label"),
        F.col("RelationshipLabel").alias("relation"), box(1).alias("subject"), box(2).alias("object"),
    )
    labels = rows.where("RelationshipLabel IS NULL AND LabelName IS NOT NULL")
    return relations, labels.select(F.col("ImageID").alias("image_id"), F.col("LabelName").alias("label"), F.col("Confidence").alias("confidence"))


def merge_oid(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Box and image-label rows in one table; the label confidence gets its own column."""
    return boxes.unionByName(labels.withColumnRenamed("Confidence", "ConfidenceImageLabel"), allowMissingColumns=True)


def read_label_map(spark: SparkSession, path: str, display: bool = False, fill_gaps: bool = False) -> DataFrame:
    """Label map text to ``(id, name)``; the first item of an id wins.

    A negative id is an error, and so is id 0 for anything but the background.
    """
    items = spark.read.option("lineSep", "}").text(path).where(F.col("value").contains("item")).select(
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        F.regexp_extract("value", r"\bid\s*:\s*(-?\d+)", 1).cast("long").alias("id"),
        F.regexp_extract("value", r"(?<!_)\bname\s*:\s*[\"']([^\"']*)[\"']", 1).alias("name"),
        F.nullif(F.regexp_extract("value", r"display_name\s*:\s*[\"']([^\"']*)[\"']", 1), F.lit("")).alias("display_name"),
    )
    label = F.coalesce("display_name", "name") if display else F.col("name")
    bad = (F.col("id") < 0) | ((F.col("id") == 0) & (F.col("name") != "background") & (F.coalesce("display_name", F.lit("")) != "background"))
    ok = F.when(bad, F.raise_error(F.lit("label map ids must be positive; 0 is the background"))).otherwise(F.col("id"))
    first = items.select(ok.alias("id"), F.struct("_block", "_at", label.alias("name")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    named = first.select("id", F.col("r.name").alias("name"))
    return fill_label_gaps(named) if fill_gaps else named


def fill_label_gaps(named: DataFrame) -> DataFrame:
    """Add ``background`` as 0 and ``class_<id>`` for every unused id below the largest."""
    top = named.agg(F.max("id").alias("m")).first()["m"]
    every = named.sparkSession.range(0 if top is None else top + 1)
    dummy = F.when(F.col("id") == 0, F.lit("background")).otherwise(F.concat(F.lit("class_"), F.col("id").cast("string")))
    return every.join(named, "id", "left").select("id", F.coalesce("name", dummy).alias("name"))


def label_map_text(labels: DataFrame) -> DataFrame:
    return labels.select(F.format_string('item {\n  id: %d\n  name: "%s"\n}\n', "id", "name").alias("value"))


def write_label_file(labels: DataFrame, path: str) -> None:
    """``id:name`` lines."""
    labels.select(F.concat_ws(":", F.col("id").cast("string"), "name").alias("value")).write.text(path)


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    line = spark.read.text(path)
    at = F.instr("value", ":")
    return line.select(F.substring("value", F.lit(1), at - 1).cast("long").alias("id"), F.expr("substring(value, instr(value, ':') + 1)").alias("name"))


# -------------------------------------------------------------------------- COCO


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``images``, ``annotations`` and ``categories`` of a single COCO document.

    A JSON document cannot be split, so one file is one task; large exports should
    use the line form of :func:`write_coco`, read by :func:`read_coco_lines`.
    """
    schema = (
        "images array<struct<id:long,width:long,height:long,file_name:string>>, "
        "annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>, "
        "categories array<struct<id:long,name:string>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return {k: doc.select(F.inline(k)) for k in ("images", "annotations", "categories")}


def coco_annotations(gt: DataFrame) -> DataFrame:
    """Ground truth as COCO rows; numbers rounded to 4 places."""
    r = lambda c: F.round(c, 4)
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return gt.select(
        F.col("gt_id").alias("id"), "image_id", F.col("class_id").alias("category_id"),
        F.array(r("xmin"), r("ymin"), r(w), r(h)).alias("bbox"), r(w * h).alias("area"), F.coalesce(F.col("is_crowd").cast("int"), F.lit(0)).alias("iscrowd"),
    )


def coco_detections(det: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 4)
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return det.select("image_id", F.col("class_id").alias("category_id"), F.array(r("xmin"), r("ymin"), r(w), r(h)).alias("bbox"), r("score").alias("score"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, written by all tasks."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_coco_lines(spark: SparkSession, path: str, detections: bool = False) -> DataFrame:
    schema = "image_id long, category_id long, bbox array<double>, " + ("score double" if detections else "id long, area double, iscrowd int")
    return spark.read.schema(schema).json(path)


def coco_segments(objects: DataFrame, pixels: DataFrame, id_col: str = "gt_id") -> DataFrame:
    """Masks as row runs ``[y, x, length]`` per object, with area.

    Runs are found by grouping pixels on ``x - rank``; a run table has one row per
    run, so an object of any size stays spread over rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("image_id", id_col, "y").orderBy("x")
    # pixels are dealt by object before they are made distinct: all that follows stays with the object
    p = pixels.select("image_id", id_col, "y", "x").repartition("image_id", id_col).distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    runs = p.groupBy("image_id", id_col, "y", "_g").agg(F.min("x").alias("x"), F.count("*").alias("length"))
    return objects.select("image_id", id_col, F.col("class_id").alias("category_id")).join(runs.drop("_g"), ["image_id", id_col])


def coco_keypoints(points: DataFrame, id_col: str = "gt_id") -> DataFrame:
    """``[x, y, v, ...]`` per object from ``(id, k, x, y, visible)``; a skeleton has few points."""
    flat = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("k", "x", "y", F.col("visible").cast("int").alias("v")))),
            lambda s: F.array(F.round(s["x"], 4), F.round(s["y"], 4), s["v"].cast("double")),
        )
    )
    return points.groupBy("image_id", id_col).agg(flat.alias("keypoints"), F.count_if("visible").alias("num_keypoints"))


# ------------------------------------------------------------------------ shards


def write_shards(df: DataFrame, path: str, shards: int, order, contiguous: bool = False) -> None:
    """Nested examples in ``shards`` folders: round robin over the order, or contiguous ranges."""
    if contiguous:
        out = contiguous_shards(df, order, shards).withColumn("shard", F.col("shard") - 1)
    else:
        out = numbered(df, order, "_i").withColumn("shard", F.pmod(F.col("_i") - 1, F.lit(shards))).drop("_i")
    out.write.partitionBy("shard").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``metric,value`` lines."""
    metrics.select("metric", "value").write.csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="metric string, value double")
