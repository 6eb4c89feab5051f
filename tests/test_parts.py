"""Parts of operators that no registered query runs, on small cases with known answers."""

import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import points as pt, scoring
from tessella.operators import boxes as ob, datasets as ds, evaluation as ev, nearest, phenotype as ph, raster, unmix
from tessella.sources import annotations as an, tables as tb
from tessella.streaming import evaluate as se


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_align_joins_equal_tables_and_refuses_others(spark):
    boxes = spark.createDataFrame([(1, 1.0, 2.0, 7), (2, 3.0, 4.0, 8)], "ID long, centroid_x double, centroid_y double, side long")
    features = spark.createDataFrame([(2, 3.0, 4.0, 0.2), (1, 1.0, 2.0, 0.1)], "ID long, centroid_x double, centroid_y double, cd3 double")
    assert rows(ph.align(boxes, features).select("ID", "side", "cd3")) == [(1, 7, 0.1), (2, 8, 0.2)]
    moved = features.withColumn("centroid_y", F.col("centroid_y") + (F.col("ID") == 2).cast("int"))
    for other in (moved, features.where("ID = 1"), features.union(features.withColumn("ID", F.col("ID") + 10))):
        with pytest.raises(PySparkException, match="tables differ"):
            ph.align(boxes, other).collect()


def test_gate_at_and_above_the_threshold(spark):
    wide = spark.createDataFrame([(1, 0.5, 3.0), (2, 0.6, None), (3, 0.4, 9.0)], "ID long, a double, b double")
    limits = spark.createDataFrame([("a", 0.5), ("b", 3.0), ("c", None)], "Biomarker string, Threshold double")
    for strict, want in ((False, [(1, 1, 1), (2, 1, None), (3, 0, 1)]), (True, [(1, 0, 0), (2, 1, None), (3, 0, 1)])):
        long = ph.gate(ph.to_long(wide), limits, strict)
        assert rows(ph.to_wide(long, ["a", "b"]), "ID") == want
        assert rows(ph.gate_wide(wide, limits, ["a", "b"], strict).select("ID", "a", "b"), "ID") == want
    assert ph.gate(spark.createDataFrame([(1, "c", 1.0)], "ID long, biomarker string, value double"), limits).count() == 0


def test_channel_attribute(spark, tmp_path):
    (tmp_path / "set.xml").write_text(
        '<Images><Image biomarker="DAPI" ImgColor="[0.5,1,0]" SeedColor="[1,1,1]"><FileName>a.tif</FileName></Image>\n'
        '<Image biomarker="NeuN" ImgColor="[1,0,0]" SeedColor="[0,0,1]"><FileName>b.tif</FileName></Image></Images>\n'
    )
    dataset = an.read_dataset_xml(spark, str(tmp_path / "set.xml"))
    assert rows(an.channel_attribute(dataset, "DAPI", "ImgColor")) == [([0.5, 1.0, 0.0],)]
    assert rows(an.channel_attribute(dataset, "NeuN", "FileName")) == [("b.tif",)]
    assert rows(an.channel_attribute(dataset, "none", "FileName")) == []


def test_coco_detections_are_read_back(spark, tmp_path):
    det = spark.createDataFrame(
        [(1, 2, 1.23456, 2.0, 5.0, 9.5, 0.98765), (3, 4, 0.0, 0.0, 1.0, 1.0, 0.5)],
        "image_id long, class_id long, xmin double, ymin double, xmax double, ymax double, score double",
    )
    an.write_json_lines(an.coco_detections(det), str(tmp_path / "det"))
    back = an.read_coco_lines(spark, str(tmp_path / "det"), detections=True).orderBy("image_id").collect()
    assert [(r.image_id, r.category_id, r.score) for r in back] == [(1, 2, 0.9877), (3, 4, 0.5)]
    assert back[0].bbox == pytest.approx([1.2346, 2.0, 3.7654, 7.5])


BOX = "ymin double, xmin double, ymax double, xmax double"


def test_crop_boxes_are_local_whole_and_large(spark):
    cells = spark.createDataFrame(
        # inside crop (100, 200); over an edge; too narrow; inside crop (0, 0)
        [(1, 110.0, 210.0, 140.0, 240.0), (2, 90.0, 10.0, 120.0, 40.0), (3, 10.0, 10.0, 40.0, 15.0), (4, 0.5, 0.5, 50.0, 60.0)], f"ID long, {BOX}"
    )
    got = ds.crop_boxes(cells, 100).select("ID", "tile_y", "tile_x", "ymin", "xmin", "ymax", "xmax")
    assert rows(got) == [(1, 100, 200, 10.0, 10.0, 40.0, 40.0), (4, 0, 0, 0.5, 0.5, 50.0, 60.0)]


def test_valid_keeps_what_the_counts_call_kept(spark):
    boxes = spark.createDataFrame(
        [(1, 0.0, 0.0, 10.0, 10.0), (2, 3.0, 3.0, 3.0, 9.0), (3, -1.0, 0.0, 4.0, 4.0), (4, 1.0, 1.0, 2.0, 11.0), (5, 4.0, 5.0, 3.0, 6.0)], f"ID long, {BOX}"
    )
    assert rows(ob.valid(boxes, 10, 10).select("ID")) == [(1,)]


def test_detect_runs_a_given_detector_and_skips_empty_tiles(spark):
    tiles = spark.createDataFrame([(i, float(i)) for i in range(6)], "tile long, level double").repartition(3)

    def make():
        def run(pdf):
            hit = pdf[pdf["tile"] % 2 == 1]
            return pd.DataFrame({"tile": hit["tile"], "xmin": hit["level"], "score": 0.5})

        return run

    assert rows(scoring.detect(tiles, make, "tile long, xmin double, score double")) == [(1, 1.0, 0.5), (3, 3.0, 0.5), (5, 5.0, 0.5)]


def test_flip_vertical_twice_is_nothing(spark):
    df = spark.createDataFrame([(0.25, 0.75)], "y double, x double")
    y, x = pt.flip_vertical(F.col("y"), F.col("x"))
    back = pt.flip_vertical(y, x)
    assert rows(df.select(y.alias("a"), x.alias("b"), back[0].alias("c"), back[1].alias("d"))) == [(0.75, 0.75, 0.25, 0.75)]


def test_median_otsu_over_crops(spark):
    # in a crop of two values the lower one is the threshold
    values = [(1, 1), (1, 50), (2, 5), (2, 5), (2, 90), (3, 9), (3, 80)]
    df = spark.createDataFrame([(c, v) for c, v in values for _ in range(3)], "crop long, value long")
    assert rows(raster.median_otsu(df, ["crop"])) == [(5.0,)]


def test_global_error_is_that_of_one_tile(spark):
    target = spark.createDataFrame([(0, 0, 9), (0, 1, 9), (5, 5, 9), (6, 6, 1)], "y long, x long, value long")
    source = spark.createDataFrame([(0, 0, 7), (5, 5, 1), (6, 6, 7)], "y long, x long, value long")
    diff = raster.binary_difference(target, source, 5, 5)
    # foreground of the target: 3 pixels; (0, 1), (5, 5) and (6, 6) differ
    assert raster.global_error(diff).first().error == pytest.approx(100.0)
    assert raster.tile_error(diff, 100).first().error == pytest.approx(100.0)
    assert raster.global_error(diff.limit(0)).first().error is None


def test_metric_rows(spark):
    df = spark.createDataFrame([(0.5, 0.25)], "mean_ap double, corloc double")
    assert rows(ev.metric_rows(df)) == [("corloc", 0.25), ("mean_ap", 0.5)]


def test_restretch_leaves_images_of_contrast_alone(spark):
    values = [("dim", i // 10, i % 10, i) for i in range(100)] + [("full", i // 10, i % 10, i * 600) for i in range(100)]
    df = spark.createDataFrame(values, "channel string, y long, x long, value long")
    got = {(r.channel, r.y, r.x): r.value for r in unmix.restretch_low_contrast(df).collect()}
    assert len(got) == 200 and all(got["full", i // 10, i % 10] == i * 600 for i in range(100))
    dim = [got["dim", i // 10, i % 10] for i in range(100)]
    assert dim == sorted(dim) and dim[0] == 0 and dim[-1] == pytest.approx(65535, rel=0.01) and dim[50] == pytest.approx(65535 * 50 / 99, rel=0.01)
    assert rows(spark.createDataFrame([(65535.0,)], "v double").select(unmix.normalized(F.col("v"), "uint16"))) == [(1.0,)]


@pytest.mark.parametrize("tile, step", [(10, 10), (10, 7), (10, 3)])
def test_tile_of_gives_every_tile_that_holds_a_place(spark, tile, step):
    first, last = nearest.tile_of(F.col("v"), tile, step)
    for v, a, b in spark.range(0, 60).select(F.col("id").alias("v"), first, last).collect():
        assert list(range(a, b + 1)) == [k for k in range(61) if k * step <= v <= k * step + tile]


def test_box_lookup_and_encoded_tiles(spark, tmp_path):
    (tmp_path / "boxes.csv").write_text("a.png,0.1,0.2,0.3,0.4\nb.png,0,0,1,1\na.png,0.5,0.5,0.6,0.6\n")
    got = rows(tb.read_box_lookup(spark, str(tmp_path / "boxes.csv")))
    assert got == [("a.png", 0.1, 0.2, 0.3, 0.4), ("a.png", 0.5, 0.5, 0.6, 0.6), ("b.png", 0.0, 0.0, 1.0, 1.0)]
    (tmp_path / "tiles").mkdir()
    for name in "ab":
        (tmp_path / "tiles" / f"{name}.json").write_text(json.dumps([[0, 0, ord(name)], [1, 2, 7]]))

    def decode(data):
        return pd.DataFrame(json.loads(data), columns=["y", "x", "value"])

    read = tb.read_encoded_tiles(spark, str(tmp_path / "tiles"), decode, "y long, x long, value long")
    named = read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "y", "x", "value")
    assert rows(named) == [("a.json", 0, 0, 97), ("a.json", 1, 2, 7), ("b.json", 0, 0, 98), ("b.json", 1, 2, 7)]


def test_poll_takes_each_file_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(3)
    df.write.parquet(source)
    running = se.poll(spark, source, df.schema, out, "0 seconds", each=lambda d: d.withColumn("id", F.col("id") * 2))
    try:
        running.processAllAvailable()
        spark.range(10, 12).write.mode("append").parquet(source)
        running.processAllAvailable()
    finally:
        running.stop()
    assert rows(spark.read.parquet(out)) == [(0,), (2,), (4,), (20,), (22,)]
