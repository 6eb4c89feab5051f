"""Steps whose work, shuffles or broadcasts must not grow faster than their input: plans and counts on small rows."""

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import (
    conflict, datasets as ds, evaluation as ev, masks, morphology as mo, nearest as nn, ordering as od, overlap as ov, phenotype as ph, raster as ra,
    suppress as sp, unmix as um,
)
from tessella.sources import annotations as an, tables as tb


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(df) -> list[str]:
    """Columns that rows are dealt by, for each shuffle."""
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan(df))]


def test_running_max_reads_no_frame_again(spark):
    rows = spark.createDataFrame([(1, 0, v, i) for i, v in enumerate([3.0, 5.0, 1.0, 2.0])], "k long, _range int, v double, i long")
    out = od.running_max_from_end(rows, ["k"], [F.col("i")], "v", "m")
    assert [r.m for r in out.orderBy("i").collect()] == [5.0, 5.0, 2.0, 2.0]
    assert "unboundedfollowing" not in plan(out).lower()


def test_exploded_tables_are_not_broadcast(spark):
    # literal rows have a size, so the planner would broadcast them
    points = spark.sql("SELECT * FROM VALUES (1L, 0L, 0L), (2L, 3L, 4L) AS t(ID, centroid_x, centroid_y)")
    boxes = spark.sql("SELECT * FROM VALUES (1L, 0L, 0L, 5L, 5L), (2L, 3L, 3L, 9L, 9L) AS t(id, xmin, ymin, xmax, ymax)")
    regions = spark.sql("SELECT * FROM VALUES ('a', 1L, 0L, 9L, 0L, 9L) AS t(region, list_order, x0, x1, y0, y1)")
    images = spark.sql("SELECT * FROM VALUES (1L, 90L, 90L) AS t(image_id, height, width)")
    spots = spark.sql("SELECT * FROM VALUES (1L, 1L) AS t(y, x)")
    grid = ra.tile_grid(images, 50)
    found = [
        nn.radius_self(points, 5.0), ov.box_pairs(boxes, boxes), ov.near_vectors(boxes, boxes, 9.0), spots.join(ph.region_pixels(regions), ["y", "x"]),
        grid.join(ra.tile_grid(images, 50).select("image_id", "row0", "col0"), ["image_id", "row0", "col0"]),
    ]
    for df in found:
        assert "Broadcast" not in plan(df)
        assert df.count() > 0


def test_points_and_cells_are_not_broadcast(spark, monkeypatch):
    points = spark.sql("SELECT * FROM VALUES (1L, 7L, 1L, 1L), (1L, 8L, 40L, 2L), (2L, 9L, 5L, 5L) AS t(slide, ID, x, y)")
    targets = spark.sql("SELECT * FROM VALUES (1L, 3L, 90L, 1L), (1L, 4L, 0L, 0L), (3L, 5L, 5L, 5L) AS t(slide, near_id, x, y)")
    regions = spark.sql("SELECT * FROM VALUES ('a', 1L, 0L, 9L, 0L, 9L), ('b', 2L, 5L, 9L, 5L, 9L) AS t(region, list_order, x0, x1, y0, y1)")
    found, real = [], nn.stage
    monkeypatch.setattr(nn, "stage", lambda df, *a: found.append(plan(df)) or real(df, *a))
    # tables that were staged have a size, so the planner would broadcast them
    out = nn.nearest(real(points), targets, "ID", "near_id", on=["slide"])
    at = ph.point_in_region(points, ph.region_pixels(regions), "x", "y")
    assert len(found) > 3 and not [x for x in [*found, plan(out), plan(at)] if "Broadcast" in x]
    assert sorted((r.ID, r.near_id, round(r.distance, 6)) for r in out.collect()) == [(7, 4, 1.414214), (8, 4, 40.049969)]
    assert sorted((r.ID, r.region) for r in at.collect()) == [(7, "a"), (8, None), (9, "b")]


def test_masks_meet_in_blocks(spark):
    r = random.Random(3)
    masks_of = {i: {(y, x) for y in range(a, a + 6) for x in range(b, b + 7) if r.random() < 0.9} for i in range(12) for a, b in [(r.randint(-9, 9), r.randint(-9, 9))]}
    px = [(0, i, y, x) for i, m in masks_of.items() for y, x in m]
    df = spark.createDataFrame(px + px[:20], "image_id long, a long, y long, x long")
    assert masks.blocks(df, ["image_id", "a"]).groupBy("a").count().agg(F.max("count")).first()[0] <= 4
    got = {(x.a, x.b): (x.intersection, x.area_a, x.area_b, x.iou) for x in masks.mask_overlap(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    want = {(i, j): (len(m & n), len(m), len(n), len(m & n) / len(m | n)) for i, m in masks_of.items() for j, n in masks_of.items() if m & n}
    assert got == want
    # suppression and matching take the same way, with copies of rows
    det = spark.createDataFrame([(0, 0, i, float(i)) for i in masks_of] * 2, "image_id long, class_id long, det_id long, score double")
    kept = {x.det_id for x in sp.nms_masks(det.distinct(), df.withColumnRenamed("a", "det_id"), 0.3).collect()}
    live = []
    for i in sorted(masks_of, reverse=True):
        if all(want.get((i, j), (0, 0, 0, 0))[3] <= 0.3 for j in live):
            live.append(i)
    assert kept == set(live)
    gt = det.distinct().select("image_id", "class_id", F.col("det_id").alias("gt_id"))
    best = ev.best_masks(det.distinct(), gt, df.withColumnRenamed("a", "det_id"), df.withColumnRenamed("a", "gt_id"))
    assert {(x.det_id, x.gt_id, x.iou) for x in best.collect()} == {(i, i, 1.0) for i in masks_of}


def test_masks_of_an_image_meet_where_they_are_dealt(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i % 3, i, float(r.randint(0, 4)), float(a), float(b), float(a + 9), float(b + 8)) for i in range(60) for a, b in [(r.randint(0, 20), r.randint(0, 20))]]
    det = spark.createDataFrame(rows, "image_id long, det_id long, score double, ymin double, xmin double, ymax double, xmax double")
    span = lambda lo, hi: F.explode(F.sequence(F.col(lo).cast("long"), F.col(hi).cast("long")))
    px = lambda d: d.select("image_id", "det_id", "score", span("ymin", "ymax").alias("y"), "xmin", "xmax").select("image_id", "det_id", "score", "y", span("xmin", "xmax").alias("x"))
    image = lambda d: {(y, x) for y in range(int(d[3]), int(d[5]) + 1) for x in range(int(d[4]), int(d[6]) + 1)}
    want = set()
    for k in range(3):
        live = []
        for d in sorted((d for d in rows if d[0] == k), key=lambda d: (-d[2], d[1])):
            if all(len(image(d) & image(e)) / len(image(d) | image(e)) <= 0.3 for e in live):
                live.append(d)
        want |= {d[1] for d in live}
    kept = lambda pixels: sorted(x.det_id for x in sp.nms_masks(det, pixels, 0.3).collect())
    one = sp.dealt(det, ["image_id"])
    # masks of the dealt images are not shuffled again on the way to their edges
    assert len(one) == 1 and dealt(sp._mask_edges(det, px(one[0]), 0.3, ["image_id"], "det_id")) == ["image_id"]
    assert kept([px(d) for d in one]) == kept(px(det)) == kept(px(det).drop("score")) == sorted(want)
    # crowded images are left spread, and keys of many edges go through rounds
    two = sp.dealt(det.where("image_id > 0 OR det_id < 30"), ["image_id"], 15)
    assert [sorted({x.image_id for x in d.collect()}) for d in two] == [[0], [1, 2]]
    two = sp.dealt(det, ["image_id"], 5)
    assert kept([px(d) for d in two]) == kept([px(two[0]), px(two[1]).drop("score")]) == sorted(want)
    monkeypatch.setattr(conflict, "LIMIT", 40)
    assert kept(px(det)) == sorted(want)


def test_equal_windows_meet_once(spark, monkeypatch):
    rows = [(0, i, 0, 0, 40, 40) for i in range(5, 30)] + [(0, i, 0, 40, 40, 80) for i in range(50, 70)] + [(0, 99, 200, 200, 240, 240)]
    rows += [(None, 7, 0, 0, 40, 40), (None, 8, 0, 0, 40, 40)]
    tiles = spark.createDataFrame(rows, "slide long, tile_id long, row0 long, col0 long, row1 long, col1 long")
    seen, real = [], ov.box_pairs
    monkeypatch.setattr(ov, "box_pairs", lambda a, b, *x, **y: seen.append(a.count()) or real(a, b, *x, **y))
    got = {(r.slide, r.window, r.row0, r.col1, r.tiles) for r in mo.merge_tiles(tiles, 0, ["slide"]).collect()}
    assert got == {(0, 5, 0, 80, 45), (0, 99, 200, 240, 1), (None, 7, 0, 40, 1), (None, 8, 0, 40, 1)}
    assert seen == [3]


def test_compartments_are_dealt_by_cell(spark):
    px = spark.createDataFrame([(1, y, x) for y in range(3) for x in range(3)], "cell long, y long, x long")
    out = mo.compartments(px)
    assert set(dealt(out)) == {"cell"}
    assert {r.part: r["count"] for r in out.groupBy("part").count().collect()}["cytoplasm"] == mo.dilate(px, 2).count() - 9


def test_compartments_hold_blocks_not_pixels(spark):
    r = random.Random(5)
    at = lambda n: {(r.randint(-9, 9), r.randint(-9, 9)) for _ in range(n)}
    n, p = {1: at(9), 2: at(30)}, {1: at(7), 3: at(5)}
    table = lambda m: spark.createDataFrame([(c, y, x) for c in m for y, x in m[c]] * 2, "cell long, y long, x long")
    out = mo.compartments(table(n), processes=table(p))
    # no step sorts or ranks the pixels of a cell
    assert not {"Window", "Sort"} & set(re.findall(r"\w+", plan(out)))
    disc = lambda m, k: {(y + a, x + b) for y, x in m for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= k * k}
    want = set()
    for c in {*n, *p}:
        own = n.get(c, set())
        grown = disc(own, 2)
        body = grown | p.get(c, set())
        whole = disc(body, 1)
        parts = {"soma": grown - own, "membrane": whole - body, "whole_cell": whole, "cytoplasm": body - own}
        want |= {(c, part, y, x) for part, m in parts.items() for y, x in m}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a pixel of no row is widened along its row, one of no column stays as it is
    odd = mo.compartments(spark.createDataFrame([(1, None, 4), (2, 4, None)], "cell long, y long, x long")).where("part = 'whole_cell'")
    assert sorted((x.cell, x.y, x.x) for x in odd.collect() if x.cell == 1) == [(1, None, x) for x in range(1, 8)]
    assert [(x.y, x.x) for x in odd.collect() if x.cell == 2] == [(4, None)]


def test_pixels_are_dealt_by_place(spark):
    px = spark.createDataFrame([(c, 0, x, 10 * k + x) for k, c in enumerate("ab") for x in range(3)], "channel string, y long, x long, value long")
    weights = spark.createDataFrame([("a", "b", 0.5)], "target string, channel string, weight double")
    out = um.apply(px, weights)
    assert not [d for d in dealt(out) if "target" in d.split(", ")]
    assert sorted((r.channel, r.x, r.value) for r in out.collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("b", 0, 10), ("b", 1, 11), ("b", 2, 12)]
    rules = spark.createDataFrame([("t", "A", 1), ("t", "B", 1), ("u", "B", 1)], "type string, biomarker string, required int")
    info = spark.createDataFrame([("A", "a"), ("B", "b")], "Biomarker string, Channel string")
    out = ph.channel_mean_image(rules, info, px)
    assert not [d for d in dealt(out) if {"type", "y"} <= set(d.split(", "))]
    assert sorted((r.type, r.x, r.value) for r in out.collect()) == [("t", 0, 5), ("t", 1, 6), ("t", 2, 7), ("u", 0, 10), ("u", 1, 11), ("u", 2, 12)]


def test_rules_of_functions_are_matched_once_for_each_pattern(spark, monkeypatch):
    rows = [(i, i % 2, int(i % 4 == 0)) for i in range(40)] + [(1, 0, 1), (None, 1, 1)]
    cells = spark.createDataFrame(rows, "ID long, A int, B int")
    rules = spark.createDataFrame([(0, "X", "A"), (1, "Y", "B"), (2, "X sub", "B")], "rule_order long, `Cell Type` string, Biomarker string")
    seen, real = [], ph._major_function
    monkeypatch.setattr(ph, "_major_function", lambda df, *a: seen.append(df.count()) or real(df, *a))
    got = {r.ID: (r.type, r.function) for r in ph.major_function(cells, rules, {"X": "A", "Y": "B"}).collect()}
    # a repeated cell counts with all its markers; no rule joins a cell without a name
    assert got[1] == ("Y", "X sub") and got[3] == ("X", None) and got[4] == ("Y", None) and got[2] == (None, None) and got[None] == (None, None)
    assert seen == [4]


def test_labels_meet_their_descendants_in_slices(spark):
    pairs = spark.createDataFrame([("R", f"c{i}") for i in range(500)], "ancestor string, descendant string")
    labels = spark.createDataFrame([("i", "R", 0.0), ("j", "c3", 1.0), ("k", "c4", 0.0)], "ImageID string, LabelName string, Confidence double")
    out = ds.expand_labels(labels, pairs)
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([("i", "R", 0.0), ("j", "c3", 1.0), ("k", "c4", 0.0), ("j", "R", 1.0)] + [("i", f"c{i}", 0.0) for i in range(500)])
    assert any("_slice" in d for d in dealt(out))


def test_tiles_are_filled_in_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.delattr(tb.F, "map_from_entries")
    px = spark.createDataFrame([("a", 0, 1, 5), ("a", 3, 3, 7), ("a", 2, 0, None), ("a", 9, 4, 1), ("b", -1, -4, 2)], "channel string, y long, x long, value long")
    tb.write_raster_tiles(px, str(tmp_path / "t"), 4)
    assert {len(r["values"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {16}
    got = sorted((r.channel, r.y, r.x, r.value) for r in tb.read_raster_tiles(spark, str(tmp_path / "t"), 4).collect())
    assert got == [("a", 0, 1, 5), ("a", 3, 3, 7), ("a", 9, 4, 1), ("b", -1, -4, 2)]
    with pytest.raises(PySparkException, match="two pixels"):
        tb.write_raster_tiles(px.union(px.limit(1)), str(tmp_path / "u"), 4)


def test_segments_are_dealt_by_object(spark):
    px = spark.createDataFrame([(1, 7, 0, x) for x in (0, 1, 3, 3)], "image_id long, gt_id long, y long, x long")
    gt = spark.createDataFrame([(1, 7, 2)], "image_id long, gt_id long, class_id long")
    out = an.coco_segments(gt, px)
    assert sorted((r.y, r.x, r.length) for r in out.collect()) == [(0, 0, 2), (0, 3, 1)]
    assert not [d for d in dealt(out) if "y" in d.split(", ")]


def _boxes(spark):
    gt = [(i, i % 2, 0, 20.0 * i, 0.0, 20.0 * i + 10, 10.0, False, False) for i in range(6)]
    gt = spark.createDataFrame(gt, "gt_id long, image_id long, class_id long, xmin double, ymin double, xmax double, ymax double, difficult boolean, group_of boolean")
    det = [(i, i % 2, int(i == 5), float(i), 20.0 * (i % 6), 0.0, 20.0 * (i % 6) + 10, 9.0) for i in range(9)]
    det = spark.createDataFrame(det * 2, "det_id long, image_id long, class_id long, score double, xmin double, ymin double, xmax double, ymax double")
    return det, gt


def test_boxes_are_matched_once_for_claims(spark):
    det, gt = _boxes(spark)
    out = ev.claims(ev.best_boxes(det, gt), 0.5)
    # winners and the rows they mark come from the same staged matches
    assert "Generate" not in plan(out) and "_cx" not in plan(out)
    # boxes of 6, 7 and 8 are those of 0, 1 and 2, with higher scores; copies share the mark; 5 has another class
    assert sorted((r.det_id, r.matched, r.tp) for r in out.collect()) == [
        (i, i != 5, i in (3, 4, 6, 7, 8)) for i in range(9) for _ in range(2)
    ]
    scored = ev.score_detections(ev.best_boxes(det, gt), 0.5)
    assert "Generate" not in plan(scored) and scored.where("tp > 0").count() == 10


def test_relations_are_matched_once_for_claims(spark):
    det, gt = _boxes(spark)
    box = "named_struct('xmin', xmin, 'ymin', ymin, 'xmax', xmax, 'ymax', ymax)"
    tuples = lambda df, *k: df.selectExpr(*k, "image_id", "0L AS subject_label", "1L AS object_label", "class_id AS relation", f"{box} AS subject", f"{box} AS object")
    out = ev.score_relations(tuples(det.distinct(), "det_id", "score"), tuples(gt, "gt_id"))
    assert "Generate" not in plan(out)
    assert sorted(r.rank_id for r in out.where("tp > 0").collect()) == [3, 4, 6, 7, 8]
