"""Small cases with known answers."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import boxes as fb
from tessella.functions.boxes import Box, window
from tessella.operators import assign, boxes as ob, coco, datasets as ds, evaluation as ev, overlap as ov, suppress as sp
from tessella.sources import annotations as an, tables as tb

YX = "ymin double, xmin double, ymax double, xmax double"


def frame(spark, rows, extra, boxes):
    """Rows of extra columns plus [ymin, xmin, ymax, xmax]."""
    return spark.createDataFrame([(*a, *map(float, b)) for a, b in zip(rows, boxes)], f"{extra}, {YX}")


def test_box_pairs(spark):
    a = frame(spark, [(0, 0), (1, 0)], "i long, image_id long", [[0, 0, 4, 6], [10, 10, 14, 12]])
    b = frame(spark, [(0, 0), (1, 0), (2, 0)], "j long, image_id long", [[2, 2, 6, 8], [20, 20, 22, 22], [0, 0, 30, 30]])
    assert [r[0] for r in a.orderBy("i").select(Box.of().area()).collect()] == [24, 8]
    got = {(r.i, r.j): r.iou for r in ov.box_overlap(a, b, ["image_id"], cell=4.0).select("a.i", "b.j", "iou").collect()}
    # a0 and b0 share 2 x 4 of 24 + 24; b2 (900) holds both boxes of a
    want = {(0, 0): 8 / 40, (0, 2): 24 / 900, (1, 2): 8 / 900}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_nms_clusters(spark):
    # a row of three boxes, each shifted by a fifth of its side (IoU 2/3, ends 3/7), and a pair of IoU 9/11
    boxes = [[0, 0, 10, 10], [0, 2, 10, 12], [0, 4, 10, 14], [50, 50, 60, 60], [50, 51, 60, 61]]
    scores = [0.8, 0.9, 0.7, 0.6, 0.65]
    df = frame(spark, [(i, s) for i, s in enumerate(scores)], "det_id long, score double", boxes)
    kept = lambda t, **k: [r.det_id for r in sp.nms(df, t, **k).orderBy(F.desc("score")).collect()]
    assert kept(0.5) == [1, 4] and kept(0.5, max_output=1) == [1]
    assert kept(0.7) == [1, 0, 2, 4]
    assert kept(1.0) == [1, 0, 2, 4, 3]


def test_nms_with_one_box_over_all(spark, monkeypatch):
    """A box as wide as the image adds no round to the suppression of the small ones."""
    small = [[y * 3, x * 3, y * 3 + 4, x * 3 + 4] for y in range(20) for x in range(20)]
    rows = [(i, (i * 37 % 400) / 400) for i in range(400)]
    tables = []
    monkeypatch.setattr(sp, "stage", lambda df, name="stage", write=sp.stage: (tables.append(name), write(df, name))[1])

    def kept(r, b):
        tables.clear()
        out = sp.nms(frame(spark, r, "det_id long, score double", b), 0.1, cell=4.0)
        return {x.det_id for x in out.collect()}, len(tables)

    alone, n = kept(rows, small)
    both, m = kept([*rows, (400, 0.5)], [*small, [0, 0, 64, 64]])
    assert both == alone | {400} and m <= n + 2


@pytest.mark.parametrize("half,want", [(0.0, [1, 1 / 2, 2 / 3, 2 / 4]), (0.5, [1, 1 / 2, 2 / 3, 2.5 / 3.5])])
def test_precision_recall(spark, half, want):
    # by falling score: hit, miss, hit, and one of weight half, which counts as much among all as among hits
    scores, labels = [0.5, 0.9, 0.4, 0.8], [1.0, 1.0, half, 0.0]
    scored = spark.createDataFrame([(0, i, s, l) for i, (s, l) in enumerate(zip(scores, labels))], "class_id long, rank_id long, score double, tp double")
    counts = spark.createDataFrame([(0, 4.0)], "class_id long, n_gt double")
    got = [r.precision for r in ev.precision_recall(scored, counts).orderBy(F.desc("score")).collect()]
    assert got == pytest.approx(want)


def evaluator_frames(spark):
    gt = frame(
        spark,
        [(0, 1, 0, False, False), (1, 2, 0, False, False), (2, 2, 0, True, False), (3, 1, 1, False, False)],
        "gt_id long, image_id long, class_id long, difficult boolean, group_of boolean",
        [[0, 0, 10, 10], [20, 20, 40, 40], [100, 100, 120, 120], [0, 0, 30, 30]],
    )
    det = frame(
        spark, [(0, 2, 0, 0.9), (1, 1, 0, 0.8), (2, 2, 0, 0.7)], "det_id long, image_id long, class_id long, score double",
        [[20, 20, 40, 40], [50, 50, 60, 60], [100, 100, 120, 120]],
    )
    return det, gt


def test_evaluator(spark):
    # class 0 has two boxes that count: a hit, a miss, and a difficult box that is left out; class 1 is never found
    det, gt = evaluator_frames(spark)
    got = {r.class_id: r for r in ev.eval_detection(det, gt).collect()}
    assert [got[c].ap for c in range(2)] == pytest.approx([1 / 2, 0])
    assert [got[c].corloc for c in range(2)] == [1 / 2, 0]
    ap = ev.eval_detection(det, gt).select("ap")
    assert ev.mean_average_precision(ap).first()["map"] == pytest.approx(1 / 4)


def test_group_of_and_difficult(spark):
    gt = frame(
        spark, [(0, 0, 0, False, True), (1, 0, 0, True, False), (2, 0, 0, False, False)],
        "gt_id long, image_id long, class_id long, difficult boolean, group_of boolean", [[0, 0, 100, 100], [200, 200, 210, 210], [300, 300, 310, 310]],
    )
    det = frame(
        spark, [(0, 0, 0, 0.9), (1, 0, 0, 0.8), (2, 0, 0, 0.7), (3, 0, 0, 0.6), (4, 0, 0, 0.5)], "det_id long, image_id long, class_id long, score double",
        [[10, 10, 20, 20], [30, 30, 40, 40], [200, 200, 210, 210], [300, 300, 310, 310], [300, 300, 310, 310]],
    )
    best = ev.best_boxes(det, gt)
    rows = sorted((r.rank_id, r.score, r.tp) for r in ev.score_detections(best, 0.5, 1.0).collect())
    assert rows == [(-1, 0.9, 1.0), (3, 0.6, 1.0), (4, 0.5, 0.0)]
    rows = sorted((r.rank_id, r.tp) for r in ev.score_detections(best, 0.5, 0.0, duplicates="ignore").collect())
    assert rows == [(3, 1.0)]
    assert ev.gt_counts(gt, group_of_weight=1.0).first()["n_gt"] == 2.0


def test_pixel_inclusive_iou(spark):
    gt = frame(spark, [(0, 0, 0)], "gt_id long, image_id long, class_id long", [[0, 0, 9, 9]])
    det = frame(spark, [(0, 0, 0, 0.5)], "det_id long, image_id long, class_id long, score double", [[0, 9, 9, 18]])
    assert ev.best_boxes(det, gt, plus=1).first()["iou"] == pytest.approx(10 / 190)
    assert ev.best_boxes(det, gt).first()["iou"] == 0


def relation(spark, rows, extra):
    box = "struct<ymin:double,xmin:double,ymax:double,xmax:double>"
    data = [(*a, tuple(map(float, s)), tuple(map(float, o))) for a, s, o in rows]
    df = spark.createDataFrame(data, f"{extra}, subject {box}, object {box}")
    order = lambda c: F.struct(*(F.col(f"{c}.{n}").alias(n) for n in fb.BOX)).alias(c)
    return df.select(*(order(c) if c in ("subject", "object") else c for c in df.columns))


def test_relations(spark):
    names = "image_id long, subject_label long, object_label long, relation long"
    s, o = [0, 0, 10, 10], [10, 10, 20, 20]
    gt = relation(spark, [((0, 1, 7, 8, 9), s, o), ((1, 2, 7, 5, 9), s, o), ((2, 2, 7, 8, 6), s, o)], f"gt_id long, {names}")
    # a hit, a relation that the image does not have, and a label that was not verified there
    det = relation(
        spark, [((0, 1, 7, 8, 9, 0.9), s, o), ((1, 1, 7, 8, 6, 0.8), s, o), ((2, 1, 7, 3, 9, 0.7), s, [12, 12, 22, 22])], f"det_id long, {names}, score double",
    )
    labels = spark.createDataFrame([(1, l) for l in (5, 6, 7, 8, 9)], "image_id long, label long")
    got = {r.metric: r.value for r in ev.eval_relations(det, gt, labels=labels).collect()}
    # relation 9: one of two found, first in rank; relation 6: none of one
    assert got["ap_9"] == pytest.approx(1 / 2) and got["ap_6"] == 0
    assert got["weighted_ap"] == pytest.approx(2 / 3 * 1 / 2) and got["map"] == pytest.approx(1 / 4)
    assert got["recall_at_50"] == pytest.approx(1 / 3) and got["recall_at_100"] == pytest.approx(1 / 3)
    kept = lambda known: sorted(r.det_id for r in ev.verified_relations(det, gt, known).collect())
    assert kept(labels) == [0, 1]
    assert kept(labels.union(spark.createDataFrame([(1, 3)], labels.schema))) == [0, 1, 2]


def test_hierarchy(spark, tmp_path):
    doc = tmp_path / "h.json"
    leaf = lambda name, *below: {"LabelName": name, **({"Subcategory": list(below)} if below else {})}
    tree = leaf("thing", leaf("plant", leaf("tree", leaf("oak")), leaf("bush")), leaf("wood", leaf("oak"), leaf("desk")))
    doc.write_text(json.dumps(tree))
    edges = ds.hierarchy_edges(spark, str(doc))
    want = [("plant", "bush"), ("plant", "tree"), ("thing", "plant"), ("thing", "wood"), ("tree", "oak"), ("wood", "desk"), ("wood", "oak")]
    assert sorted(map(tuple, edges.collect())) == want
    pairs = ds.closure(edges, skip_root="thing")
    boxes = spark.createDataFrame([("i1", "oak"), ("i1", "bush")], "ImageID string, LabelName string")
    assert sorted(r.LabelName for r in ds.expand_boxes(boxes, pairs).collect()) == ["bush", "oak", "plant", "plant", "tree", "wood"]
    labels = spark.createDataFrame([("i1", "plant", 0.0), ("i1", "desk", 0.0), ("i2", "desk", 1.0)], "ImageID string, LabelName string, Confidence double")
    got = sorted((r.ImageID, r.LabelName) for r in ds.expand_labels(labels, pairs).collect())
    assert got == [("i1", "bush"), ("i1", "desk"), ("i1", "oak"), ("i1", "plant"), ("i1", "tree"), ("i2", "desk"), ("i2", "wood")]


def test_label_map(spark, tmp_path):
    f = tmp_path / "map.pbtxt"
    f.write_text('item {\n id: 3\n name: "cat"\n display_name: "Cat"\n}\nitem {\n name: \'dog\'\n id: 1\n}\nitem { id: 3 name: "late" }\n')
    rows = lambda **k: sorted(map(tuple, an.read_label_map(spark, str(f), **k).collect()))
    assert rows() == [(1, "dog"), (3, "cat")]
    assert rows(display=True) == [(1, "dog"), (3, "Cat")]
    assert rows(fill_gaps=True) == [(0, "background"), (1, "dog"), (2, "class_2"), (3, "cat")]
    f.write_text('item { id: 0 name: "cat" }\n')
    with pytest.raises(Exception, match="positive"):
        rows()


def test_assignment(spark):
    anchors = frame(spark, [(0, 0), (1, 0), (2, 0)], "det_id long, image_id long", [[0, 0, 10, 10], [0, 0, 10, 20], [50, 50, 60, 60]])
    gt = frame(spark, [(0, 0, 7), (1, 0, 8)], "gt_id long, image_id long, class_id long", [[0, 0, 10, 10], [55, 55, 65, 65]])
    rows = {r.det_id: r for r in assign.assign_targets(anchors, gt, 0.7, 0.4).collect()}
    assert [rows[i].match for i in range(3)] == [0, -2, -1]
    assert (rows[1].class_weight, rows[2].class_weight, rows[2].box_weight) == (0.0, 1.0, 0.0)
    forced = {r.det_id: r.match for r in assign.assign_targets(anchors, gt, 0.7, 0.4, force=True).collect()}
    assert forced == {0: 0, 1: -2, 2: 1}


@pytest.mark.parametrize("crowd", [False, True])
def test_coco_perfect(spark, crowd):
    boxes = [[10, 10, 130, 140], [40, 20, 90, 75], [5, 5, 25, 30]]  # large, medium, small
    rows = [(i, i, 1, False) for i in range(3)]
    gt = frame(spark, rows + ([(9, 0, 1, True)] if crowd else []), "gt_id long, image_id long, class_id long, is_crowd boolean", boxes + ([[9, 9, 130, 140]] if crowd else []))
    det = frame(spark, [(i, i, 1, 0.8) for i in range(3)], "det_id long, image_id long, class_id long, score double", boxes)
    m = coco.eval_coco(det, gt).first()
    assert m.ap == pytest.approx(1.0) and m.ar_100 == pytest.approx(1.0) and m.ap_small == pytest.approx(1.0)


def test_coco_takes_the_next_free_box(spark):
    gt = frame(spark, [(0, 0, 1), (1, 0, 1)], "gt_id long, image_id long, class_id long", [[0, 0, 100, 100], [0, 20, 100, 120]])
    det = frame(spark, [(0, 0, 1, 0.9), (1, 0, 1, 0.8)], "det_id long, image_id long, class_id long, score double", [[0, 0, 100, 100], [0, 5, 100, 105]])
    cells = {(r.t, r.band): r for r in coco.coco_cells(det, gt).collect()}
    assert cells[(0, "all")].ar_100 == 1.0  # the second detection falls back to the second box
    assert cells[(9, "all")].ar_100 == 0.5


def test_boxes(spark):
    df = frame(spark, [(0,), (1,)], "i long", [[0, 0, 10, 20], [90, 90, 110, 130]])
    clipped = ob.clip(df, window(0.0, 0.0, 100.0, 100.0)).orderBy("i").collect()
    assert (clipped[1].xmax, clipped[1].ymax) == (100, 100)
    with pytest.raises(Exception, match="exceeds"):
        ob.normalize(df, 50, 50).collect()
    with pytest.raises(ValueError):
        ob.union(df, df.drop("i"))
    with pytest.raises(ValueError):
        fb.similarity("none")
    with pytest.raises(ValueError):
        ev.evaluator("none")
    assert ev.evaluator("coco") is coco.eval_coco
    rint = spark.range(1).select(fb.center_rint(F.lit(0), F.lit(5)), fb.center_rint(F.lit(2), F.lit(5))).first()
    assert tuple(rint) == (2, 4)


def test_crop_corner_orders(spark):
    f = spark.createDataFrame([("00300_00600.xml",)], "filename string")
    assert tb.crop_corner(f).first()[1:] == (300, 600)
    assert tb.crop_corner(f, "y_x").first()[1:] == (600, 300)


def test_duplicate_records(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "image string, at long")
    assert sorted(map(tuple, ob.reject_duplicates(df, "image", "first", "at").select("image", "at").collect())) == [("a", 1), ("b", 3)]
    with pytest.raises(Exception, match="duplicate"):
        ob.reject_duplicates(df, "image", "error").collect()
