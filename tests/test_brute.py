"""Distributed operators against plain Python on small data, with crowds and copies."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions.boxes import Box
from tessella.operators import (
    assign, datasets as ds, evaluation as ev, graph, morphology as mo, nearest as nn, ordering as od, overlap as ov, patches, phenotype as ph,
    raster as ra, registration as rg, suppress as sp, unmix as um,
)
from tessella.sources import tables as tb

DET = "det_id long, image_id long, class_id long, score double, xmin double, ymin double, xmax double, ymax double"


def py_iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def random_boxes(n, seed, big=0.1, copies=0.3, size=200):
    """Boxes of very different sizes; a third of them copies of one box."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if r.random() < copies:
            b = (40.0, 40.0, 60.0, 61.0)
        else:
            s = r.choice([3, 8, 20]) if r.random() > big else r.choice([90, 150])
            x, y = r.randint(0, size), r.randint(0, size)
            b = (float(x), float(y), float(x + s), float(y + s + r.randint(0, 4)))
        rows.append((i, r.randint(0, 1), 0, round(r.random(), 2), *b))
    return rows


@pytest.mark.parametrize("cell", [4.0, 1000.0])
def test_box_pairs(spark, cell):
    a, b = random_boxes(80, 1), random_boxes(60, 2)
    got = ov.box_pairs(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET), ["image_id"], cell=cell)
    got = sorted((r[0], r[1]) for r in got.select("a.det_id", "b.det_id").collect())
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and py_iou(p[4:], q[4:]) > 0)
    assert got == want


def test_best_boxes_with_copies(spark):
    d, g = random_boxes(120, 3), random_boxes(60, 4)
    gt = spark.createDataFrame(g, DET.replace("det_id", "gt_id")).drop("score")
    best = {r.det_id: (r.iou, r.gt_id) for r in ev.best_boxes(spark.createDataFrame(d, DET), gt).collect()}
    for p in d:
        options = [(py_iou(p[4:], q[4:]), -q[0]) for q in g if q[1] == p[1]]
        v, k = max(options)
        assert best[p[0]][0] == pytest.approx(v)
        if v > 0:
            assert best[p[0]][1] == -k


def greedy(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(k[1] != r[1] or py_iou(k[4:], r[4:]) <= threshold for k in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed,threshold,n", [(5, 0.5, 60), (6, 0.0, 120)])
def test_nms(spark, n, seed, threshold):
    rows = random_boxes(n, seed)
    got = sp.nms(spark.createDataFrame(rows, DET), threshold, ["image_id"], cell=16.0)
    assert sorted(r.det_id for r in got.collect()) == greedy(rows, threshold)


def test_fuse_tiles(spark):
    r = random.Random(8)
    rows = []
    for i in range(150):
        s = r.randint(8, 24)
        x, y = r.randint(0, 300 - s), r.randint(0, 300 - s)
        for tx, ty in itertools.product((0, 90, 180), repeat=2):
            if x >= tx and y >= ty and x + s <= tx + 100 and y + s <= ty + 100:
                j = r.choice([0, 0, 1])
                rows.append((len(rows), tx, ty, r.random(), (x - tx + j) / 100, (y - ty) / 100, (x + s - tx) / 100, (y + s - ty) / 100))
    df = spark.createDataFrame(rows, "det_id long, tile_x long, tile_y long, score double, xmin double, ymin double, xmax double, ymax double")
    got = [(x.xmin, x.ymin, x.xmax, x.ymax) for x in sp.fuse_tiles(df, 100, 0.3, 0.5, max_side=23, edge=2).orderBy("ID").collect()]

    best = []
    for tile in {(t[1], t[2]) for t in rows}:
        mine = [(t[0], tile, 0, t[3], *t[4:]) for t in rows if (t[1], t[2]) == tile and t[3] > 0.3]
        keep = set(greedy(mine, 0.5))
        for t in mine:
            if t[0] in keep:
                b = [v * 100 for v in t[4:]]
                if b[2] - b[0] < 23 and b[3] - b[1] < 23 and min(b[:2]) >= 2 and max(b[2:]) <= 98:
                    best.append((t[0], 0, 0, t[3], int(b[0] + tile[0]), int(b[1] + tile[1]), int(b[2] + tile[0]), int(b[3] + tile[1])))
    center = lambda t: ((t[4] + t[6]) // 2, (t[5] + t[7]) // 2)
    gone = set()
    for c in best:
        ball = [t for t in best if math.dist(center(c), center(t)) <= 3]
        top = max(ball, key=lambda t: (t[3], -t[0]))
        gone |= {t[0] for t in ball if t is not top}
    rest = [t for t in best if t[0] not in gone]
    keep = set(greedy(rest, 0.5))
    want = [t[4:] for t in sorted(rest, key=lambda t: (-t[3], t[0])) if t[0] in keep]
    assert got == want and len(want) > 20


def test_nearest(spark):
    r = random.Random(9)
    p = [(i, r.randint(0, 5000), r.randint(0, 50)) for i in range(60)]
    q = [(i, 10 if i < 20 else r.randint(0, 5000), 10 if i < 20 else r.randint(0, 50)) for i in range(60)]
    got = nn.nearest(spark.createDataFrame(p, "ID long, x long, y long"), spark.createDataFrame(q, "near long, x long, y long"), "ID", "near", start=2.0)
    got = {x.ID: (x.distance, x.near) for x in got.collect()}
    for i, x, y in p:
        d, k = min((math.dist((x, y), (b, c)), j) for j, b, c in q)
        assert got[i][0] == pytest.approx(d) and got[i][1] == k


def test_ordering(spark):
    r = random.Random(10)
    rows = [(i, 0 if r.random() < 0.7 else r.randint(1, 3), r.choice([1.0, 2.0, 3.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k long, v double")
    order = [F.col("v").desc(), F.col("i")]
    # several ranges even on small data
    spread = df.repartitionByRange(7, F.col("k"), *order).withColumn(od.BUCKET, F.spark_partition_id())
    from tessella.runtime import stage

    staged = stage(spread)
    got = {x.i: (x.s, x.m) for x in od.running_max_from_end(od.running_sums(staged, ["k"], order, {"s": "v"}), ["k"], order, "i", "m").collect()}
    for k in range(4):
        seq = sorted((x for x in rows if x[1] == k), key=lambda x: (-x[2], x[0]))
        total = 0
        for n, x in enumerate(seq):
            total += x[2]
            assert got[x[0]] == (total, max(y[0] for y in seq[n:]))
    shards = od.contiguous_shards(df, order, 7).groupBy("shard").count().collect()
    assert sorted(s["count"] for s in shards) == [71] * 4 + [72] * 3


def test_graph_components(spark):
    r = random.Random(11)
    edges = [(0, i, i + 1) for i in range(200, 260)] + [(0, 999, i) for i in range(40)] + [(1, r.randint(0, 80), r.randint(0, 80)) for _ in range(60)]
    got = {(x.g, x.node): x.label for x in graph.components(spark.createDataFrame(edges, "g long, u long, v long"), ["g"]).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for g, u, v in edges:
        a, b = find((g, u)), find((g, v))
        root[max(a, b)] = min(a, b)
    assert got == {k: find(k)[1] for k in list(root) if any(k[0] == g and k[1] in (u, v) and u != v for g, u, v in edges)}


@pytest.mark.parametrize("diagonal", [False, True])
def test_label_across_blocks(spark, diagonal):
    rng = np.random.default_rng(12)
    on = np.argwhere(rng.random((50, 50)) < 0.55)
    df = spark.createDataFrame(pd.DataFrame(on, columns=["y", "x"]))
    got = {(r.y, r.x): r.label for r in mo.label(df, diagonal=diagonal, block=8).collect()}
    pixels = {tuple(map(int, p)) for p in on}
    want, steps = {}, [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for p in sorted(pixels):
        if p in want:
            continue
        stack, want[p] = [p], p
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                q = (y + dy, x + dx)
                if q in pixels and q not in want:
                    want[q] = p
                    stack.append(q)
    assert got == {k: v[0] * 2**32 + v[1] for k, v in want.items()}


def test_background_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(13)
    a = rng.integers(0, 100, (40, 50))
    px = spark.createDataFrame(pd.DataFrame([(1, y, x, int(a[y, x])) for y in range(40) for x in range(50)], columns=["channel", "y", "x", "value"]))

    def extreme(m, r, pick):
        out = np.empty_like(m)
        for y in range(40):
            for x in range(50):
                out[y, x] = pick(m[j, i] for j in range(max(0, y - r), min(40, y + r + 1)) for i in range(max(0, x - r), min(50, x + r + 1)) if (j - y) ** 2 + (i - x) ** 2 <= r * r)
        return out

    back = a
    for r in (2, 3):
        back = extreme(extreme(back, r, min), r, max)
    for block in (12, 64):
        out = mo.subtract_background(px, 40, 50, (4, 6), block).toPandas()
        got = np.zeros_like(a)
        got[out["y"], out["x"]] = out["value"]
        assert (got == np.maximum(a - back, 0)).all()


def test_patches(spark):
    px = spark.createDataFrame([("c", y, x, y * 10 + x) for y in range(12) for x in range(12)], "channel string, y long, x long, value long")
    boxes = spark.createDataFrame([(1, 2, 3, 6, 7), (2, 0, 0, 2, 4)], "ID long, xmin long, ymin long, xmax long, ymax long")
    got = {r.ID: np.array(r.patch).reshape(4, 4) for r in patches.extract(boxes, px, 12, 12, size=4).collect()}
    assert (got[1] == np.array([[y * 10 + x for x in range(2, 6)] for y in range(3, 7)])).all()
    assert (got[2] == np.array([[0, y * 10, y * 10 + 1, 0] for y in range(4)])).all()


def test_images_at_the_same_coordinates_do_not_mix(spark):
    """With an image key two images give the union of their single results."""
    from tessella.functions.boxes import BOX
    from tessella.operators import phenotype as ph, unmix as um

    r = random.Random(8)
    px = [(im, c, y, x, r.randrange(1, 200)) for im in (1, 2) for c in ("a", "b") for y in range(40) for x in range(40)]
    pixels = spark.createDataFrame(px, "image long, channel string, y long, x long, value long")
    boxes = [(im, 10 * im + i, x, y, x + 3 + i, y + 4 + 2 * i) for im in (1, 2) for i in range(4) for x, y in [(r.randrange(30), r.randrange(28))]]
    cells = spark.createDataFrame(boxes, "image long, ID long, xmin long, ymin long, xmax long, ymax long")
    weights = spark.createDataFrame([("a", "b", 0.25)], "target string, channel string, weight double")
    at = spark.createDataFrame([(im, i, r.randrange(40), r.randrange(40)) for im in (1, 2) for i in range(30)], "image long, ID long, centroid_x long, centroid_y long")
    areas = spark.createDataFrame([(im, k, f"r{im}{k}", y, x) for im in (1, 2) for k in (0, 1) for y in range(20 * k, 25 + 10 * k) for x in range(30)], "image long, list_order long, region string, y long, x long")
    jobs = {
        "patches": lambda p, q, on: patches.extract(q[0], p, 40, 40, margin=1, size=5, on=on, block=16),
        "unmix": lambda p, q, on: um.apply(p, weights, on=on),
        "regions": lambda p, q, on: ph.point_in_region(q[1], q[2], on=on),
    }
    key = lambda df: sorted(map(repr, df.collect()))
    for name, job in jobs.items():
        both = job(pixels, (cells, at, areas), ["image"])
        one = lambda im: job(pixels.where(f"image = {im}"), [d.where(f"image = {im}") for d in (cells, at, areas)], ["image"])
        assert key(both) == sorted(key(one(1)) + key(one(2))), name
    sizes = {r.ID: len(r.patch) for r in jobs["patches"](pixels, (cells, at, areas), ["image"]).collect()}
    assert len(sizes) == 8 and set(sizes.values()) == {25} and list(BOX)


def test_stream_equals_batch_after_every_delivery(spark, tmp_path):
    """Deliveries in any order, late copies that differ, difficult and group-of boxes, a batch that runs again."""

    from tessella.operators import evaluation as ev
    from tessella.streaming import evaluate as st

    rng, at = random.Random(4), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("ts")
    place = lambda i: [float(x) for x in ((i * 37) % 90, (i * 53) % 90, (i * 37) % 90 + 20, (i * 53) % 90 + 20)]
    gt = [(i, i % 4, i % 2, *place(i), i % 7 == 0, i % 11 == 0) for i in range(40)]
    det = [(i, i % 40 % 4, i % 2, rng.randrange(9) / 10, *(x + rng.randrange(5) for x in place(i % 40))) for i in range(120)]
    kinds = {"gt": (gt, st.GT_SCHEMA.removesuffix(", ts timestamp")), "det": (det, st.DET_SCHEMA.removesuffix(", ts timestamp"))}
    parts = {"gt": [gt[:10], gt[10:30] + [(*r[:3], *(x + 9 for x in r[3:7]), *r[7:]) for r in gt[:5]], gt[30:]], "det": [det[:80], det[60:], []]}
    folder = lambda n: str(tmp_path / n)
    for step in range(3):
        for name, (_, schema) in kinds.items():
            spark.createDataFrame(parts[name][step], schema).select("*", at).coalesce(1).write.mode("append").parquet(folder(name))
        st.stream_eval(spark, folder("gt"), folder("det"), folder("out"), group_of_weight=0.5)
        come = {n: list({r[0]: r for part in parts[n][step::-1] for r in part[::-1]}.values()) for n in kinds}
        g, d = (spark.createDataFrame(come[n], kinds[n][1]) for n in ("gt", "det"))
        want = ev.average_precision(ev.score_detections(ev.best_boxes(d, g), 0.5, 0.5), ev.gt_counts(g, group_of_weight=0.5))
        key = lambda df: sorted((r.class_id, r.n_gt, round(r.ap, 9)) for r in df.collect())
        assert key(st.current_ap(spark, folder("out"))) == key(want)
        assert sorted(r.det_id for r in st.accepted(spark, folder("out"), "det").collect()) == sorted(r[0] for r in come["det"])
    again = spark.read.parquet(folder("out") + "/delivery/batch=1").drop("bucket")
    st.fold(spark.createDataFrame(again.collect(), again.schema), 1, folder("out"), 0.5, 0.5)
    assert key(st.current_ap(spark, folder("out"))) == key(want)


def test_running_mean_shows_open_windows(spark, tmp_path):
    from tessella.streaming import evaluate as st

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "at timestamp, loss double, ok boolean"
    deliveries = [[("2024-01-01 10:00", 1.0, True), ("2024-01-02 10:00", 2.0, False)], [("2024-01-02 11:00", 4.0, True), ("2024-01-03 00:30", 5.0, True)]]
    want = [{1: (1.0, 1.0, 1), 2: (2.0, 0.0, 1)}, {1: (1.0, 1.0, 1), 2: (3.0, 0.5, 2), 3: (5.0, 1.0, 1)}]
    for rows, now in zip(deliveries, want):
        spark.createDataFrame(rows, "at string, loss double, ok boolean").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(source)
        means = st.running_mean(spark.readStream.schema(schema).parquet(source), "loss", F.col("ok"), "1 day", "at")
        st.upsert(means, out)
        got = st.latest(spark, out, means.schema, ["start"]).withColumn("day", F.dayofmonth("start")).collect()
        assert {r.day: (r.mean_loss, r.accuracy, r.n) for r in got} == now


def test_ransac(spark):
    r = random.Random(14)
    true = np.array([[1.02, 0.03, 15], [-0.02, 0.98, -8], [0, 0, 1]])
    rows = []
    for i in range(300):
        x, y = r.uniform(0, 1000), r.uniform(0, 1000)
        u, v, _ = map(float, true @ [x, y, 1])
        if i % 4 == 0:
            u, v = r.uniform(0, 1000), r.uniform(0, 1000)
        rows.append((i, int(y // 250) * 4 + int(x // 250), x, y, u, v))
    m = spark.createDataFrame(rows, "match_id long, tile long, src_x double, src_y double, dst_x double, dst_y double")
    for kind, objective, k in (("affine", "inlier_num", 3), ("projective", "inlier_tile", 4)):
        fit = rg.fit_ransac(m, kind, k, 3.0, max_trials=40, objective=objective, wave=20)
        assert np.allclose(fit["matrix"], true, atol=0.05), (kind, objective, fit)
    one = rg.fit_ransac(m.withColumn("tile", F.lit(0).cast("long")), "affine", 3, 3.0, max_trials=40)
    assert np.allclose(one["matrix"], true, atol=0.05)


def test_mutual_matches(spark):
    r = random.Random(15)
    code = lambda: [r.getrandbits(63), r.getrandbits(63)]
    base = [code() for _ in range(30)]
    left = [(i, i % 3, c) for i, c in enumerate(base)] + [(100 + i, 0, base[0]) for i in range(20)]
    right = [(i, i % 3, [c[0] ^ (1 << r.randint(0, 60)), c[1]]) for i, c in enumerate(base)]
    cols = "kp_id long, tile long, descriptor array<long>"
    got = rg.mutual_matches(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), 2, ["tile"])
    assert sorted((x.left_id, x.right_id, x.dist) for x in got.collect()) == [(i, i, 1) for i in range(30)]


def test_lasso(spark):
    rng = np.random.default_rng(16)
    n1, n2 = rng.random((30, 30)), rng.random((30, 30))
    s = 0.3 * n1 + 0.2 + 0.01 * rng.random((30, 30))
    rows = [(c, y, x, float(a[y, x])) for c, a in (("s", s), ("a", n1), ("b", n2)) for y in range(30) for x in range(30)]
    w = um.fit_lasso(spark.createDataFrame(rows, "channel string, y long, x long, value double"), ["s", "a", "b"], alpha=1e-4, scale=1.0)
    got = {(r.target, r.channel): r.weight for r in w.collect()}
    assert got[("s", "a")] == pytest.approx(0.3, abs=0.01) and got[("s", "b")] == pytest.approx(0, abs=0.01)
    assert all(v >= 0 for v in got.values())


def test_bipartite(spark):
    a, b = random_boxes(40, 17, copies=0.1), random_boxes(40, 18, copies=0.1)
    got = assign.bipartite_greedy(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET).withColumnRenamed("det_id", "gt_id"), "det_id", "gt_id")
    pairs = sorted(((-py_iou(p[4:], q[4:]), p[0], q[0]) for p in a for q in b if p[1] == q[1] and py_iou(p[4:], q[4:]) > 0))
    used_a, used_b, want = set(), set(), []
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.append((i, j))
    assert sorted((r.det_id, r.gt_id) for r in got.collect()) == sorted(want)


def test_types_wide_equals_long(spark):
    r = random.Random(19)
    cells = spark.createDataFrame([(i, *(r.randint(0, 1) for _ in range(3))) for i in range(200)], "ID long, a int, b int, c int")
    rules = ph.rules_to_long(spark.createDataFrame([(0, "x", "+", "+-", "-"), (1, "y", "-", "", "+"), (2, "z", "+", "+", "+-")], "rule_order int, Type string, a string, b string, c string"))
    wide = sorted(map(str, ph.assign_types_wide(cells, rules).collect()))
    assert wide == sorted(map(str, ph.assign_types(ph.to_long(cells), rules).select("ID", "cell_type").collect()))


def test_mask_text_in_row_order(spark, tmp_path):
    a = np.random.default_rng(20).integers(0, 3, (40, 7))
    (tmp_path / "m.txt").write_text("\n".join(",".join(map(str, row)) for row in a) + "\n")
    out = tb.read_mask_array(spark, str(tmp_path / "m.txt")).toPandas()
    got = np.zeros_like(a)
    got[out["y"], out["x"]] = out["label"]
    assert (got == a).all()


def test_samples(spark):
    df = spark.range(1000).selectExpr("id AS ID", "id % 10 = 0 AS positive")
    s = ds.sample_balanced(df, "ID", "positive", 100, 0.25)
    assert s.count() == 100 and s.where("positive").count() == 25
    few = ds.sample_balanced(df.where("NOT positive OR ID < 50"), "ID", "positive", 100, 0.25)
    assert few.count() == 100 and few.where("positive").count() == 5
    split = {r.split: r["count"] for r in ds.train_test(df, "ID").groupBy("split").count().collect()}
    assert 150 < split["test"] < 250 and ds.validation_head(df, "ID", 37).where("split = 'validation'").count() == 37


def test_merge_tiles(spark):
    t = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 10, 10, 20, 20), (2, 20, 15, 30, 25), (3, 100, 100, 110, 110)], "tile_id long, row0 long, col0 long, row1 long, col1 long")
    got = sorted((r.row0, r.col0, r.row1, r.col1, r.tiles) for r in mo.merge_tiles(t, 5).collect())
    assert got == [(0, 0, 35, 30, 3), (100, 100, 110, 110, 1)]


def test_local_refit(spark):
    pts = [(i, float(5 * i % 97), float(7 * i % 89)) for i in range(60)]
    rows = [(i, 0, x, y, x + (3 if y < 40 else 0), y) for i, x, y in pts]
    m = spark.createDataFrame(rows, "match_id long, tile long, src_x double, src_y double, dst_x double, dst_y double")
    region = spark.createDataFrame([(1, y, x) for y in range(40) for x in range(110)], "label long, y long, x long")
    p = spark.createDataFrame(pts, "ID long, x double, y double")
    out = rg.local_refit(p, m, np.eye(3), region).collect()
    assert all(math.isclose(r.wx, r.x + (3 if r.y < 40 else 0), abs_tol=1e-6) and r.local == (r.y < 40) for r in out)


def test_local_refit_recovers_each_region_from_wrong_matches(spark):
    """Regions of 40 % wrong matches, a different transform in each; the global transform fits none of them."""
    r = random.Random(23)
    true = {1: [[1.01, 0.02, 40], [-0.01, 0.99, 25], [0, 0, 1]], 2: [[0.98, -0.03, -30], [0.02, 1.02, 60], [0, 0, 1]]}
    rows, pixels = [], [(lab, y, x) for lab, left in ((1, 0), (2, 400)) for y in range(200) for x in range(left, left + 200)]
    for i in range(400):
        lab = 1 + i % 2
        u, v = r.uniform((lab - 1) * 400, (lab - 1) * 400 + 199), r.uniform(0, 199)
        x, y, _ = np.linalg.inv(np.array(true[lab])) @ [u, v, 1]
        if i % 10 < 4:
            x, y = r.uniform(0, 600), r.uniform(0, 200)
        rows.append((i, 0, float(x), float(y), u, v))
    m = spark.createDataFrame(rows, "match_id long, tile long, src_x double, src_y double, dst_x double, dst_y double")
    region = spark.createDataFrame([*pixels, (3, 900, 900)], "label long, y long, x long")
    inside = m.join(region, (F.floor("dst_y") == region.y) & (F.floor("dst_x") == region.x)).select("label", *m.columns)
    for kind, k in (("affine", 3), ("projective", 4)):
        got = {r.label: np.array(r.model).reshape(3, 3) for r in rg.region_models(inside, kind, k, threshold=2.0, trials=60).collect()}
        assert set(got) == {1, 2} and all(np.allclose(got[k], true[k], atol=0.05) for k in got), (kind, got)
    p = spark.createDataFrame([(0, 100.0, 100.0), (1, 500.0, 100.0), (2, 300.0, 100.0), (3, 900.0, 900.0)], "ID long, x double, y double")
    out = {r.ID: (r.local, r.wx, r.wy) for r in rg.local_refit(p, m, np.eye(3), region, threshold=2.0).collect()}
    for i, lab in ((0, 1), (1, 2)):
        x, y = (100.0, 100.0) if i == 0 else (500.0, 100.0)
        u, v, _ = np.array(true[lab]) @ [x, y, 1]
        assert out[i][0] and math.isclose(out[i][1], u, abs_tol=0.5) and math.isclose(out[i][2], v, abs_tol=0.5)
    assert out[2] == (False, 300.0, 100.0) and out[3] == (False, 900.0, 900.0)
    assert rg.region_models(inside.limit(0)).count() == 0


def test_ransac_grid_equals_single_fits(spark):
    r = random.Random(24)
    rows = []
    for i in range(200):
        x, y = r.uniform(0, 500), r.uniform(0, 500)
        wrong = r.uniform(0, 60) if i % 3 == 0 else 0
        rows.append((i, int(x // 100), x, y, 1.01 * x - 0.02 * y + 9 + r.gauss(0, 1.5) + wrong, 0.03 * x + y - 4 + r.gauss(0, 1.5)))
    m = spark.createDataFrame(rows, "match_id long, tile long, src_x double, src_y double, dst_x double, dst_y double")
    grid = rg.search_ransac(m, "affine", (3, 5), (6, 2, 4), max_trials=20, seed=3)
    assert [(g["objective"], g["min_samples"], g["threshold"]) for g in grid] == [(o, k, t) for o in ("inlier_num", "inlier_tile") for k in (3, 5) for t in (6.0, 2.0, 4.0)]
    for g in grid[::3] + grid[1::4]:
        one = rg.fit_ransac(m, "affine", g["min_samples"], g["threshold"], max_trials=20, objective=g["objective"], wave=20, seed=3)
        assert (g["inlier_num"], g["trials"]) == (one["inlier_num"], one["trials"])
        assert np.allclose(g["matrix"], one["matrix"]) and math.isclose(g["inlier_tile"], one["inlier_tile"]) and math.isclose(g["residuals_sum"], one["residuals_sum"])
    assert rg.search_ransac(m.limit(0), samples=(3,), thresholds=(2,), objectives=("inlier_num",))[0]["matrix"] is None


def test_fill_and_outline(spark):
    lab = spark.createDataFrame([(1, 0, 0), (1, 2, 2)], "label long, y long, x long")
    assert mo.fill_boxes(lab).count() == 9
    box = spark.createDataFrame([(0, 0, 3, 3)], "xmin long, ymin long, xmax long, ymax long")
    assert ra.paint_outlines(box).count() == 12


def test_stage_needs_a_shared_folder(spark):
    from tessella.runtime import shared_dir

    assert shared_dir(spark) == shared_dir(spark)


def test_scratch_blocks_of_threads_are_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from tessella.runtime import scratch, stage

    together = Barrier(2)

    def work(n):
        with scratch(spark):
            together.wait(60)
            kept = stage(spark.range(n), "numbers")
            folder = kept.inputFiles()[0].split("/numbers-")[0]
            if n == 3:
                together.wait(60)  # the other block is closed now
            out = kept.count()
        if n != 3:
            together.wait(60)
        return out, folder

    with ThreadPoolExecutor(2) as pool:
        (a, one), (b, two) = pool.map(work, (3, 5))
    assert (a, b) == (3, 5) and one != two


def test_noisy_codes_meet_few_candidates(spark):
    """256-bit codes with up to 30 wrong bits: exact partners from probes of bands, without the product of the tile."""

    from tessella.operators import registration as rg

    rng = random.Random(2)
    words = lambda x: [(x >> 64 * i & (2**64 - 1)) - (2**64 if x >> 64 * i & 2**63 else 0) for i in range(4)]
    codes = [rng.getrandbits(256) for _ in range(600)]
    noisy = []
    for i, c in enumerate(codes):
        for bit in rng.sample(range(256), rng.choice([0, 5, 14, 20, 30]) if i % 50 else 60):
            c ^= 1 << bit
        noisy.append(c)
    schema = "tile int, id int, code array<bigint>"
    left, right = (spark.createDataFrame([(i % 2 and 7, i, words(c)) for i, c in enumerate(x)], schema) for x in (codes, noisy))
    got = {r.id: (r.dist, r.oid) for r in rg._nearest_code(left, right, ["tile"], 4).collect()}
    want = {i: min(((c ^ d).bit_count(), j) for j, d in enumerate(noisy) if j % 2 == i % 2) for i, c in enumerate(codes)}
    assert got == want
    index = rg.banded(right.select("tile", F.col("code").alias("other"), F.col("id").alias("oid")), 4)
    assert sum(rg.probed(left, index, ["tile"], 4, r).count() for r in (0, 1)) < 600 * 300 / 10


def test_zonal_means_across_tiles(spark):

    from tessella.operators import raster as ra

    rng = random.Random(6)
    image = {(c, y, x): rng.randrange(100) for c in "ab" for y in range(-5, 40) for x in range(50) if rng.random() < 0.7 and (c == "a" or x < 20)}
    boxes = [(i, y, x, y + rng.randrange(0, 30), x + rng.randrange(1, 30)) for i in range(60) for y, x in [(rng.randrange(-8, 38), rng.randrange(0, 48))]]
    boxes += [(100, *boxes[3][1:]), (101, -100, -100, 200, 200), (102, 500, 500, 510, 510)]
    b = spark.createDataFrame(boxes, "ID long, ymin long, xmin long, ymax long, xmax long")
    p = spark.createDataFrame([(*k, v) for k, v in image.items()], "channel string, y long, x long, value long")
    want = {}
    for i, y0, x0, y1, x1 in boxes:
        for c in "ab":
            inside = [v for (d, y, x), v in image.items() if d == c and y0 <= y < y1 and x0 <= x < x1]
            if inside:
                want[i, c] = sum(inside) / ((y1 - y0) * (x1 - x0))
    for tile in (8, 64):
        got = {(r.ID, r.channel): r["mean"] for r in ra.zonal_mean(b, p, tile=tile).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_dilation_and_erosion_of_large_shapes(spark):

    from tessella.operators import morphology as mo

    rng = random.Random(8)
    mask = {(rng.randrange(0, 150), rng.randrange(-20, 150)) for _ in range(25)} | {(y, x) for y in range(30, 130) for x in range(20, 125)}
    for shape, radius in (("disc", 40), ("disc", 3), ("square", 5), ("disc", 0)):
        inside = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if shape == "square" or dy * dy + dx * dx <= radius**2]
        grid = np.zeros((320, 320), bool)
        for y, x in mask:
            grid[y + 80, x + 80] = True
        shifted = lambda g, op: op([np.roll(g, o, (0, 1)) for o in inside])
        grown = shifted(grid, np.logical_or.reduce)
        pixels = lambda g: {(int(y) - 80, int(x) - 80) for y, x in zip(*np.nonzero(g))}
        df = spark.createDataFrame([(1, *m) for m in mask] * 2, "slide int, y long, x long")
        got = lambda out: sorted((r.y, r.x) for r in out.collect())
        assert got(mo.dilate(df, radius, shape, ["slide"])) == sorted(pixels(grown))
        assert got(mo.erode(df, radius, shape)) == sorted(pixels(shifted(grid, np.logical_and.reduce)))
        assert got(mo.close(df, radius, shape)) == sorted(pixels(shifted(grown, np.logical_and.reduce)))


def plain_greedy(n, edges):
    """Rows dropped by a scan of 0..n-1 in order, over pairs (better, worse)."""
    below, gone = {}, set()
    for a, b in edges:
        below.setdefault(a, []).append(b)
    for i in range(n):
        if i not in gone:
            gone.update(below.get(i, []))
    return gone


@pytest.mark.parametrize("limit", [100_000, 60])
def test_chains_need_few_tables(spark, monkeypatch, limit):
    from tessella.operators import conflict, suppress

    monkeypatch.setattr(conflict, "LIMIT", limit)
    tables, stage = [], conflict.stage
    monkeypatch.setattr(conflict, "stage", lambda df, name="": tables.append(name) or stage(df, name))
    rng = random.Random(1)
    small = [(10 * a + i, 10 * a + j) for a in range(500, 530) for i in range(9) for j in rng.sample(range(i + 1, 10), 1)]
    edges = [(i, i + 1) for i in range(70 if limit < 400 else 2000)] + small
    got = {r.loser for r in conflict.greedy_losers(spark.createDataFrame(edges + edges[:9], "winner long, loser long")).collect()}
    assert got == plain_greedy(6200, edges)
    if limit < 400:
        return
    assert len(tables) <= 8
    boxes = [(i, 1 - i / 5000, 0.0, 5.0 * i, 10.0, 5.0 * i + 10) for i in range(300)]
    kept = suppress.nms(spark.createDataFrame(boxes, "det_id long, score double, ymin double, xmin double, ymax double, xmax double"), 0.3)
    assert {r.det_id for r in kept.collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("limit", [100_000, 40])
def test_one_to_one_over_chains(spark, monkeypatch, limit):
    from tessella.operators import conflict

    monkeypatch.setattr(conflict, "LIMIT", limit)
    rng = random.Random(3)
    edges = [(k, l, r, v) for k in (0, 1) for l in range(22) for r, v in ((l, 0.9 - l / 1000), (l + 1, 0.9 - l / 1000 - 0.0005))]
    edges += [(2, rng.randrange(30), rng.randrange(30), rng.randrange(8) / 8) for _ in range(200)]
    edges = list({e[:3]: e for e in edges}.values())
    left, right, want = set(), set(), set()
    for k, l, r, v in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if (k, l) not in left and (k, r) not in right:
            left.add((k, l))
            right.add((k, r))
            want.add((k, l, r, v))
    out = conflict.one_to_one(spark.createDataFrame(edges, "image_id int, l long, r long, v double"), ["image_id"])
    assert {tuple(r) for r in out.select("image_id", "l", "r", "v").collect()} == want
