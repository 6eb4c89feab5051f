"""Queries on box algebra, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as fb, pixels as px, points as pt
from ..functions.boxes import Box, window
from ..operators import boxes as ob, ordering as od
from .evaluation import GT_DET, sql_iou, sql_inter
from .registry import query

B4 = ["xmin", "ymin", "xmax", "ymax"]


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def rs(*pairs):
    """SQL select list of rounded expressions."""
    return ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in pairs)


@query("box_center_floor", "SELECT ID, (xmin + xmax) // 2 AS cx, (ymin + ymax) // 2 AS cy FROM cells", ["cells"])
def _(t):
    return t.cells.select(
        "ID", fb.center_floor(F.col("xmin"), F.col("xmax")).alias("cx"), fb.center_floor(F.col("ymin"), F.col("ymax")).alias("cy")
    )


@query(
    "box_center_rint",
    "SELECT ID, CAST(ROUND_EVEN((xmin + xmax) / 2.0, 0) AS BIGINT) AS cx, CAST(ROUND_EVEN((ymin + ymax) / 2.0, 0) AS BIGINT) AS cy FROM cells",
    ["cells"],
)
def _(t):
    return t.cells.select(
        "ID", fb.center_rint(F.col("xmin"), F.col("xmax")).alias("cx"), fb.center_rint(F.col("ymin"), F.col("ymax")).alias("cy")
    )


@query(
    "box_area_hw",
    "SELECT gt_id, (xmax - xmin) * (ymax - ymin) AS area, ymax - ymin AS h, xmax - xmin AS w, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM gt",
    ["gt"],
)
def _(t):
    b = Box.of()
    return t.gt.select(
        "gt_id", b.area().alias("area"), b.height().alias("h"), b.width().alias("w"),
        ((b.xmin + b.xmax) / 2).alias("cx"), ((b.ymin + b.ymax) / 2).alias("cy"),
    )


@query(
    "box_iou_matched",
    f"""SELECT d.det_id, {sql_inter('d', 'g')} AS intersection, ROUND({sql_iou('d', 'g')}, 6) AS iou
FROM det d JOIN orders o ON o.o_orderkey = d.det_id JOIN gt g ON g.gt_id = o.o_custkey""",
    GT_DET,
)
def _(t):
    pairs = t.det.alias("d").join(t.orders.alias("o"), F.expr("o_orderkey = det_id")).join(
        t.gt.alias("g"), F.expr("g.gt_id = o_custkey")
    )
    a, b = Box.of("d"), Box.of("g")
    return pairs.select("det_id", fb.intersection(a, b).alias("intersection"), F.round(fb.iou(a, b), 6).alias("iou"))


@query("box_scale", "SELECT gt_id, xmin * 2.0 AS xmin, ymin * 0.5 AS ymin, xmax * 2.0 AS xmax, ymax * 0.5 AS ymax FROM gt", ["gt"])
def _(t):
    return ob.scale(t.gt, 0.5, 2.0).select("gt_id", *B4)


@query("box_normalize", f"SELECT gt_id, {rs(('xmin', 'xmin / 512'), ('ymin', 'ymin / 512'), ('xmax', 'xmax / 512'), ('ymax', 'ymax / 512'))} FROM gt", ["gt"])
def _(t):
    return r6(ob.normalize(t.gt, 512, 512).select("gt_id", *B4), *B4)


@query("box_absolute", f"SELECT gt_id, {rs(*((n, f'{n} / 512 * 300') for n in B4))} FROM gt", ["gt"])
def _(t):
    return r6(ob.absolute(ob.normalize(t.gt, 512, 512), 300, 300).select("gt_id", *B4), *B4)


@query(
    "box_clip",
    """SELECT * FROM (SELECT gt_id, GREATEST(LEAST(xmin, 350), 50) AS xmin, GREATEST(LEAST(ymin, 380), 20) AS ymin,
GREATEST(LEAST(xmax, 350), 50) AS xmax, GREATEST(LEAST(ymax, 380), 20) AS ymax FROM gt) WHERE (xmax - xmin) * (ymax - ymin) > 0""",
    ["gt"],
)
def _(t):
    return ob.clip(t.gt, window(50.0, 20.0, 350.0, 380.0)).select("gt_id", *B4)


@query(
    "box_change_frame",
    f"SELECT gt_id, {rs(('xmin', '(xmin - 50) / 300'), ('ymin', '(ymin - 20) / 360'), ('xmax', '(xmax - 50) / 300'), ('ymax', '(ymax - 20) / 360'))} FROM gt",
    ["gt"],
)
def _(t):
    return r6(ob.change_frame(t.gt, window(50.0, 20.0, 350.0, 380.0)).select("gt_id", *B4), *B4)


@query(
    "box_flip_rot",
    "WITH n AS (SELECT gt_id, xmin / 512 AS x0, ymin / 512 AS y0, xmax / 512 AS x1, ymax / 512 AS y1 FROM gt) "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS op, gt_id, {rs(*zip(B4, e))} FROM n"
        for k, e in {
            "flip_lr": ("1 - x1", "y0", "1 - x0", "y1"), "flip_ud": ("x0", "1 - y1", "x1", "1 - y0"),
            "rot90": ("y0", "1 - x1", "y1", "1 - x0"), "undo_mirror": ("1 - x0", "y0", "1 - x1", "y1"),
        }.items()
    ),
    ["gt"],
)
def _(t):
    unit = ob.normalize(t.gt, 512, 512).select("gt_id", *B4)
    b = Box.of()
    kinds = {"flip_lr": b.flip_left_right(), "flip_ud": b.flip_up_down(), "rot90": b.rot90(), "undo_mirror": b.undo_mirror()}
    rows = F.array(
        *(F.struct(F.lit(k).alias("op"), *(F.round(c, 6).alias(n) for n, c in box.columns().items())) for k, box in kinds.items())
    )
    return unit.select("gt_id", F.inline(rows))


@query(
    "box_sanitize",
    """SELECT * FROM (SELECT det_id, ROUND(GREATEST(LEAST(LEAST(a, c), 1), 0), 6) AS xmin, ROUND(GREATEST(LEAST(LEAST(b, d), 1), 0), 6) AS ymin,
ROUND(GREATEST(LEAST(GREATEST(a, c), 1), 0), 6) AS xmax, ROUND(GREATEST(LEAST(GREATEST(b, d), 1), 0), 6) AS ymax FROM
(SELECT det_id, CASE WHEN det_id % 2 = 0 THEN xmax ELSE xmin END / 400 - 0.01 AS a, ymin / 400 AS b, CASE WHEN det_id % 2 = 0 THEN xmin ELSE xmax END / 400 - 0.01 AS c, ymax / 400 AS d FROM det))
WHERE xmin < xmax AND ymin < ymax""",
    GT_DET,
)
def _(t):
    odd = F.col("det_id") % 2 == 0
    raw = t.det.select(
        "det_id", (F.when(odd, F.col("xmax")).otherwise(F.col("xmin")) / 400 - 0.01).alias("xmin"), (F.col("ymin") / 400).alias("ymin"),
        (F.when(odd, F.col("xmin")).otherwise(F.col("xmax")) / 400 - 0.01).alias("xmax"), (F.col("ymax") / 400).alias("ymax"),
    )
    return r6(ob.sanitize(raw), *B4)


@query(
    "box_erode_margin",
    """SELECT ID, LEAST(xmin + 8, xmax - 8) AS xmin, LEAST(ymin + 8, ymax - 8) AS ymin, GREATEST(xmin + 8, xmax - 8) AS xmax, GREATEST(ymin + 8, ymax - 8) AS ymax,
GREATEST(xmin - 60, 0) AS gx0, GREATEST(ymin - 60, 0) AS gy0, LEAST(xmax + 60, 4000) AS gx1, LEAST(ymax + 60, 3000) AS gy1 FROM cells""",
    ["cells"],
)
def _(t):
    b = Box.of()
    grown = b.grow(60, 4000, 3000).columns(["gx0", "gy0", "gx1", "gy1"])
    return ob.put(t.cells.withColumns(grown), b.erode(8)).select("ID", *B4, *grown)


LOCAL = "(xmin - centroid_x // 300 * 300) AS xmin, (ymin - centroid_y // 300 * 300) AS ymin, (xmax - centroid_x // 300 * 300) AS xmax, (ymax - centroid_y // 300 * 300) AS ymax"


def _corner(size=300):
    return F.floor(F.col("centroid_x") / size) * size, F.floor(F.col("centroid_y") / size) * size


@query("crop_to_local", f"SELECT ID, {LOCAL} FROM cells", ["cells"])
def _(t):
    return ob.to_local(t.cells, *_corner()).select("ID", *B4)


@query("crop_to_global", "SELECT ID, xmin, ymin, xmax, ymax FROM cells", ["cells"])
def _(t):
    cx, cy = _corner()
    local = ob.to_local(t.cells.withColumns({"cx": cx, "cy": cy}), F.col("cx"), F.col("cy"))
    unit = ob.scale(local, 1 / 300, 1 / 300)
    out = ob.to_global(unit, F.col("cx"), F.col("cy"), 300, 300)
    return out.select("ID", *(F.round(c, 0).cast("long").alias(c) for c in B4))


@query(
    "truncate_flag",
    f"""WITH l AS (SELECT ID, {LOCAL} FROM cells), f AS (SELECT *, xmin < 0 OR ymin < 0 OR xmax > 300 OR ymax > 300 AS c FROM l)
SELECT ID, CAST(c AS BIGINT) AS truncated, """
    + ", ".join(f"CASE WHEN c THEN GREATEST(LEAST({n}, 299), 1) ELSE {n} END AS {n}" for n in B4)
    + " FROM f",
    ["cells"],
)
def _(t):
    out = ob.truncate(ob.to_local(t.cells, *_corner()), 300, 300)
    return out.select("ID", F.col("truncated").cast("long").alias("truncated"), *B4)


@query(
    "mirror_downscale",
    "SELECT ID, centroid_x, 3100 - centroid_y AS centroid_y, CAST(TRUNC(centroid_x / 3.5) AS BIGINT) AS centroid_x_ds, CAST(TRUNC((3100 - centroid_y) / 3.5) AS BIGINT) AS centroid_y_ds FROM cells",
    ["cells"],
)
def _(t):
    return ob.mirror_downscale(t.cells, 3100, 3.5).select("ID", "centroid_x", "centroid_y", "centroid_x_ds", "centroid_y_ds")


@query(
    "table_offset",
    "SELECT ID, xmin + 1200 AS xmin, ymin + 700 AS ymin, xmax + 1200 AS xmax, ymax + 700 AS ymax, centroid_x + 1200 AS centroid_x, centroid_y + 700 AS centroid_y FROM cells",
    ["cells"],
)
def _(t):
    return ob.offset(t.cells, 1200, 700).select("ID", *B4, "centroid_x", "centroid_y")


@query("area_um2", "SELECT ID, ROUND((xmax - xmin) * (ymax - ymin) * 0.105625::DOUBLE, 6) AS area FROM cells", ["cells"])
def _(t):
    return t.cells.select("ID", F.round(px.area_um2(Box.of().area()), 6).alias("area"))


@query(
    "density",
    """SELECT slide, COUNT(*) AS n, ROUND(COUNT(*) * 1e6 / (SUM((xmax - xmin) * (ymax - ymin)) * 0.105625), 3) AS density FROM cells GROUP BY slide""",
    ["cells"],
)
def _(t):
    sums = t.cells.groupBy("slide").agg(F.count("*").alias("n"), F.sum(Box.of().area()).alias("pixels"))
    return sums.select("slide", "n", F.round(px.density(F.col("n"), F.col("pixels")), 3).alias("density"))


@query(
    "pixel_normalize",
    """WITH u AS (SELECT y, x, CASE WHEN y % 2 = 0 THEN value / 65535.0 ELSE (value % 256) / 255.0 END::DOUBLE AS v FROM raster),
s AS (SELECT x, AVG(v) AS mean, STDDEV_POP(v) AS std FROM u GROUP BY x)
SELECT y, u.x AS x, ROUND(CASE WHEN std > 0 THEN (v - mean) / std ELSE 0 END, 5) AS value FROM u JOIN s ON u.x = s.x""",
    ["raster"],
)
def _(t):
    even = F.col("y") % 2 == 0
    dtype = F.when(even, F.lit("uint16")).otherwise(F.lit("uint8"))
    value = F.when(even, F.col("value")).otherwise(F.col("value") % 256)
    unit = t.raster.select("y", "x", px.unit_range(value, dtype).alias("value"))
    return px.standardize(unit, ["x"]).select("y", "x", F.round("value", 5).alias("value"))


@query(
    "levels_rescale",
    """WITH ch AS (SELECT y // 100 AS channel, y, x, value FROM raster), e AS (SELECT channel, MIN(value) AS lo, MAX(value) AS hi FROM ch GROUP BY channel)
SELECT channel, y, x, CAST(FLOOR((value - lo) * 65535.0::DOUBLE / (hi - lo)) AS BIGINT) AS value,
CAST(FLOOR((GREATEST(LEAST(value, 5 * 257), 3 * 257) - 771) * 65535.0::DOUBLE / 514) AS BIGINT) AS leveled FROM ch JOIN e USING (channel)""",
    ["raster"],
)
def _(t):
    ch = t.raster.withColumn("channel", F.floor(F.col("y") / 100))
    low, high = px.levels(F.lit("3,5"), "uint16")
    both = ch.withColumn("leveled", px.stretch(F.col("value"), low, high, 65535))
    return px.rescale(both, ["channel"], "uint16").select("channel", "y", "x", "value", "leveled")


@query(
    "rule_token_map",
    "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::BIGINT AS flag FROM part",
)
def _(t):
    token = F.when(F.col("p_partkey") % 3 == 0, "+").when(F.col("p_partkey") % 3 == 1, " -").otherwise("+-")
    return t.part.select(F.col("p_partkey").alias("id"), px.rule_token(token).cast("long").alias("flag"))


@query(
    "one_hot",
    "SELECT gt_id, CAST(class_id = 0 AS BIGINT) AS c0, CAST(class_id = 1 AS BIGINT) AS c1, CAST(class_id = 2 AS BIGINT) AS c2 FROM gt",
    ["gt"],
)
def _(t):
    hot = t.gt.withColumn("v", px.one_hot(F.col("class_id"), 3))
    return hot.select("gt_id", *(F.col("v")[i].cast("long").alias(f"c{i}") for i in range(3)))


@query(
    "k_hot",
    "SELECT image_id, " + ", ".join(f"MAX(CAST(class_id = {i} AS BIGINT)) AS c{i}" for i in range(3)) + " FROM gt GROUP BY image_id",
    ["gt"],
)
def _(t):
    sets = t.gt.groupBy("image_id").agg(F.collect_set(F.col("class_id").cast("int")).alias("s"))
    hot = sets.withColumn("v", px.k_hot(F.col("s"), 3))
    return hot.select("image_id", *(F.col("v")[i].cast("long").alias(f"c{i}") for i in range(3)))


@query(
    "keypoint_ops",
    """WITH k AS (SELECT ID, i AS k, ymin + i * 3 AS y, xmin + i * 5 AS x FROM cells, (SELECT UNNEST(RANGE(3)) AS i)),
f AS (SELECT ID, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS k, (y - 100) / 2800 AS y, 1 - (x - 200) / 3600 AS x FROM k)
SELECT ID, k, ROUND(CASE WHEN i THEN y ELSE -1 END, 6) AS y, ROUND(CASE WHEN i THEN x ELSE -1 END, 6) AS x, ROUND(CASE WHEN i THEN 1 - x ELSE -1 END, 6) AS rot_y, i AS visible
FROM (SELECT *, y >= 0 AND y <= 1 AND x >= 0 AND x <= 1 AS i FROM f)""",
    ["cells"],
)
def _(t):
    k = t.cells.select("ID", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "xmin", "ymin").selectExpr(
        "ID", "CAST(k AS BIGINT) AS k", "ymin + k * 3 AS y", "xmin + k * 5 AS x"
    )
    y, x = pt.change_frame(F.col("y"), F.col("x"), window(200, 100, 3800, 2900))
    y, x = pt.flip_horizontal(y, x)
    f = k.select("ID", pt.permute(F.col("k"), [0, 2, 1]).cast("long").alias("k"), y.alias("y"), x.alias("x"))
    y, x = pt.prune_outside(F.col("y"), F.col("x"), window(0.0, 0.0, 1.0, 1.0))
    f = f.select("ID", "k", y.alias("y"), x.alias("x"))
    ry, _ = pt.rot90(F.col("y"), F.col("x"))
    none = F.lit(-1.0)
    return f.select(
        "ID", "k", F.round(F.nanvl("y", none), 6).alias("y"), F.round(F.nanvl("x", none), 6).alias("x"),
        F.round(F.nanvl(ry, none), 6).alias("rot_y"), (~F.isnan("y")).alias("visible"),
    )


@query("content_key", "SELECT doc_id, SHA256(text) AS key FROM documents")
def _(t):
    return t.documents.select("doc_id", px.content_key(F.col("text")).alias("key"))


@query("box_format_convert", "SELECT gt_id, xmin AS x, ymin AS y, xmax - xmin AS w, ymax - ymin AS h, ROUND(xmin / 512, 6) AS rx, ROUND((xmax - xmin) / 512, 6) AS rw FROM gt", ["gt"])
def _(t):
    xywh = t.gt.select("gt_id", *(c.alias(n) for n, c in fb.to_xywh(Box.of()).items()))
    back = fb.from_xywh(*(F.col(c) for c in "xywh"))
    return xywh.select("gt_id", "x", "y", "w", "h", F.round(back.xmin / 512, 6).alias("rx"), F.round(back.width() / 512, 6).alias("rw"))


# --------------------------------------------------------------------- filters

def win():
    return window(500, 400, 3000, 2400)

ID_ONLY = "SELECT ID FROM cells WHERE "


@query(
    "filter_center_in_tile",
    ID_ONLY.replace("ID FROM", "ID, centroid_x > 500 AND centroid_y > 400 AS open FROM")
    + "centroid_x >= 500 AND centroid_x < 3000 AND centroid_y >= 400 AND centroid_y < 2400",
    ["cells"],
)
def _(t):
    wide = ob.center_in(t.cells, win(), closed_low=True)
    opened = ob.center_in(t.cells, win(), closed_low=False).select("ID", F.lit(True).alias("open"))
    return wide.join(opened, "ID", "left").select("ID", F.coalesce("open", F.lit(False)).alias("open"))


@query(
    "filter_box_inside",
    "SELECT ID, xmax < 3000 AND ymax < 2400 AS half_open FROM cells WHERE xmin >= 500 AND ymin >= 400 AND xmax <= 3000 AND ymax <= 2400",
    ["cells"],
)
def _(t):
    half = ob.inside(t.cells, win(), "half_open").select("ID", F.lit(True).alias("half_open"))
    return ob.inside(t.cells, win()).join(half, "ID", "left").select("ID", F.coalesce("half_open", F.lit(False)).alias("half_open"))


@query("filter_not_outside", ID_ONLY + "NOT (xmin >= 3000 OR ymin >= 2400 OR xmax <= 500 OR ymax <= 400)", ["cells"])
def _(t):
    return ob.not_outside(t.cells, win()).select("ID")


@query(
    "filter_inside_margin",
    "SELECT c.ID FROM cells c JOIN features f ON c.ID = f.ID WHERE xmin >= 100 AND ymin >= 100 AND xmax <= 3900 AND ymax <= 2900 AND GREATEST(NeuN - 0.5, S100 - 0.6) > 0",
    ["cells", "features"],
)
def _(t):
    both = t.cells.join(t.features.select("ID", (F.col("NeuN") - 0.5).alias("n"), (F.col("S100") - 0.6).alias("s")), "ID")
    return ob.inside_margin(both, 3000, 4000, 100, ["n", "s"]).select("ID")


@query("filter_box_size", ID_ONLY + "xmax - xmin < 25 AND ymax - ymin < 25 AND xmax - xmin > 14 AND ymax - ymin > 14 AND LEAST(xmax - xmin, ymax - ymin) >= 16", ["cells"])
def _(t):
    return ob.size_filter(t.cells, max_side=25, over=14, at_least=16).select("ID")


@query("filter_score", "SELECT det_id, det_id % 50 = 0 AS unscored FROM det WHERE score > 0.7 OR det_id % 50 = 0", GT_DET)
def _(t):
    d = t.det.withColumn("score", F.when(F.col("det_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    return ob.score_filter(d, 0.7, keep_nan=True).select("det_id", F.isnan("score").alias("unscored"))


@query("filter_field_equals", "SELECT gt_id FROM gt WHERE class_id = 2 AND gt_id IN (SELECT s_suppkey * 7 FROM supplier)", ["gt"])
def _(t):
    index = t.supplier.selectExpr("s_suppkey * 7 AS gt_id")
    return ob.gather(ob.field_equals(t.gt, "class_id", 2), index, "gt_id").select("gt_id")


@query(
    "filter_valid_boxes",
    """WITH f AS (SELECT *, xmin >= xmax OR ymin >= ymax AS e, xmin < 0 OR ymin < 0 OR xmax > 400 OR ymax > 400 AS o FROM (SELECT CASE WHEN det_id % 37 = 0 THEN xmax ELSE xmin END AS xmin, ymin, xmax, ymax FROM det))
SELECT COUNT(*) FILTER (WHERE e) AS skipped_empty, COUNT(*) FILTER (WHERE NOT e AND o) AS skipped_outside, COUNT(*) FILTER (WHERE NOT e AND NOT o) AS kept FROM f""",
    GT_DET,
)
def _(t):
    d = t.det.withColumn("xmin", F.when(F.col("det_id") % 37 == 0, F.col("xmax")).otherwise(F.col("xmin")))
    return ob.valid_report(d, 400, 400)


@query(
    "filter_groundtruth",
    "SELECT gt_id, class_id, CASE WHEN gt_id % 6 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS label_score FROM gt WHERE NOT group_of AND gt_id % 19 <> 0 AND class_id > 0",
    ["gt"],
)
def _(t):
    nan = F.lit(float("nan"))
    raw = t.gt.withColumns(
        {
            "is_crowd": F.col("group_of"), "xmin": F.when(F.col("gt_id") % 19 == 0, nan).otherwise(F.col("xmin")),
            "label_score": F.when(F.col("gt_id") % 6 == 0, nan).otherwise(F.lit(0.25)),
        }
    )
    return ob.clean_groundtruth(raw).select("gt_id", "class_id", "label_score")


@query("filter_classes", "SELECT gt_id, class_id FROM gt WHERE class_id IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0)", ["gt"])
def _(t):
    return ob.keep_classes(t.gt, t.region.where("r_regionkey % 2 = 0").selectExpr("CAST(r_regionkey AS BIGINT) AS class_id")).select("gt_id", "class_id")


@query("filter_null_columns", "SELECT ID, NeuN, Iba1 FROM features", ["features"])
def _(t):
    holes = {m: F.when(F.col("ID") % k != 0, F.col(m)) for m, k in (("S100", 7), ("Olig2", 11), ("RECA1", 13))}
    return ob.drop_null_columns(t.features.withColumns(holes))


@query(
    "split_box_label_rows",
    "SELECT 'box' AS kind, image_id, COUNT(*) AS n FROM gt GROUP BY image_id UNION ALL SELECT 'label', image_id, COUNT(*) FROM (SELECT DISTINCT image_id, class_id FROM gt) GROUP BY image_id",
    ["gt"],
)
def _(t):
    boxes = t.gt.selectExpr("image_id", "class_id", "xmin AS XMin", "CAST(NULL AS DOUBLE) AS ConfidenceImageLabel")
    labels = t.gt.select("image_id", "class_id").distinct().selectExpr("image_id", "class_id", "CAST(NULL AS DOUBLE) AS XMin", "1.0D AS ConfidenceImageLabel")
    b, l = ob.split_box_label_rows(boxes.unionByName(labels))
    tag = lambda df, k: df.groupBy("image_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "image_id", "n")
    return tag(b, "box").unionByName(tag(l, "label"))


# ------------------------------------------------------ sorts, windows, limits


@query("sort_by_field", "SELECT det_id, score FROM det ORDER BY score DESC, det_id", GT_DET)
def _(t):
    return od.sort_by_field(t.det, "score", "desc", "det_id").select("det_id", "score")


@query("shuffle_rows", "SELECT det_id, ROW_NUMBER() OVER (ORDER BY MD5(CAST(det_id AS VARCHAR) || '-7'), det_id) AS position FROM det", GT_DET)
def _(t):
    return od.shuffled(t.det, "det_id", 7, "position").select("det_id", "position")


@query(
    "win_sequential_id",
    "SELECT det_id, ROW_NUMBER() OVER (ORDER BY score DESC, det_id) AS ID, DENSE_RANK() OVER (ORDER BY image_id) AS image_no FROM det",
    GT_DET,
)
def _(t):
    ids = od.numbered(t.det.select("det_id", "score", "image_id"), [F.col("score").desc(), F.col("det_id")])
    return od.dense_relabel(ids, "image_id", "image_no").select("det_id", "ID", "image_no")


@query(
    "win_batch_shard",
    "SELECT det_id, (ROW_NUMBER() OVER (ORDER BY det_id) - 1) // 64 AS batch, NTILE(7) OVER (ORDER BY det_id) AS shard FROM det",
    GT_DET,
)
def _(t):
    ids = t.det.select("det_id")
    b = od.batches(ids, [F.col("det_id")], 64)
    s = od.contiguous_shards(ids, [F.col("det_id")], 7)
    return b.join(s, "det_id").select("det_id", "batch", F.col("shard").cast("long").alias("shard"))


@query(
    "limit_detections",
    """WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS rc FROM det),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rank FROM c WHERE rc <= 10)
SELECT image_id, det_id, rank FROM a WHERE rank <= 20""",
    GT_DET,
)
def _(t):
    return ob.limit_detections(t.det, 10, 20).select("image_id", "det_id", F.col("rank").cast("long").alias("rank"))


@query(
    "top_fraction",
    """SELECT image_id, det_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn, COUNT(*) OVER (PARTITION BY image_id) AS n FROM det)
WHERE rn <= GREATEST(1, CAST(FLOOR(n * 0.15) AS BIGINT))""",
    GT_DET,
)
def _(t):
    rows = t.det.select("image_id", "det_id", "score")
    return od.top_fraction(rows, ["image_id"], [F.col("score").desc(), F.col("det_id")], 0.15).select("image_id", "det_id")


# -------------------------------------------------------------- set operations


@query("union_boxlists", "SELECT gt_id, image_id, xmin FROM gt WHERE class_id = 0 UNION ALL SELECT gt_id, image_id, xmin FROM gt WHERE class_id <> 0", ["gt"])
def _(t):
    return ob.union(t.gt.where("class_id = 0"), t.gt.where("class_id <> 0")).select("gt_id", "image_id", "xmin")


@query(
    "union_augmented",
    f"SELECT 'plain' AS source, gt_id, {rs(('xmin', 'xmin / 512'), ('xmax', 'xmax / 512'))} FROM gt UNION ALL SELECT 'mirrored', gt_id, {rs(('xmin', '1 - xmax / 512'), ('xmax', '1 - xmin / 512'))} FROM gt",
    ["gt"],
)
def _(t):
    unit = ob.normalize(t.gt, 512, 512).withColumn("source", F.lit("plain"))
    aug = ob.put(unit, Box.of().flip_left_right()).withColumn("source", F.lit("mirrored"))
    return r6(ob.union(unit, aug).select("source", "gt_id", "xmin", "xmax"), "xmin", "xmax")


@query("except_rows", "SELECT ID FROM cells WHERE ID NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_custkey % 3 = 0)", ["cells"])
def _(t):
    return ob.except_rows(t.cells, t.orders.where("o_custkey % 3 = 0").selectExpr("o_orderkey + 1 AS ID"), ["ID"]).select("ID")


@query(
    "join_rows_member",
    "SELECT centroid_x, centroid_y FROM cells c WHERE EXISTS (SELECT 1 FROM cells d WHERE d.ID % 7 = 0 AND d.centroid_x = c.centroid_x AND d.centroid_y = c.centroid_y)",
    ["cells"],
)
def _(t):
    xy = t.cells.select("centroid_x", "centroid_y")
    return ob.members(xy, t.cells.where("ID % 7 = 0").select("centroid_x", "centroid_y"))


@query("agg_distinct_rows", "SELECT DISTINCT image_id, class_id, ymax - ymin AS h FROM gt", ["gt"])
def _(t):
    return t.gt.select("image_id", "class_id", Box.of().height().alias("h")).distinct()


@query(
    "reject_duplicates",
    "SELECT o_custkey AS image, o_orderkey AS arrival FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
)
def _(t):
    rows = t.orders.selectExpr("o_custkey AS image", "o_orderkey AS arrival")
    return ob.reject_duplicates(rows, "image", "first", "arrival")


@query("agg_cover_box", "SELECT image_id, MIN(xmin) AS xmin, MIN(ymin) AS ymin, MAX(xmax) AS xmax, MAX(ymax) AS ymax FROM gt GROUP BY image_id", ["gt"])
def _(t):
    return ob.cover_box(t.gt, ["image_id"])


@query("agg_max_dims", "SELECT MAX(GREATEST(ymax - ymin, xmax - xmin)) AS side FROM cells", ["cells"])
def _(t):
    b = Box.of()
    return t.cells.agg(F.max(F.greatest(b.height(), b.width())).alias("side"))


@query(
    "agg_merge_multilabel",
    """SELECT image_id, xmin, ymin, xmax, ymax, MAX(CAST(class_id = 0 AS BIGINT)) AS class_0, MAX(CAST(class_id = 1 AS BIGINT)) AS class_1, MAX(CAST(class_id = 2 AS BIGINT)) AS class_2, MIN(det_id) AS idx
FROM (SELECT det_id, image_id, class_id, FLOOR(xmin / 40) AS xmin, FLOOR(ymin / 40) AS ymin, FLOOR(xmax / 40) AS xmax, FLOOR(ymax / 40) AS ymax FROM det) GROUP BY image_id, xmin, ymin, xmax, ymax""",
    GT_DET,
)
def _(t):
    coarse = t.det.select(F.col("det_id").alias("idx"), "image_id", "class_id", *(F.floor(F.col(c) / 40).cast("double").alias(c) for c in B4))
    out = ob.merge_multilabel(coarse, 3)
    return out.withColumns({f"class_{i}": F.col(f"class_{i}").cast("long") for i in range(3)})
