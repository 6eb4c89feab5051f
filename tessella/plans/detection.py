"""Queries on suppression, fusion, assignment and the COCO protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import BOX, window
from ..operators import assign, boxes as ob, coco, evaluation as ev, masks, nearest as nn, suppress as sp
from ..runtime import stage
from .evaluation import AP_SELECT, FLAGGED, GT_DET, MASK_PAIRS, SMALL, _pixels, sql_area, sql_curve, sql_inter, sql_iou
from .registry import query


def _s(v: str) -> str:
    return f"STRUCT_PACK(i := {v}det_id, xmin := {v}xmin, ymin := {v}ymin, xmax := {v}xmax, ymax := {v}ymax)"


def sql_nms(source: str, keys: str, order: str, rule: str, name: str = "kept") -> str:
    """CTE with the ids kept by a sequential greedy scan; ``rule`` compares kept ``k`` with new ``n[1]``."""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_l AS (SELECT LIST([{_s('')}] ORDER BY {order}) AS l FROM {source} {group}),
{name} AS (SELECT (UNNEST(LIST_REDUCE(l, lambda acc, n: CASE WHEN LEN(LIST_FILTER(acc, lambda k: {rule})) > 0 THEN acc ELSE LIST_CONCAT(acc, n) END))).i AS det_id FROM {name}_l)"""


IOU_RULE = f"{sql_iou('k', 'n[1]')} > 0.5"
BEST_FIRST = "score DESC, det_id"
PER_CLASS = "image_id, class_id"


@query("nms", f"WITH {sql_nms('det', PER_CLASS, BEST_FIRST, IOU_RULE)} SELECT det_id FROM kept", GT_DET)
def _(t):
    return sp.nms(t.det, 0.5, ["image_id", "class_id"]).select("det_id")


@query(
    "nms_overlap_y",
    f"""WITH {sql_nms('det', 'image_id', 'ymax DESC, det_id', f"{sql_inter('k', 'n[1]', ' + 1')} / {sql_area('n[1]', ' + 1')} > 0.4")} SELECT det_id FROM kept""",
    GT_DET,
)
def _(t):
    return sp.nms_by_ymax(t.det, 0.4, ["image_id"]).select("det_id")


@query(
    "nms_multiclass",
    f"""WITH good AS (SELECT * FROM det WHERE score > 0.3), {sql_nms('good', PER_CLASS, BEST_FIRST, IOU_RULE)},
c AS (SELECT d.* FROM det d JOIN kept USING (det_id) QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY {BEST_FIRST}) <= 8)
SELECT image_id, class_id, det_id, LEAST(GREATEST(xmin, 0), 400) AS xmin, LEAST(GREATEST(xmax, 0), 400) AS xmax FROM c
WHERE (LEAST(GREATEST(xmax, 0), 400) - LEAST(GREATEST(xmin, 0), 400)) * (LEAST(GREATEST(ymax, 0), 400) - LEAST(GREATEST(ymin, 0), 400)) > 0
QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY {BEST_FIRST}) <= 20""",
    GT_DET,
)
def _(t):
    out = sp.nms_multiclass(t.det, 0.5, 0.3, 8, 20, clip=window(0.0, 0.0, 400.0, 400.0))
    return out.select("image_id", "class_id", "det_id", "xmin", "xmax")


@query(
    "eval_detection_nms",
    f"""WITH {sql_nms('det', PER_CLASS, BEST_FIRST, IOU_RULE)}, nd AS (SELECT d.* FROM det d JOIN kept USING (det_id)
QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY {BEST_FIRST}) <= 5), {FLAGGED.format(det='nd', w='0.0')}, {sql_curve()} {AP_SELECT}""",
    GT_DET,
)
def _(t):
    out = ev.eval_detection(t.det, t.gt, nms_threshold=0.5, nms_max_output=5, **SMALL)
    return out.where("n_gt > 0").select("class_id", "n_gt", F.round("ap", 6).alias("ap"))


_COARSE = "STRUCT_PACK(xmin := FLOOR({0}.xmin / 4), ymin := FLOOR({0}.ymin / 4), xmax := FLOOR({0}.xmax / 4) + 1, ymax := FLOOR({0}.ymax / 4) + 1)"


@query(
    "nms_masks",
    f"""WITH coarse AS (SELECT det_id, image_id, score, FLOOR(xmin / 4) AS xmin, FLOOR(ymin / 4) AS ymin, FLOOR(xmax / 4) + 1 AS xmax, FLOOR(ymax / 4) + 1 AS ymax FROM det),
{sql_nms('coarse', 'image_id', BEST_FIRST, IOU_RULE)} SELECT det_id FROM kept""",
    GT_DET,
)
def _(t):
    det = stage(t.det.select("det_id", "image_id", "score", *BOX), "det")
    few, *crowded = sp.dealt(det, ["image_id"])
    return sp.nms_masks(det, [_pixels(few, "det_id", "score"), *(_pixels(d, "det_id") for d in crowded)], 0.5).select("det_id")


_VOTED = f"""voted AS (SELECT k.det_id, CASE WHEN SUM(p.score) > 0 THEN SUM(p.xmin * p.score) / SUM(p.score) ELSE ANY_VALUE(k.xmin) END AS xmin, CASE WHEN SUM(p.score) > 0 THEN SUM(p.ymax * p.score) / SUM(p.score) ELSE ANY_VALUE(k.ymax) END AS ymax, AVG(p.score) AS score
FROM {{kept}} k JOIN det p ON k.image_id = p.image_id AND k.class_id = p.class_id WHERE {sql_iou('k', 'p')} > 0.4 GROUP BY k.det_id)
SELECT det_id, ROUND(xmin, 5) AS xmin, ROUND(ymax, 5) AS ymax, ROUND(score, 5) AS score FROM voted"""


def _voted(df):
    return df.select("det_id", *(F.round(c, 5).alias(c) for c in ("xmin", "ymax", "score")))


@query("agg_box_vote", "WITH sel AS (SELECT * FROM det), " + _VOTED.format(kept="sel"), GT_DET)
def _(t):
    return _voted(sp.box_vote(t.det, t.det, 0.4, ["image_id", "class_id"], **SMALL))


@query(
    "refine_boxes",
    f"WITH {sql_nms('det', PER_CLASS, BEST_FIRST, IOU_RULE)}, sel AS (SELECT d.* FROM det d JOIN kept USING (det_id)), " + _VOTED.format(kept="sel"),
    GT_DET,
)
def _(t):
    return _voted(sp.refine_boxes(t.det, 0.5, 0.4, **SMALL))


@query(
    "remove_close_centers",
    """WITH c AS (SELECT ID, slide, centroid_x AS x, centroid_y AS y, (ID * 7907) % 100003 AS s FROM cells),
b AS (SELECT a.ID AS ball, m.ID, ROW_NUMBER() OVER (PARTITION BY a.ID ORDER BY m.s DESC, m.ID) AS rn FROM c a JOIN c m ON a.slide = m.slide
  AND m.x BETWEEN a.x - 9 AND a.x + 9 AND m.y BETWEEN a.y - 9 AND a.y + 9 WHERE (a.x - m.x) ** 2 + (a.y - m.y) ** 2 <= 81)
SELECT ID FROM cells WHERE ID NOT IN (SELECT ID FROM b WHERE rn > 1)""",
    ["cells"],
)
def _(t):
    c = t.cells.withColumn("score", F.col("ID") * 7907 % 100003)
    return sp.remove_close_centers(c, 9, ["slide"], id_col="ID").select("ID")


@query("fuse_tile_detections")
def _(t):
    tiles = nn.boxes_in_tiles(t.cells, 300, 250)
    k = "tile_x DIV 250"
    j = "tile_y DIV 250"
    det = tiles.selectExpr(
        "slide", f"ID * 100 + ({j}) * 8 + ({k}) % 8 AS det_id", "tile_x", "tile_y",
        f"CAST((ID * 7907 + ({k}) + 3 * ({j})) % 100003 AS DOUBLE) / 100003.0D AS score",
        f"(xmin - tile_x + ({k}) % 3) / 300.0D AS xmin", f"(ymin - tile_y + ({j}) % 2) / 300.0D AS ymin",
        f"(xmax - tile_x + ({k}) % 3) / 300.0D AS xmax", f"(ymax - tile_y + ({j}) % 2) / 300.0D AS ymax",
    )
    out = sp.fuse_tiles(det, 300, score_threshold=0.5, edge=4, on=["slide"])
    return out.select("ID", "slide", "centroid_x", "centroid_y", "xmin", "ymin", "xmax", "ymax")


# ------------------------------------------------------------------ assignment


@query(
    "join_target_assign",
    f"""WITH p AS (SELECT d.det_id, g.gt_id, d.image_id, {sql_iou('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {sql_inter('d', 'g')} > 0),
b AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) = 1),
f AS (SELECT det_id, MIN(gt_id) AS gt_id FROM (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY gt_id ORDER BY iou DESC, det_id) = 1) GROUP BY det_id),
m AS (SELECT d.det_id, COALESCE(f.gt_id, CASE WHEN COALESCE(b.iou, 0) >= 0.7 THEN b.gt_id WHEN COALESCE(b.iou, 0) >= 0.4 THEN -2 ELSE -1 END) AS match FROM det d LEFT JOIN b ON b.det_id = d.det_id LEFT JOIN f ON f.det_id = d.det_id)
SELECT m.det_id, m.match, COALESCE(g.class_id, 0) AS target_class_id, g.xmin AS target_xmin, CAST(m.match >= 0 AS DOUBLE) AS box_weight, CAST(m.match <> -2 AS DOUBLE) AS class_weight
FROM m LEFT JOIN gt g ON g.gt_id = m.match""",
    GT_DET,
)
def _(t):
    out = assign.assign_targets(t.det, t.gt, 0.7, 0.4, force=True, **SMALL)
    return out.select("det_id", "match", "target_class_id", "target_xmin", "box_weight", "class_weight")


@query(
    "join_bipartite_greedy",
    f"""WITH p AS (SELECT d.det_id, g.gt_id, d.image_id, {sql_iou('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {sql_inter('d', 'g')} > 0),
l AS (SELECT image_id, LIST([STRUCT_PACK(d := det_id, g := gt_id, v := iou)] ORDER BY iou DESC, det_id, gt_id) AS l FROM p GROUP BY image_id),
r AS (SELECT image_id, UNNEST(LIST_REDUCE(l, lambda acc, n: CASE WHEN LEN(LIST_FILTER(acc, lambda k: k.d = n[1].d OR k.g = n[1].g)) > 0 THEN acc ELSE LIST_CONCAT(acc, n) END)) AS e FROM l)
SELECT image_id, e.d AS det_id, e.g AS gt_id, ROUND(e.v, 6) AS overlap FROM r""",
    GT_DET,
)
def _(t):
    return assign.bipartite_greedy(t.det, t.gt, "det_id", "gt_id", **SMALL).select(
        "image_id", "det_id", "gt_id", F.round("overlap", 6).alias("overlap")
    )


# ------------------------------------------------------------------------ COCO

# boxes of image i are enlarged by 1 + i % 5 so that all size bands occur
WIDE = {"cell": 256.0, "max_side": 256.0}  # at most 5 * 41 px
_SCALED = ", ".join(f"{c} * (1 + image_id % 5) AS {c}" for c in ("xmin", "ymin", "xmax", "ymax"))


def sql_coco(best: str, area_d: str, area_g: str, prefix: str = "") -> str:
    """CTEs up to ``cells``: AP and AR per class, threshold and band, one claim per ground truth."""
    return f"""{prefix}sd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS rk FROM ({area_d}) QUALIFY rk <= 100),
sg AS ({area_g}), {best},
bands AS (SELECT * FROM (VALUES ('all', 0, 10000000000), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 10000000000)) v(band, lo, hi)),
ts AS (SELECT CAST(UNNEST(RANGE(10)) AS INT) AS t),
cm AS (SELECT d.class_id, t, band, d.det_id, d.score, d.rk, d.area, lo, hi, CASE WHEN b.iou >= 0.5 + t * 0.05 THEN b.gt_id END AS gid, b.garea FROM sd d LEFT JOIN sb b ON b.det_id = d.det_id, ts, bands),
cw AS (SELECT *, gid IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY t, band, gid ORDER BY score DESC, det_id) = 1 AS won FROM cm),
cs AS (SELECT *, CAST(won AND garea BETWEEN lo AND hi AS INT) AS tp FROM cw WHERE CASE WHEN won THEN garea BETWEEN lo AND hi ELSE area BETWEEN lo AND hi END),
cn AS (SELECT class_id, band, COUNT(*) AS n_gt FROM sg, bands WHERE area BETWEEN lo AND hi GROUP BY class_id, band),
cc AS (SELECT *, SUM(tp) OVER w AS cum, COUNT(*) OVER w AS seen FROM cs WINDOW w AS (PARTITION BY class_id, t, band ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
ce AS (SELECT *, MAX(cum / seen) OVER (PARTITION BY class_id, t, band ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cc),
pts AS (SELECT n.class_id, n.band, ts.t, p.k, n.n_gt FROM cn n, ts, (SELECT UNNEST(RANGE(101)) AS k) p),
q AS (SELECT pts.class_id, pts.band, pts.t, pts.k, MAX(ce.env) AS v FROM pts LEFT JOIN ce ON ce.class_id = pts.class_id AND ce.band = pts.band AND ce.t = pts.t AND ce.tp = 1 AND ce.cum * 100 >= pts.k * pts.n_gt GROUP BY ALL),
qa AS (SELECT class_id, band, t, AVG(COALESCE(v, 0)) AS ap FROM q GROUP BY ALL),
qr AS (SELECT n.class_id, n.band, ts.t, COALESCE(SUM(tp) FILTER (WHERE rk <= 1), 0) / n_gt AS ar_1, COALESCE(SUM(tp) FILTER (WHERE rk <= 10), 0) / n_gt AS ar_10, COALESCE(SUM(tp), 0) / n_gt AS ar_100
  FROM cn n CROSS JOIN ts LEFT JOIN cs ON cs.class_id = n.class_id AND cs.band = n.band AND cs.t = ts.t GROUP BY n.class_id, n.band, ts.t, n_gt),
cells AS (SELECT * FROM qa JOIN qr USING (class_id, band, t))"""


_METRICS = ", ".join(
    f"ROUND(AVG({c}) FILTER (WHERE band = '{b}'{x}), 5) AS {n}"
    for n, c, b, x in (
        ("ap", "ap", "all", ""), ("ap_50", "ap", "all", " AND t = 0"), ("ap_75", "ap", "all", " AND t = 5"),
        ("ap_small", "ap", "small", ""), ("ap_medium", "ap", "medium", ""), ("ap_large", "ap", "large", ""),
        ("ar_1", "ar_1", "all", ""), ("ar_10", "ar_10", "all", ""), ("ar_100", "ar_100", "all", ""),
        ("ar_small", "ar_100", "small", ""), ("ar_medium", "ar_100", "medium", ""), ("ar_large", "ar_100", "large", ""),
    )
)
_BOX_AREA = "SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM {0}"
_BOX_BEST = f"""sb AS (SELECT d.det_id, g.gt_id, g.area AS garea, {sql_iou('d', 'g')} AS iou FROM sd d JOIN sg g ON d.image_id = g.image_id AND d.class_id = g.class_id
  WHERE {sql_inter('d', 'g')} > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY d.det_id ORDER BY iou DESC, g.gt_id DESC) = 1)"""
_BOX_PREFIX = f"bd AS (SELECT det_id, image_id, class_id, score, {_SCALED} FROM det), bg AS (SELECT gt_id, image_id, class_id, {_SCALED} FROM gt), "
_BOX_COCO = sql_coco(_BOX_BEST, _BOX_AREA.format("bd"), _BOX_AREA.format("bg"), _BOX_PREFIX)


def _scaled(df):
    f = 1 + F.col("image_id") % 5
    return df.withColumns({c: F.col(c) * f for c in ("xmin", "ymin", "xmax", "ymax")})


def _r5(df):
    return df.select(*(F.round(c, 5).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes))


@query("eval_coco", f"WITH {_BOX_COCO} SELECT {_METRICS} FROM cells", GT_DET)
def _(t):
    return _r5(coco.eval_coco(_scaled(t.det), _scaled(t.gt), **WIDE))


@query(
    "agg_coco_summary",
    f"WITH {_BOX_COCO} SELECT class_id, {_METRICS} FROM cells GROUP BY GROUPING SETS ((class_id), ())",
    GT_DET,
)
def _(t):
    return _r5(coco.eval_coco(_scaled(t.det), _scaled(t.gt), by_category=True, **WIDE))


@query(
    "eval_coco_masks",
    "WITH "
    + sql_coco(
        """sb AS (SELECT det_id, gt_id, iou, area_b AS garea FROM mpairs QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id DESC) = 1)""",
        "SELECT d.det_id, image_id, class_id, score, area_a AS area FROM det d JOIN da USING (det_id)",
        "SELECT gt_id, image_id, class_id, area_b AS area FROM gt JOIN ga USING (gt_id)",
        MASK_PAIRS + ", ",
    )
    + f" SELECT {_METRICS} FROM cells",
    GT_DET,
)
def _(t):
    return _r5(coco.eval_coco(t.det, t.gt, masks=(_pixels(t.det, "det_id"), _pixels(t.gt, "gt_id"))))
