"""Queries on detection quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import Box, iou
from ..operators import coco, evaluation as ev, masks, overlap
from .registry import query

# ------------------------------------------------------------------ oracle SQL

INTER = (
    "GREATEST(LEAST({a}.xmax, {b}.xmax) - GREATEST({a}.xmin, {b}.xmin){p}, 0) * "
    "GREATEST(LEAST({a}.ymax, {b}.ymax) - GREATEST({a}.ymin, {b}.ymin){p}, 0)"
)
AREA = "(({a}.xmax - {a}.xmin{p}) * ({a}.ymax - {a}.ymin{p}))"


def sql_inter(a: str, b: str, p: str = "") -> str:
    return INTER.format(a=a, b=b, p=p)


def sql_area(a: str, p: str = "") -> str:
    return AREA.format(a=a, p=p)


def sql_iou(a: str, b: str, p: str = "") -> str:
    i = sql_inter(a, b, p)
    return f"(CAST({i} AS DOUBLE) / ({sql_area(a, p)} + {sql_area(b, p)} - {i}))"


def sql_best(p: str = "", where: str = "TRUE") -> str:
    """CTE ``best``: det columns with the best gt; iou 0 and gt null when none."""
    return f"""pairs AS (
  SELECT d.det_id, g.gt_id, g.difficult, {sql_iou('d', 'g', p)} AS iou
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id
  WHERE {sql_inter('d', 'g', p)} > 0 AND {where}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS rn FROM pairs),
best AS (SELECT d.det_id, d.image_id, d.class_id, d.score, COALESCE(r.iou, 0.0) AS iou, r.gt_id, COALESCE(r.difficult, FALSE) AS difficult
  FROM det d LEFT JOIN ranked r ON d.det_id = r.det_id AND r.rn = 1)"""


CLAIMED = """claimed AS (SELECT *, iou >= 0.5 AS matched,
  iou >= 0.5 AND ROW_NUMBER() OVER (PARTITION BY image_id, class_id, CASE WHEN iou >= 0.5 THEN gt_id END ORDER BY score DESC, det_id) = 1 AS tp
  FROM best)"""

GT_SIMPLE = "counts AS (SELECT class_id, CAST(COUNT(*) AS DOUBLE) AS n_gt FROM gt GROUP BY class_id)"
SCORED_SIMPLE = "scored AS (SELECT image_id, class_id, det_id AS rank_id, score, CASE WHEN tp THEN 1.0 ELSE 0.0 END AS tp FROM claimed)"


def sql_curve(keys: str = "class_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    join = f"JOIN counts USING ({keys})" if keys else "CROSS JOIN (SELECT SUM(n_gt) AS n_gt FROM counts) c"
    pick = f"{keys}, " if keys else ""
    return f"""cum AS (SELECT {pick}rank_id, score, tp, n_gt,
    SUM(CAST(tp AS DOUBLE)) OVER ({part}ORDER BY score DESC, rank_id ROWS UNBOUNDED PRECEDING) AS cum_tp,
    SUM(CASE WHEN tp <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE) OVER ({part}ORDER BY score DESC, rank_id ROWS UNBOUNDED PRECEDING) AS cum_fp
  FROM scored {join}),
curve AS (SELECT *, cum_tp / (cum_tp + cum_fp) AS precision, cum_tp / n_gt AS recall FROM cum),
env AS (SELECT *, MAX(precision) OVER ({part}ORDER BY score DESC, rank_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM curve)"""


AP_SELECT = """SELECT c.class_id, c.n_gt, ROUND(COALESCE(a.ap, 0.0), 6) AS ap FROM counts c
LEFT JOIN (SELECT class_id, SUM(tp * envelope / n_gt) AS ap FROM env GROUP BY class_id) a ON c.class_id = a.class_id WHERE c.n_gt > 0"""

SIMPLE = f"WITH {sql_best()}, {CLAIMED}, {SCORED_SIMPLE}, {GT_SIMPLE}, {sql_curve()} "
GT_DET = ["gt", "det"]
SMALL = {"cell": 64.0, "max_side": 64.0}  # boxes of these views are at most 41 px wide


def _plain(gt):
    """Ground truth with the flags ignored."""
    return gt.withColumn("difficult", F.lit(False)).withColumn("group_of", F.lit(False))


def _simple(t):
    gt = _plain(t.gt)
    return ev.score_detections(ev.best_boxes(t.det, gt, **SMALL), 0.5), ev.gt_counts(gt)


# ---------------------------------------------------------------------- joins


@query(
    "join_box_overlap",
    f"""SELECT d.det_id, g.gt_id, ROUND({sql_inter('d', 'g')}, 6) AS intersection,
ROUND({sql_iou('d', 'g')}, 6) AS iou, ROUND({sql_inter('d', 'g')} / {sql_area('g')}, 6) AS ioa
FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {sql_inter('d', 'g')} > 0""",
    GT_DET,
)
def _(t):
    return overlap.box_overlap(t.det, t.gt, ["image_id"], **SMALL).select(
        F.col("a.det_id").alias("det_id"), F.col("b.gt_id").alias("gt_id"),
        F.round("intersection", 6).alias("intersection"), F.round("iou", 6).alias("iou"), F.round("ioa", 6).alias("ioa"),
    )


@query(
    "join_best_gt",
    f"WITH {sql_best()} SELECT det_id, gt_id, ROUND(iou, 6) AS iou FROM best",
    GT_DET,
)
def _(t):
    return overlap.best_match(t.det, t.gt, "gt_id", ["image_id", "class_id"], **SMALL).select(
        "det_id", "gt_id", F.round(F.coalesce("overlap", F.lit(0.0)), 6).alias("iou")
    )


@query(
    "join_verified_labels",
    """WITH verified AS (SELECT DISTINCT c_custkey // 25 AS image_id, CAST(c_custkey % 3 AS BIGINT) AS class_id FROM customer WHERE c_custkey % 5 = 0)
SELECT det_id, image_id, class_id FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.class_id = d.class_id)
OR EXISTS (SELECT 1 FROM verified v WHERE v.image_id = d.image_id AND v.class_id = d.class_id)""",
    GT_DET,
)
def _(t):
    return ev.verified_only(t.det, t.gt, _verified(t)).select("det_id", "image_id", "class_id")


def _verified(t):
    return t.customer.where("c_custkey % 5 = 0").selectExpr(
        "CAST(FLOOR(c_custkey / 25.0) AS BIGINT) AS image_id", "CAST(c_custkey % 3 AS BIGINT) AS class_id"
    )




def _sub(alias: str, kind: str, keys: str) -> str:
    return f"STRUCT_PACK(xmin := {alias}.{kind}x0, ymin := {alias}.{kind}y0, xmax := {alias}.{kind}x1, ymax := {alias}.{kind}y1)"


def sql_rel_pairs(phrases: bool) -> str:
    """CTE ``rpairs`` with the overlap of every intersecting tuple pair."""
    if phrases:
        box = lambda a: (
            f"STRUCT_PACK(xmin := LEAST({a}.sx0, {a}.ox0), ymin := LEAST({a}.sy0, {a}.oy0), xmax := GREATEST({a}.sx1, {a}.ox1), ymax := GREATEST({a}.sy1, {a}.oy1))"
        )
        cols = f"{box('d')} AS a, {box('g')} AS b, {box('d')} AS c, {box('g')} AS e"
    else:
        cols = f"{_sub('d', 's', '')} AS a, {_sub('g', 's', '')} AS b, {_sub('d', 'o', '')} AS c, {_sub('g', 'o', '')} AS e"
    known = "EXISTS (SELECT 1 FROM relations g WHERE g.image_id = d.image_id AND {0} IN (g.subject_label, g.object_label))"
    return f"""rdet AS (SELECT * FROM relation_det d WHERE {known.format('d.subject_label')} AND {known.format('d.object_label')}),
raw AS (SELECT d.det_id, g.gt_id, {cols} FROM rdet d JOIN relations g ON d.image_id = g.image_id
  AND d.subject_label = g.subject_label AND d.object_label = g.object_label AND d.relation = g.relation),
rpairs AS (SELECT det_id, gt_id, LEAST({sql_iou('a', 'b')}, {sql_iou('c', 'e')}) AS iou FROM raw),
rranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS rn FROM rpairs WHERE iou > 0),
rbest AS (SELECT d.det_id, d.image_id, d.relation, d.score, COALESCE(r.iou, 0.0) AS iou, r.gt_id FROM rdet d LEFT JOIN rranked r ON d.det_id = r.det_id AND r.rn = 1),
scored AS (SELECT image_id, relation, det_id AS rank_id, score, CASE WHEN iou >= 0.5 AND
  ROW_NUMBER() OVER (PARTITION BY CASE WHEN iou >= 0.5 THEN gt_id END ORDER BY score DESC, det_id) = 1 THEN 1.0 ELSE 0.0 END AS tp FROM rbest)"""


@query(
    "join_relation_min_iou",
    f"WITH {sql_rel_pairs(False)} SELECT det_id, gt_id, ROUND(iou, 6) AS iou FROM rpairs WHERE iou > 0",
    ["relations", "relation_det"],
)
def _(t):
    keys = ["image_id", "subject_label", "object_label", "relation"]
    names = ("xmin", "ymin", "xmax", "ymax")
    flat = lambda df, key: df.select(*keys, key, "subject.*", *(F.col(f"object.{n}").alias(f"o_{n}") for n in names))
    pairs = overlap.box_pairs(flat(t.relation_det, "det_id"), flat(t.relations, "gt_id"), keys, **SMALL)
    other = lambda side: Box(*(F.col(f"{side}.o_{n}") for n in names))
    value = ev.min_iou(Box.of("a"), other("a"), Box.of("b"), other("b"))
    return pairs.select(
        F.col("a.det_id").alias("det_id"), F.col("b.gt_id").alias("gt_id"), value.alias("iou")
    ).where("iou > 0").withColumn("iou", F.round("iou", 6))


# --------------------------------------------------------------------- windows


@query(
    "win_claim_gt",
    f"WITH {sql_best()}, {CLAIMED} SELECT det_id, matched, tp FROM claimed",
    GT_DET,
)
def _(t):
    return ev.claims(ev.best_boxes(t.det, _plain(t.gt), **SMALL), 0.5).select("det_id", "matched", "tp")


@query(
    "win_precision_recall",
    SIMPLE + "SELECT class_id, rank_id AS det_id, ROUND(precision, 6) AS prec, ROUND(recall, 6) AS recall FROM curve",
    GT_DET,
)
def _(t):
    return ev.precision_recall(*_simple(t)).select(
        "class_id", F.col("rank_id").alias("det_id"), F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("recall")
    )


@query(
    "win_precision_envelope",
    SIMPLE + "SELECT class_id, rank_id AS det_id, ROUND(recall, 6) AS recall, ROUND(envelope, 6) AS envelope FROM env WHERE tp > 0",
    GT_DET,
)
def _(t):
    return ev.precision_envelope(ev.precision_recall(*_simple(t))).select(
        "class_id", F.col("rank_id").alias("det_id"), F.round("recall", 6).alias("recall"), F.round("envelope", 6).alias("envelope")
    )


@query(
    "win_topk_per_image",
    f"""WITH {sql_best()}, {CLAIMED}, {SCORED_SIMPLE}
SELECT image_id, rank_id AS det_id, rn AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, rank_id) AS rn FROM scored) WHERE rn <= 50""",
    GT_DET,
)
def _(t):
    return ev.top_k_per_image(_simple(t)[0], 50).select(
        "image_id", F.col("rank_id").alias("det_id"), F.col("rank").cast("long").alias("rank")
    )


# ------------------------------------------------------------------ aggregates


@query("agg_average_precision", SIMPLE + AP_SELECT, GT_DET)
def average_precision(t):
    return ev.average_precision(*_simple(t)).withColumn("ap", F.round("ap", 6))


@query("agg_map", SIMPLE + f"SELECT ROUND(AVG(ap), 5) AS map FROM ({AP_SELECT})", GT_DET)
def _(t):
    return ev.mean_average_precision(ev.average_precision(*_simple(t)).withColumn("ap", F.round("ap", 6))).select(
        F.round("map", 5).alias("map")
    )


TOP_HIT = """top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS trn FROM best),
images AS (SELECT class_id, COUNT(DISTINCT image_id) AS n_images FROM gt GROUP BY class_id),
cl AS (SELECT i.class_id, i.n_images, CAST(COUNT(t.det_id) AS DOUBLE) / i.n_images AS corloc FROM images i
  LEFT JOIN top t ON t.class_id = i.class_id AND t.trn = 1 AND t.iou >= 0.5 GROUP BY i.class_id, i.n_images)"""


@query("agg_corloc", f"WITH {sql_best()}, {TOP_HIT} SELECT class_id, n_images, ROUND(corloc, 6) AS corloc FROM cl", GT_DET)
def _(t):
    return ev.corloc(ev.best_boxes(t.det, _plain(t.gt), **SMALL), t.gt).withColumn("corloc", F.round("corloc", 6))


@query(
    "agg_gt_counts",
    """SELECT class_id, CAST(COUNT(*) FILTER (WHERE NOT difficult AND NOT group_of) + 0.5 * COUNT(*) FILTER (WHERE group_of) AS DOUBLE) AS n_gt,
COUNT(DISTINCT image_id) AS n_images FROM gt GROUP BY class_id""",
    ["gt"],
)
def _(t):
    return ev.gt_counts(t.gt, group_of_weight=0.5)


@query(
    "agg_recall_at_k",
    f"""WITH {sql_best()}, {CLAIMED}, {SCORED_SIMPLE}
SELECT ROUND(SUM(tp) / (SELECT COUNT(*) FROM gt), 6) AS recall_at_50 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, rank_id) AS rn FROM scored) WHERE rn <= 50""",
    GT_DET,
)
def _(t):
    total = t.gt.agg(F.count("*").alias("n")).scalar()
    return ev.recall_at_k(_simple(t)[0], total, 50).select(F.round("recall_at_50", 6).alias("recall_at_50"))


@query(
    "agg_median_rank_at_k",
    f"""WITH {sql_best()}, {CLAIMED}, {SCORED_SIMPLE}
SELECT MEDIAN(rn - 1) AS median_rank_at_50 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, rank_id) AS rn FROM scored) WHERE rn <= 50 AND tp > 0""",
    GT_DET,
)
def _(t):
    return ev.median_rank_at_k(_simple(t)[0], 50)


@query(
    "agg_mean_loss_accuracy",
    """SELECT ROUND(AVG(CAST(value AS DOUBLE)), 6) AS mean_loss, ROUND(AVG(CASE WHEN user_id % 3 = event_id % 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events""",
)
def _(t):
    rows = t.events.selectExpr("CAST(value AS DOUBLE) AS loss", "user_id % 3 AS predicted", "event_id % 3 AS label")
    out = ev.mean_loss_accuracy(rows, "loss", "predicted", "label")
    return out.select(F.round("mean_loss", 6).alias("mean_loss"), F.round("accuracy", 6).alias("accuracy"))


# ------------------------------------------------------------------- protocols


@query(
    "eval_voc",
    f"""WITH {sql_best(' + 1')}, {CLAIMED},
scored AS (SELECT image_id, class_id, det_id AS rank_id, score, CASE WHEN tp THEN 1.0 ELSE 0.0 END AS tp FROM claimed WHERE tp OR NOT matched),
{GT_SIMPLE}, {sql_curve()} {AP_SELECT}""",
    GT_DET,
)
def _(t):
    return ev.eval_voc(t.det, t.gt, **SMALL).withColumn("ap", F.round("ap", 6))


FLAGGED = f"""p_plain AS (SELECT d.det_id, g.gt_id, g.difficult, {sql_iou('d', 'g')} AS iou FROM det d JOIN gt g
    ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE NOT g.group_of AND {sql_inter('d', 'g')} > 0),
p_group AS (SELECT d.det_id, g.gt_id, {sql_inter('d', 'g')} / {sql_area('d')} AS ioa FROM det d JOIN gt g
    ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE g.group_of AND {sql_inter('d', 'g')} > 0),
b_plain AS (SELECT * FROM p_plain QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) = 1),
b_group AS (SELECT * FROM p_group QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY ioa DESC, gt_id) = 1),
fbest AS (SELECT d.det_id, d.image_id, d.class_id, d.score, COALESCE(p.iou, 0) AS iou, p.gt_id, COALESCE(p.difficult, FALSE) AS difficult,
    COALESCE(q.ioa, 0) AS ioa, q.gt_id AS group_id FROM {{det}} d LEFT JOIN b_plain p ON d.det_id = p.det_id LEFT JOIN b_group q ON d.det_id = q.det_id),
fclaimed AS (SELECT *, iou >= 0.5 AND difficult AS on_difficult, iou >= 0.5 AND NOT difficult AND
    ROW_NUMBER() OVER (PARTITION BY CASE WHEN iou >= 0.5 AND NOT difficult THEN gt_id END ORDER BY score DESC, det_id) = 1 AS tp FROM fbest),
fabs AS (SELECT *, NOT tp AND NOT on_difficult AND group_id IS NOT NULL AND ioa >= 0.5 AS absorbed FROM fclaimed),
scored AS (SELECT image_id, class_id, det_id AS rank_id, score, CASE WHEN tp THEN 1.0 ELSE 0.0 END AS tp FROM fabs WHERE NOT on_difficult AND NOT absorbed
    UNION ALL SELECT image_id, class_id, -1 - group_id, MAX(score), {{w}} FROM fabs WHERE absorbed AND score > 0 AND {{w}} > 0 GROUP BY image_id, class_id, group_id),
counts AS (SELECT class_id, CAST(COUNT(*) FILTER (WHERE NOT difficult AND NOT group_of) + {{w}} * COUNT(*) FILTER (WHERE group_of) AS DOUBLE) AS n_gt FROM gt GROUP BY class_id)"""


@query(
    "eval_detection",
    f"WITH {FLAGGED.format(det='det', w='0.0')}, {sql_curve()}, {sql_best()}, {TOP_HIT}, ap AS ({AP_SELECT}) "
    "SELECT class_id, n_gt, ap, n_images, ROUND(corloc, 6) AS corloc FROM ap FULL JOIN cl USING (class_id)",
    GT_DET,
)
def _(t):
    return ev.eval_detection(t.det, t.gt, **SMALL).withColumns({"ap": F.round("ap", 6), "corloc": F.round("corloc", 6)})


@query(
    "eval_open_images",
    """WITH verified AS (SELECT DISTINCT c_custkey // 25 AS image_id, CAST(c_custkey % 3 AS BIGINT) AS class_id FROM customer WHERE c_custkey % 5 = 0),
vdet AS (SELECT * FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.class_id = d.class_id)
OR EXISTS (SELECT 1 FROM verified v WHERE v.image_id = d.image_id AND v.class_id = d.class_id)), """
    + f"{FLAGGED.format(det='vdet', w='1.0')}, {sql_curve()} {AP_SELECT}",
    GT_DET,
)
def _(t):
    return ev.eval_open_images(t.det, t.gt, _verified(t), **SMALL).withColumn("ap", F.round("ap", 6))


@query(
    "eval_pascal_weighted",
    f"WITH {FLAGGED.format(det='det', w='0.0')}, {sql_curve('')} SELECT ROUND(SUM(tp * envelope / n_gt), 6) AS ap FROM env",
    GT_DET,
)
def _(t):
    return ev.eval_weighted(t.det, t.gt, **SMALL).select(F.round("ap", 6).alias("ap"))


def _pixels(df, key, *more):
    """Coarse pixel masks: the 4-px cells a box covers."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / 4), F.floor(F.col(hi) / 4))
    return df.select("image_id", key, *more, F.explode(cells("ymin", "ymax")).alias("y"), "xmin", "xmax").select(
        "image_id", key, *more, "y", F.explode(cells("xmin", "xmax")).alias("x")
    )


def sql_pixels(view: str, key: str) -> str:
    return f"""(SELECT image_id, class_id, {key}, y, UNNEST(RANGE(CAST(FLOOR(xmin / 4) AS BIGINT), CAST(FLOOR(xmax / 4) AS BIGINT) + 1)) AS x FROM
 (SELECT image_id, class_id, {key}, xmin, xmax, UNNEST(RANGE(CAST(FLOOR(ymin / 4) AS BIGINT), CAST(FLOOR(ymax / 4) AS BIGINT) + 1)) AS y FROM {view}))"""


MASK_PAIRS = f"""dp AS {sql_pixels('det', 'det_id')}, gp AS {sql_pixels('gt', 'gt_id')},
da AS (SELECT det_id, COUNT(*) AS area_a FROM dp GROUP BY det_id), ga AS (SELECT gt_id, COUNT(*) AS area_b FROM gp GROUP BY gt_id),
mi AS (SELECT dp.det_id, gp.gt_id, COUNT(*) AS intersection FROM dp JOIN gp ON dp.image_id = gp.image_id AND dp.class_id = gp.class_id AND dp.y = gp.y AND dp.x = gp.x GROUP BY ALL),
mpairs AS (SELECT det_id, gt_id, intersection, area_a, area_b, CAST(intersection AS DOUBLE) / (area_a + area_b - intersection) AS iou,
  CAST(intersection AS DOUBLE) / area_a AS ioa FROM mi JOIN da USING (det_id) JOIN ga USING (gt_id))"""


@query(
    "join_mask_overlap",
    f"WITH {MASK_PAIRS} SELECT det_id, gt_id, intersection, area_a, area_b, ROUND(iou, 6) AS iou, ROUND(ioa, 6) AS ioa FROM mpairs",
    GT_DET,
)
def _(t):
    # boxes take their class before they become pixels
    classed = lambda df, k: _pixels(df.drop("class_id").join(df.select(k, "class_id"), k), k, "class_id")
    a, b = classed(t.det, "det_id"), classed(t.gt, "gt_id")
    return masks.mask_overlap(a, b, "det_id", "gt_id", ["image_id", "class_id"]).select(
        "det_id", "gt_id", "intersection", "area_a", "area_b", F.round("iou", 6).alias("iou"), F.round("ioa_a", 6).alias("ioa")
    )


@query(
    "eval_pascal_masks",
    f"""WITH {MASK_PAIRS}, mbest AS (SELECT m.*, g.difficult FROM mpairs m JOIN gt g USING (gt_id) WHERE NOT g.group_of QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) = 1),
mgroup AS (SELECT m.det_id, m.gt_id, m.ioa FROM mpairs m JOIN gt g USING (gt_id) WHERE g.group_of QUALIFY ROW_NUMBER() OVER (PARTITION BY det_id ORDER BY ioa DESC, gt_id) = 1),
fbest AS (SELECT d.det_id, d.image_id, d.class_id, d.score, COALESCE(p.iou, 0) AS iou, p.gt_id, COALESCE(p.difficult, FALSE) AS difficult, COALESCE(q.ioa, 0) AS ioa, q.gt_id AS group_id
  FROM det d LEFT JOIN mbest p ON d.det_id = p.det_id LEFT JOIN mgroup q ON d.det_id = q.det_id),
"""
    + FLAGGED[FLAGGED.index("fclaimed AS") :].format(w="0.0")
    + f", {sql_curve('')} SELECT ROUND(SUM(tp * envelope / n_gt), 6) AS ap FROM env",
    GT_DET,
)
def _(t):
    pixels = (_pixels(t.det, "det_id"), _pixels(t.gt, "gt_id"))
    return ev.eval_weighted(t.det, t.gt, masks=pixels).select(F.round("ap", 6).alias("ap"))


def _relation_oracle(phrases: bool) -> str:
    return f"""WITH {sql_rel_pairs(phrases)}, counts AS (SELECT relation, CAST(COUNT(*) AS DOUBLE) AS n_gt FROM relations GROUP BY relation),
{sql_curve('relation')}, aps AS (SELECT c.relation, COALESCE(SUM(tp * envelope / c.n_gt), 0) AS ap FROM counts c LEFT JOIN env e ON c.relation = e.relation GROUP BY c.relation),
allcum AS (SELECT tp, score, rank_id, SUM(tp) OVER (ORDER BY score DESC, rank_id ROWS UNBOUNDED PRECEDING) / ROW_NUMBER() OVER (ORDER BY score DESC, rank_id) AS prec FROM scored),
allenv AS (SELECT tp, MAX(prec) OVER (ORDER BY score DESC, rank_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM allcum),
topk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, rank_id) AS rn FROM scored),
total AS (SELECT COUNT(*) AS n FROM relations)
SELECT 'ap_' || relation AS metric, ROUND(ap, 6) AS value FROM aps
UNION ALL SELECT 'map', ROUND(AVG(ap), 6) FROM aps
UNION ALL SELECT 'weighted_ap', ROUND(SUM(tp * envelope) / (SELECT n FROM total), 6) FROM allenv
UNION ALL SELECT 'recall_at_50', ROUND(SUM(tp) / (SELECT n FROM total), 6) FROM topk WHERE rn <= 50
UNION ALL SELECT 'recall_at_100', ROUND(SUM(tp) / (SELECT n FROM total), 6) FROM topk WHERE rn <= 100
UNION ALL SELECT 'median_rank_at_50', MEDIAN(rn - 1) FROM topk WHERE rn <= 50 AND tp > 0
UNION ALL SELECT 'median_rank_at_100', MEDIAN(rn - 1) FROM topk WHERE rn <= 100 AND tp > 0"""


@query("eval_relations", _relation_oracle(False), ["relations", "relation_det"])
def _(t):
    return ev.eval_relations(t.relation_det, t.relations, **SMALL).withColumn("value", F.round("value", 6))


@query("eval_phrases", _relation_oracle(True), ["relations", "relation_det"])
def _(t):
    return ev.eval_relations(t.relation_det, t.relations, phrases=True, max_side=512, cell=512).withColumn("value", F.round("value", 6))
