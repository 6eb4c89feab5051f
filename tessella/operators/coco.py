"""COCO protocol: mean AP over ten IoU thresholds, by object size, and AR.

At most 100 detections per image and class are scored, as the protocol says. A
detection never needs more than its 100 best candidates of one size band and crowd
state, since the other 99 detections can take at most 99 of them. So the greedy
step works on groups of bounded size whatever the image holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import Box, intersection, iou
from ..runtime import stage
from . import ordering
from .ordering import top_per_key
from .overlap import box_pairs

# fixed values of the protocol
MAX_DETECTIONS = (1, 10, 100)
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
BANDS = {"all": (0, 10**10), "small": (0, 32**2), "medium": (32**2, 96**2), "large": (96**2, 10**10)}
KEYS = ["image_id", "class_id"]
CELL = ["class_id", "band"]


def _bands(area: Column) -> Column:
    """Names of the size bands an area belongs to (edges belong to both sides)."""
    return F.filter(
        F.array(*(F.when(area.between(lo, hi), F.lit(n)) for n, (lo, hi) in BANDS.items())), lambda b: b.isNotNull()
    )


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy matches of one image and class for every band and threshold.

    The state of a detection is 1 where it takes a counted ground truth, 2 where
    it takes an ignored one, else 0.
    """
    pdf = pdf.sort_values(["rank", "iou", "gt_id"], ascending=[True, False, False])
    options: dict = {}
    columns = (pdf[c].tolist() for c in ("det_id", "gt_id", "iou", "is_crowd", "bands"))
    for d, g, v, crowd, bands in zip(*columns):
        options.setdefault(d, []).append((g, v, crowd, set(bands)))
    out = []
    for name in BANDS:
        listed = {d: [(g, v, crowd, crowd or name not in bands) for g, v, crowd, bands in rows] for d, rows in options.items()}
        state = {d: [0] * len(THRESHOLDS) for d in options}
        for t, limit in enumerate(THRESHOLDS):
            used = set()
            for d, rows in listed.items():
                spare = None
                for g, v, crowd, ignored in rows:
                    if v < limit:
                        break
                    if g in used and not crowd:
                        continue
                    if not ignored:
                        used.add(g)
                        state[d][t] = 1
                        break
                    if spare is None:
                        spare = g
                if state[d][t] == 0 and spare is not None:
                    used.add(spare)
                    state[d][t] = 2
        out += [(d, name, s) for d, s in state.items() if any(s)]
    return pd.DataFrame(out, columns=["det_id", "band", "state"])


def candidates(det: DataFrame, gt: DataFrame, masks=None, **grid) -> DataFrame:
    """Candidate pairs with IoU (intersection over detection area for crowds)."""
    if masks is None:
        pairs = box_pairs(
            det.select(*KEYS, "det_id", "rank", "xmin", "ymin", "xmax", "ymax"),
            gt.select(*KEYS, "gt_id", "is_crowd", "area", "xmin", "ymin", "xmax", "ymax"), KEYS, **grid,
        )
        a, b = Box.of("a"), Box.of("b")
        value = F.when(F.col("b.is_crowd"), intersection(a, b) / a.area()).otherwise(iou(a, b))
        flat = pairs.select(
            *KEYS, F.col("a.det_id").alias("det_id"), F.col("a.rank").alias("rank"), F.col("b.gt_id").alias("gt_id"),
            value.alias("iou"), F.col("b.is_crowd").alias("is_crowd"), F.col("b.area").alias("area"),
        )
    else:
        from .masks import block_overlap, blocks

        dp, gp = masks
        tagged = lambda px, df, k: blocks(px, ["image_id", k]).join(df.select(*KEYS, k).distinct(), ["image_id", k])
        pairs = block_overlap(tagged(dp, det, "det_id"), tagged(gp, gt, "gt_id"), "det_id", "gt_id", KEYS)
        joined = pairs.join(gt.select("gt_id", "is_crowd", "area"), "gt_id").join(det.select("det_id", "rank"), "det_id")
        flat = joined.select(
            *KEYS, "det_id", "rank", "gt_id", F.when(F.col("is_crowd"), F.col("ioa_a")).otherwise(F.col("iou")).alias("iou"), "is_crowd", "area"
        )
    flat = flat.where(F.col("iou") >= THRESHOLDS[0]).withColumn("bands", _bands(F.col("area")))
    order = [F.col("iou").desc(), F.col("gt_id").desc()]
    return top_per_key(flat, ["det_id", "is_crowd", "bands"], order, MAX_DETECTIONS[-1], "_n").drop("_n", "area")


def coco_cells(det: DataFrame, gt: DataFrame, masks=None, **grid) -> DataFrame:
    """AP and AR per class, threshold and size band, for cells with ground truth."""
    if "is_crowd" not in gt.columns:
        gt = gt.withColumn("is_crowd", F.lit(False))
    if masks is not None:
        size = lambda p, k: p.groupBy(k).agg(F.count("*").alias("area"))
        det = det.drop("area").join(size(masks[0], "det_id"), "det_id")
        gt = gt.drop("area").join(size(masks[1], "gt_id"), "gt_id")
    else:
        det = det.withColumn("area", Box.of().area())
        if "area" not in gt.columns:
            gt = gt.withColumn("area", Box.of().area())
    top = top_per_key(det, KEYS, [F.col("score").desc(), F.col("det_id")], MAX_DETECTIONS[-1])
    matched = candidates(top, gt, masks, **grid).groupBy(*KEYS).applyInPandas(
        _match, "det_id long, band string, state array<int>"
    )
    steps = range(len(THRESHOLDS))
    rows = top.select(
        "class_id", F.col("det_id").alias("rank_id"), "score", "rank", _bands(F.col("area")).alias("own"),
        F.explode(F.array(*(F.lit(b) for b in BANDS))).alias("band"),
    )
    state = lambda t: F.coalesce(F.col("state")[t], F.lit(0))
    own = F.array_contains("own", F.col("band"))
    scored = (
        rows.join(matched.withColumnRenamed("det_id", "rank_id"), ["rank_id", "band"], "left")
        .where(own | F.col("state").isNotNull())
        .select(
            *CELL, "rank_id", "score", "rank",
            *((state(t) == 1).cast("int").alias(f"tp_{t}") for t in steps),
            *(((state(t) == 1) | ((state(t) == 0) & own)).cast("int").alias(f"seen_{t}") for t in steps),
        )
    )
    counts = (
        gt.where("NOT is_crowd")
        .select("class_id", F.explode(_bands(F.col("area"))).alias("band"))
        .groupBy(*CELL)
        .agg(F.count("*").alias("n_gt"))
    )
    # all ten thresholds share one order, so they are ten columns of one running sum
    order = [F.col("score").desc(), F.col("rank_id").asc()]
    staged = ordering.range_bucketed(scored, CELL, order)
    sums = {f"cum_{c}": c for t in steps for c in (f"tp_{t}", f"seen_{t}")}
    curve = ordering.running_sums(staged, CELL, order, sums)
    point = lambda t: F.when(
        F.col(f"tp_{t}") == 1,
        F.struct(F.lit(t).alias("t"), F.col(f"cum_tp_{t}").alias("cum"), (F.col(f"cum_tp_{t}") / F.col(f"cum_seen_{t}")).alias("precision")),
    )
    hit = F.greatest(*(F.col(f"tp_{t}") for t in steps)) == 1
    points = F.filter(F.array(*(point(t) for t in steps)), lambda v: v.isNotNull())
    hits = stage(
        curve.where(hit).select(*CELL, ordering.BUCKET, "rank_id", "score", F.inline(points)), "hits"
    )
    env = ordering.running_max_from_end(hits, [*CELL, "t"], order, "precision", "envelope").join(counts, CELL)
    # 101 recall points: those in (previous recall, recall], plus point 0 for the first hit
    passed = F.floor(F.col("cum") * 100 / F.col("n_gt")) - F.floor((F.col("cum") - 1) * 100 / F.col("n_gt"))
    passed = passed + (F.col("cum") == 1).cast("long")
    ap = env.groupBy(*CELL, "t").agg((F.sum(passed * F.col("envelope")) / 101).alias("ap"))
    per_t = F.array(
        *(
            F.struct(F.lit(t).alias("t"), *(F.sum(F.when(F.col("rank") <= k, F.col(f"tp_{t}")).otherwise(0)).alias(f"hits_{k}") for k in MAX_DETECTIONS))
            for t in steps
        )
    )
    ar = staged.groupBy(*CELL).agg(per_t.alias("r")).select(*CELL, F.inline("r"))
    every = counts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1))))
    return (
        every.join(ap, [*CELL, "t"], "left")
        .join(ar, [*CELL, "t"], "left")
        .select(
            *CELL, "t", "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"),
            *((F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_gt")).alias(f"ar_{k}") for k in MAX_DETECTIONS),
        )
    )


def summarize(cells: DataFrame, by_category: bool = False) -> DataFrame:
    """The twelve summary numbers, overall or also per category (grouping sets).

    ``class_id`` is null in the overall row.
    """
    def mean(col, band, t=None):
        cond = F.col("band") == band
        if t is not None:
            cond = cond & (F.col("t") == t)
        return F.avg(F.when(cond, F.col(col)))

    metrics = {
        "ap": mean("ap", "all"), "ap_50": mean("ap", "all", 0), "ap_75": mean("ap", "all", 5),
        "ap_small": mean("ap", "small"), "ap_medium": mean("ap", "medium"), "ap_large": mean("ap", "large"),
        "ar_1": mean("ar_1", "all"), "ar_10": mean("ar_10", "all"), "ar_100": mean("ar_100", "all"),
        "ar_small": mean("ar_100", "small"), "ar_medium": mean("ar_100", "medium"), "ar_large": mean("ar_100", "large"),
    }
    aggs = [e.alias(n) for n, e in metrics.items()]
    if not by_category:
        return cells.agg(*aggs)
    return cells.groupingSets([["class_id"], []], "class_id").agg(*aggs)


def eval_coco(det: DataFrame, gt: DataFrame, masks=None, by_category: bool = False, **grid) -> DataFrame:
    return summarize(coco_cells(det, gt, masks, **grid), by_category)
