"""Detection quality: matching, precision/recall, AP, CorLoc and rank metrics.

Frames
    det  det_id, image_id, class_id, score, xmin, ymin, xmax, ymax
    gt   gt_id, image_id, class_id, xmin, ymin, xmax, ymax, difficult, group_of

Matching is a grid join followed by aggregates with map-side combine; the
precision/recall curve uses range-partitioned running sums, so neither one image
nor one class has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.boxes import BOX, Box, enclosing, ioa, iou
from ..runtime import stage
from . import ordering
from .overlap import _pad, box_pairs

KEYS = ("image_id", "class_id")


def with_flags(gt: DataFrame) -> DataFrame:
    """Ground truth without flags counts as neither difficult nor group-of."""
    for flag in ("difficult", "group_of"):
        if flag not in gt.columns:
            gt = gt.withColumn(flag, F.lit(False))
    return gt


def valid_boxes(df: DataFrame) -> DataFrame:
    return df.where("xmin < xmax AND ymin < ymax")


def _best_columns(value_iou: Column, value_ioa: Column, pick: Column) -> list[Column]:
    """Best plain and best group-of ground truth as max-structs; ties take the lowest id."""
    group = pick["group_of"]

    def best(value, keep):
        return F.max(
            F.when(keep & (value > 0), F.struct(value.alias("v"), (-pick["gt_id"]).alias("neg"), pick["difficult"].alias("difficult")))
        )

    return [best(value_iou, ~group).alias("_plain"), best(value_ioa, group).alias("_group")]


def _unpack(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "iou": F.coalesce(F.col("_plain.v"), F.lit(0.0)),
            "gt_id": -F.col("_plain.neg"),
            "hit_difficult": F.coalesce(F.col("_plain.difficult"), F.lit(False)),
            "ioa": F.coalesce(F.col("_group.v"), F.lit(0.0)),
            "group_id": -F.col("_group.neg"),
        }
    ).drop("_plain", "_group")


def best_boxes(det: DataFrame, gt: DataFrame, keys=KEYS, plus: int = 0, **grid) -> DataFrame:
    """Per detection: best IoU over plain boxes and best IoA over group-of boxes.

    Copies of a box are merged on both sides before the join and the answer is
    joined back, so duplicated detections do not multiply the pairs.
    """
    keys = list(keys)
    place = [*keys, *BOX]
    gt = with_flags(gt).groupBy(*place, "group_of").agg(F.min(F.struct("gt_id", "difficult")).alias("_first"))
    gt = gt.select(*place, "group_of", "_first.gt_id", "_first.difficult")
    pairs = box_pairs(_pad(det.select(*place).distinct(), plus), _pad(gt, plus), keys, **grid)
    a, b = Box.of("a"), Box.of("b")
    best = (
        pairs.withColumns({"_iou": iou(a, b), "_ioa": ioa(b, a)})
        .groupBy(*keys, *(F.col(f"a.{c}").alias(c) for c in BOX))
        .agg(*_best_columns(F.col("_iou"), F.col("_ioa"), F.col("b")))
    )
    if plus:
        best = best.withColumn("xmax", F.col("xmax") - plus).withColumn("ymax", F.col("ymax") - plus)
    return _unpack(det.join(best, place, "left"))


def best_masks(det, gt, det_pixels, gt_pixels, keys=KEYS) -> DataFrame:
    """Same as :func:`best_boxes` with pixel masks ``(image_id, id, y, x)``."""
    from .masks import block_overlap, blocks

    keys = list(keys)
    dk = det.select(*keys, "det_id").distinct()
    gk = with_flags(gt).select(*keys, "gt_id", "difficult", "group_of")
    pairs = (
        block_overlap(
            blocks(det_pixels, ["image_id", "det_id"]).join(dk, ["image_id", "det_id"]),
            blocks(gt_pixels, ["image_id", "gt_id"]).join(gk.select(*keys, "gt_id").distinct(), ["image_id", "gt_id"]),
            "det_id", "gt_id", keys,
        )
        .join(gk, [*keys, "gt_id"])
        .withColumn("b", F.struct("gt_id", "difficult", "group_of"))
    )
    best = pairs.groupBy(*keys, "det_id").agg(
        *_best_columns(F.col("iou"), F.col("ioa_a"), F.col("b"))
    )
    return _unpack(det.join(best, [*keys, "det_id"], "left"))


def claims(best: DataFrame, threshold: float, keys=KEYS) -> DataFrame:
    """Mark the first detection, in score order, that claims each ground truth.

    Adds ``matched`` (best IoU reaches the threshold) and ``tp``. A detection
    whose best ground truth is taken is not matched again. ``best`` is staged,
    since it is read for the winners and for the rows that they mark.
    """
    keys = list(keys)
    best = stage(best.withColumn("matched", F.col("iou") >= threshold), "best")
    winners = (
        best.where("matched AND NOT hit_difficult")
        .groupBy(*keys, "gt_id")
        .agg(F.max(F.struct("score", (-F.col("det_id")).alias("neg"))).alias("_w"))
        .select(*keys, (-F.col("_w.neg")).alias("det_id"), F.lit(True).alias("tp"))
    )
    return best.join(winners, [*keys, "det_id"], "left").withColumn(
        "tp", F.coalesce(F.col("tp"), F.lit(False))
    )


def score_detections(
    best: DataFrame,
    threshold: float = 0.5,
    group_of_weight: float = 0.0,
    duplicates: str = "fp",
    keys=KEYS,
) -> DataFrame:
    """Scored rows ``keys, rank_id, score, tp`` ready for precision/recall.

    Detections on difficult ground truth are left out. Non-hits inside a group-of
    box are absorbed; each group with a positive weight contributes one row with
    its best absorbed score. ``duplicates='ignore'`` also leaves out later claims.
    """
    keys = list(keys)
    best = best.select(*keys, "det_id", "score", "iou", "gt_id", "hit_difficult", "ioa", "group_id")
    claimed = claims(best, threshold, keys)
    absorbed = (
        ~F.col("tp") & ~(F.col("matched") & F.col("hit_difficult")) & (F.col("ioa") >= threshold)
        & F.col("group_id").isNotNull()
    )
    labelled = claimed.withColumn("_absorbed", absorbed)
    keep = ~(F.col("matched") & F.col("hit_difficult")) & ~F.col("_absorbed")
    if duplicates == "ignore":
        keep = keep & ~(F.col("matched") & ~F.col("tp"))
    elif duplicates != "fp":
        raise ValueError("duplicates must be 'fp' or 'ignore'")
    rows = labelled.where(keep).select(
        *keys, F.col("det_id").alias("rank_id"), "score", F.col("tp").cast("double").alias("tp")
    )
    if group_of_weight > 0:
        groups = (
            labelled.where("_absorbed AND score > 0")
            .groupBy(*keys, "group_id")
            .agg(F.max("score").alias("score"))
            .select(*keys, (-1 - F.col("group_id")).alias("rank_id"), "score", F.lit(float(group_of_weight)).alias("tp"))
        )
        rows = rows.unionByName(groups)
    return rows


def gt_counts(gt: DataFrame, keys=("class_id",), group_of_weight: float = 0.0) -> DataFrame:
    """Instances per key without difficult and group-of ones, and images per key."""
    plain = F.sum(F.when(~F.col("difficult") & ~F.col("group_of"), 1.0).otherwise(0.0))
    groups = F.sum(F.when(F.col("group_of"), float(group_of_weight)).otherwise(0.0))
    return with_flags(gt).groupBy(*keys).agg(
        (plain + groups).alias("n_gt"), F.countDistinct("image_id").alias("n_images")
    )




def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("rank_id").asc()]


def precision_recall(scored: DataFrame, counts: DataFrame, keys=("class_id",)) -> DataFrame:
    """Cumulative TP and FP, precision and recall in score order, per key."""
    keys = list(keys)
    rows = scored.select(
        *keys, "rank_id", "score", "tp", F.when(F.col("tp") <= 0, 1.0).otherwise(0.0).alias("fp")
    )
    staged = ordering.range_bucketed(rows, keys, _order())
    curve = ordering.running_sums(staged, keys, _order(), {"cum_tp": "tp", "cum_fp": "fp"})
    curve = curve.join(counts.where("n_gt > 0").select(*keys, "n_gt"), keys) if keys else curve.withColumn(
        "n_gt", counts.agg(F.sum("n_gt")).scalar()
    )
    return curve.withColumns(
        {
            "precision": F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")),
            "recall": F.col("cum_tp") / F.col("n_gt"),
        }
    )


def precision_envelope(curve: DataFrame, keys=("class_id",)) -> DataFrame:
    """Best precision at this recall or a higher one (column ``envelope``).

    Only true positives are kept: precision falls at every false positive, so the
    envelope and the recall steps are decided by true positives alone. They are
    staged because the running maximum reads them twice.
    """
    hits = stage(curve.where("tp > 0"), "hits")
    return ordering.running_max_from_end(hits, list(keys), _order(), "precision", "envelope")


def average_precision(scored: DataFrame, counts: DataFrame, keys=("class_id",)) -> DataFrame:
    """AP per key; keys with ground truth but no hit get 0, keys without are left out."""
    keys = list(keys)
    curve = precision_envelope(precision_recall(scored, counts, keys), keys)
    ap = curve.groupBy(*keys).agg((F.sum(F.col("tp") * F.col("envelope") / F.col("n_gt"))).alias("ap"))
    if not keys:
        return ap.select(F.coalesce("ap", F.lit(0.0)).alias("ap"))
    return (
        counts.where("n_gt > 0")
        .join(ap, keys, "left")
        .select(*keys, "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"))
    )


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("map"))


def corloc(best: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of images whose top detection of a class hits any ground truth.

    ``best`` must come from ground truth without group-of splitting, because
    CorLoc treats every box alike.
    """
    top = best.groupBy(*KEYS).agg(
        F.max(F.struct("score", (-F.col("det_id")).alias("neg"), "iou")).alias("_t")
    )
    hits = top.where(F.col("_t.iou") >= threshold).groupBy("class_id").agg(F.count("*").alias("hits"))
    images = gt.groupBy("class_id").agg(F.countDistinct("image_id").alias("n_images"))
    return images.join(hits, "class_id", "left").select(
        "class_id", "n_images", (F.coalesce("hits", F.lit(0)) / F.col("n_images")).alias("corloc")
    )


def top_k_per_image(scored: DataFrame, k: int, image: str = "image_id") -> DataFrame:
    return ordering.top_per_key(scored, [image], _order(), k)


def recall_at_k(scored: DataFrame, n_gt: Column, k: int) -> DataFrame:
    """Share of ground truth found among the ``k`` best detections of each image."""
    top = top_k_per_image(scored, k).agg(F.sum("tp").alias("hits"))
    return top.select((F.coalesce("hits", F.lit(0.0)) / n_gt).alias(f"recall_at_{k}"))


def median_rank_at_k(scored: DataFrame, k: int) -> DataFrame:
    """Median zero-based rank of the hits among each image's ``k`` best."""
    ranks = top_k_per_image(scored, k).where("tp > 0")
    return ranks.agg(F.median(F.col("rank") - 1).alias(f"median_rank_at_{k}"))


# ---------------------------------------------------------------- protocols


def eval_voc(det, gt, threshold: float = 0.5, plus: int = 1, **grid) -> DataFrame:
    """VOC text protocol: pixel-inclusive boxes, later claims ignored, all gt counted."""
    gt = gt.withColumn("difficult", F.lit(False)).withColumn("group_of", F.lit(False))
    scored = score_detections(best_boxes(det, gt, plus=plus, **grid), threshold, duplicates="ignore")
    return average_precision(scored, gt_counts(gt))


def eval_detection(
    det, gt, threshold: float = 0.5, group_of_weight: float = 0.0, masks=None, nms_threshold: float | None = None,
    nms_max_output: int | None = None, **grid,
) -> DataFrame:
    """Per class: ground-truth count, AP and CorLoc.

    Invalid detections are dropped, difficult ground truth is ignored. ``masks``
    is an optional pair of pixel tables (detections, ground truth). With ``nms_threshold`` detections
    are suppressed per image and class first, and at most ``nms_max_output`` of them stay.
    """
    det, gt = valid_boxes(det), with_flags(gt)
    if nms_threshold is not None:
        from .suppress import nms

        det = stage(nms(det, nms_threshold, KEYS, max_output=nms_max_output), "suppressed")
    plain = gt.withColumn("group_of", F.lit(False))
    if masks is None:
        best, loose = best_boxes(det, gt, **grid), best_boxes(det, plain, **grid)
    else:
        best, loose = best_masks(det, gt, *masks), best_masks(det, plain, *masks)
    ap = average_precision(
        score_detections(best, threshold, group_of_weight), gt_counts(gt, group_of_weight=group_of_weight)
    )
    return ap.join(corloc(loose, gt, threshold), "class_id", "full")


def verified_only(det: DataFrame, gt: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Detections whose class is verified, or annotated, for their image."""
    known = gt.select(*KEYS)
    if labels is not None:
        known = known.unionByName(labels.select(*KEYS))
    return det.join(known.distinct(), list(KEYS), "left_semi")


def eval_open_images(det, gt, labels=None, threshold: float = 0.5, group_of_weight: float = 1.0, **grid) -> DataFrame:
    """Open Images protocol: verified labels only, group-of boxes weighted."""
    det = verified_only(valid_boxes(det), gt, labels)
    gt = with_flags(gt)
    scored = score_detections(best_boxes(det, gt, **grid), threshold, group_of_weight)
    return average_precision(scored, gt_counts(gt, group_of_weight=group_of_weight))


def eval_weighted(det, gt, threshold: float = 0.5, group_of_weight: float = 0.0, masks=None, **grid) -> DataFrame:
    """AP over the pooled detections of all classes that have ground truth."""
    det, gt = valid_boxes(det), with_flags(gt)
    best = best_boxes(det, gt, **grid) if masks is None else best_masks(det, gt, *masks)
    counts = gt_counts(gt, group_of_weight=group_of_weight)
    scored = score_detections(best, threshold, group_of_weight).join(
        counts.where("n_gt > 0").select("class_id"), "class_id", "left_semi"
    )
    return average_precision(scored, counts, ())


def verified_relations(det: DataFrame, gt: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Relation detections that can be judged in their image.

    Both labels must occur in the image's ground truth or among its verified
    ``labels (image_id, label)``, or one of them must be verified as absent.
    """
    seen = gt.select("image_id", F.explode(F.array("subject_label", "object_label")).alias("label"), F.lit(1).alias("present"))
    if labels is not None:
        seen = seen.unionByName(labels.select("image_id", "label", F.lit(0).alias("present")))
    status = seen.groupBy("image_id", "label").agg(F.max("present").alias("present"))
    for side in ("subject", "object"):
        det = det.join(
            status.select("image_id", F.col("label").alias(f"{side}_label"), F.col("present").alias(f"_{side}")),
            ["image_id", f"{side}_label"], "left",
        )
    known = F.col("_subject").isNotNull() & F.col("_object").isNotNull()
    absent = F.col("_subject").eqNullSafe(F.lit(0)) | F.col("_object").eqNullSafe(F.lit(0))
    return det.where(known | absent).drop("_subject", "_object")


def eval_relations(
    det: DataFrame, gt: DataFrame, threshold: float = 0.5, phrases: bool = False, labels: DataFrame | None = None, **grid
) -> DataFrame:
    """Relation (or phrase) metrics as ``(metric, value)`` rows.

    Frames carry struct columns ``subject`` and ``object`` (boxes), label columns
    ``subject_label``, ``object_label``, ``relation``, and ``image_id``; detections
    add ``det_id`` and ``score``, ground truth ``gt_id``.
    """
    det = verified_relations(det, gt, labels)
    scored = stage(score_relations(det, gt, threshold, phrases, **grid), "scored")
    counts = gt.groupBy("relation").agg(F.count("*").cast("double").alias("n_gt"))
    total = gt.agg(F.count("*").alias("n")).scalar()
    per_relation = average_precision(scored, counts, ("relation",))
    out = [
        per_relation.select(F.concat(F.lit("ap_"), F.col("relation").cast("string")).alias("metric"), F.col("ap").alias("value")),
        per_relation.agg(F.avg("ap").alias("value")).select(F.lit("map").alias("metric"), "value"),
        average_precision(scored, counts, ()).select(F.lit("weighted_ap").alias("metric"), F.col("ap").alias("value")),
    ]
    for k in (50, 100):
        out.append(recall_at_k(scored, total, k).select(F.lit(f"recall_at_{k}").alias("metric"), F.col(f"recall_at_{k}").alias("value")))
        out.append(
            median_rank_at_k(scored, k).select(
                F.lit(f"median_rank_at_{k}").alias("metric"), F.col(f"median_rank_at_{k}").cast("double").alias("value")
            )
        )
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def score_relations(det, gt, threshold: float = 0.5, phrases: bool = False, **grid) -> DataFrame:
    """TP/FP rows for relation tuples; overlap is the least IoU of the paired boxes.

    Candidates come from a grid join on the subject boxes (the enclosing boxes for
    phrases): a tuple can only match when that pair intersects.
    """
    keys = ["image_id", "subject_label", "object_label", "relation"]
    parts = {"s": Box.of("subject"), "o": Box.of("object")}
    lead = enclosing(parts["s"], parts["o"]) if phrases else parts["s"]
    flat = {f"{p}_{n}": c for p, box in parts.items() for n, c in box.columns().items()}
    tail = ["subject", "object"]

    def spread(df, *extra):
        return df.select(*keys, *extra, *(c.alias(n) for n, c in {**flat, **lead.columns()}.items()))

    gt = spread(gt.groupBy(*keys, *tail).agg(F.min("gt_id").alias("gt_id")), "gt_id")
    pairs = box_pairs(spread(det).distinct(), gt, keys, **grid)
    if phrases:
        overlap = iou(Box.of("a"), Box.of("b"))
    else:
        overlap = F.least(*(iou(_part("a", p), _part("b", p)) for p in parts))
    best = (
        pairs.withColumn("_ov", overlap)
        .where("_ov > 0")
        .groupBy(*keys, *(F.col(f"a.{n}").alias(n) for n in flat))
        .agg(F.max(F.struct("_ov", (-F.col("b.gt_id")).alias("neg"))).alias("_b"))
        .select(
            *keys,
            *(F.struct(*(F.col(f"{p}_{n}").alias(n) for n in BOX)).alias(name) for p, name in zip(parts, tail)),
            F.col("_b._ov").alias("iou"), (-F.col("_b.neg")).alias("gt_id"),
        )
    )
    joined = det.join(best, [*keys, *tail], "left").withColumns(
        {"iou": F.coalesce("iou", F.lit(0.0)), "hit_difficult": F.lit(False)}
    )
    marked = claims(joined.drop(*tail), threshold, keys)
    return marked.select(*keys, F.col("det_id").alias("rank_id"), "score", F.col("tp").cast("double").alias("tp"))


def _part(side: str, part: str) -> Box:
    return Box(*(F.col(f"{side}.{part}_{n}") for n in BOX))


def min_iou(a_subject: Box, a_object: Box, b_subject: Box, b_object: Box) -> Column:
    """Overlap of two relation tuples."""
    return F.least(iou(a_subject, b_subject), iou(a_object, b_object))


def mean_loss_accuracy(df: DataFrame, loss: str, predicted: str, label: str) -> DataFrame:
    return df.agg(
        F.avg(loss).alias("mean_loss"),
        F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"),
    )


def metric_rows(df: DataFrame) -> DataFrame:
    """One-row metric frame as ``(metric, value)`` rows."""
    return df.unpivot([], df.columns, "metric", "value")


EVALUATORS = {
    "voc": eval_voc,
    "detection": eval_detection,
    "open_images": eval_open_images,
    "weighted": eval_weighted,
    "relations": eval_relations,
    "phrases": lambda det, gt, **kw: eval_relations(det, gt, phrases=True, **kw),
}


def evaluator(name: str):
    """Look up an evaluation protocol by name."""
    if name == "coco":
        from .coco import eval_coco

        return eval_coco
    try:
        return EVALUATORS[name]
    except KeyError:
        raise ValueError(f"unknown evaluator {name!r}; choose from {sorted([*EVALUATORS, 'coco'])}") from None
