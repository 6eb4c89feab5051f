"""Marker gating, rule-based cell types, probabilities and region tables.

Marker columns are unpivoted to long rows ``(ID, biomarker, value)``; gates and
rules are small tables joined on the marker name. Nothing is broadcast by hint:
the planner does so when the measured table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pixels import area_um2, density
from ..runtime import many
from .ordering import top_per_key

KEY_COLUMNS = ("slide", "ID", "centroid_x", "centroid_y", "xmin", "ymin", "xmax", "ymax", "region")


def marker_columns(df: DataFrame, exclude=KEY_COLUMNS) -> list[str]:
    """Every column that is not a key column is a marker."""
    return [c for c in df.columns if c not in exclude]


def to_long(df: DataFrame, ids=("ID",), markers=None) -> DataFrame:
    return df.unpivot(list(ids), markers or marker_columns(df), "biomarker", "value")


def to_wide(long: DataFrame, markers, ids=("ID",), value: str = "value") -> DataFrame:
    """One column per listed marker; the list makes the schema fixed."""
    return long.groupBy(*ids).pivot("biomarker", list(markers)).agg(F.first(value, ignorenulls=True))


def align(boxes: DataFrame, features: DataFrame, on=("centroid_x", "centroid_y")) -> DataFrame:
    """Join by ID; a missing partner or a different centre is an error."""
    f = features.select("ID", *(F.col(c).alias(f"_{c}") for c in on), *(c for c in features.columns if c not in ("ID", *on)))
    b = boxes.withColumn("_left", F.lit(True))
    f = f.withColumn("_right", F.lit(True))
    joined = b.join(f, "ID", "full")
    same = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    key = F.when(same, F.col("ID")).otherwise(F.raise_error(F.lit("box and feature tables differ")))
    return joined.withColumn("ID", key).drop("_left", "_right", *(f"_{c}" for c in on))


def mismatches(boxes: DataFrame, features: DataFrame, on=("centroid_x", "centroid_y")) -> DataFrame:
    """How many IDs are missing on either side or have a different centre."""
    f = features.select("ID", *(F.col(c).alias(f"_{c}") for c in on), F.lit(1).alias("_r"))
    j = boxes.select("ID", *on, F.lit(1).alias("_l")).join(f, "ID", "full")
    differ = F.lit(False)
    for c in on:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.agg(
        F.count_if(F.col("_l").isNull()).alias("only_features"),
        F.count_if(F.col("_r").isNull()).alias("only_boxes"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & differ).alias("different"),
    )


def gate(long: DataFrame, thresholds: DataFrame, strict: bool = False) -> DataFrame:
    """1 where the value reaches the marker's threshold; null thresholds are skipped."""
    dim = thresholds.where("Threshold IS NOT NULL").select(F.col("Biomarker").alias("biomarker"), F.col("Threshold").alias("_t"))
    hit = F.col("value") > F.col("_t") if strict else F.col("value") >= F.col("_t")
    return long.join(dim, "biomarker").withColumn("value", hit.cast("int")).drop("_t")


def gate_wide(df: DataFrame, thresholds: DataFrame, markers, strict: bool = False) -> DataFrame:
    """Gate wide marker columns from a threshold table without moving a cell.

    Only the rows of ``markers`` are read, one number each, so the schema bounds what is
    attached to a cell, and there is no unpivot, join or pivot. A marker without a threshold becomes null;
    of several thresholds the largest counts.
    """
    of = thresholds.where(F.col("Threshold").isNotNull() & F.col("Biomarker").isin(*markers))
    best = of.agg(*(F.max(F.when(F.col("Biomarker") == m, F.col("Threshold"))).alias(f"t{i}") for i, m in enumerate(markers)))
    limits = best.select(F.create_map(*(x for i, m in enumerate(markers) for x in (F.lit(m), F.col(f"t{i}")))).alias("m")).scalar()
    out = df.withColumn("_limits", limits)

    def hit(m):
        t = F.col("_limits")[m]
        return (F.col(m) > t if strict else F.col(m) >= t).cast("int")

    return out.withColumns({m: hit(m) for m in markers}).drop("_limits")


def gate_with(df: DataFrame, thresholds: dict[str, float], strict: bool = False) -> DataFrame:
    """Gate wide marker columns with fixed thresholds, in place."""
    def hit(m, t):
        return (F.col(m) > t if strict else F.col(m) >= t).cast("int")

    return df.withColumns({m: hit(m, t) for m, t in thresholds.items()})


def rules_to_long(rules: DataFrame, order: str = "rule_order", name: str = "Type") -> DataFrame:
    """Rule matrix to ``(rule_order, type, biomarker, required)``; wildcards vanish."""
    from ..functions.pixels import rule_token

    markers = [c for c in rules.columns if c not in (order, name)]
    long = rules.unpivot([order, name], markers, "biomarker", "token")
    return (
        long.withColumn("required", rule_token(F.col("token")))
        .where("required IS NOT NULL")
        .select(F.col(order).alias("rule_order"), F.col(name).alias("type"), "biomarker", "required")
    )


def assign_types(long: DataFrame, rules: DataFrame, ids=("ID",)) -> DataFrame:
    """Cell type per cell: all non-wildcard markers equal; the last matching rule wins.

    A cell satisfies a rule when its number of equal markers is the rule's
    length, so the division is one join and two aggregates. The aggregates
    combine before the shuffle because cells are the grouping key.
    """
    ids = list(ids)
    sized = rules.join(rules.groupBy("rule_order").agg(F.count("*").alias("_size")), "rule_order")
    hits = (
        long.join(sized, "biomarker")
        .where(F.col("value") == F.col("required"))
        .groupBy(*ids, "rule_order", "type", "_size")
        .agg(F.count("*").alias("_n"))
        .where("_n = _size")
        .groupBy(*ids)
        .agg(F.max_by("type", "rule_order").alias("cell_type"))
    )
    return long.select(*ids).distinct().join(hits, ids, "left")


def assign_types_wide(df: DataFrame, rules: DataFrame, id_col: str = "ID", markers=None) -> DataFrame:
    """Same as :func:`assign_types` for a wide 0/1 table.

    Cells with the same marker pattern have the same type, so the rules are
    matched once per distinct pattern (found with map-side combine) and the
    answer is joined back.
    """
    markers = list(markers or [c for c in marker_columns(df) if c != id_col])
    keyed = df.withColumn("_pattern", F.concat_ws(",", *(F.coalesce(F.col(m).cast("string"), F.lit("?")) for m in markers)))
    patterns = keyed.select("_pattern", *markers).distinct()
    types = assign_types(to_long(patterns, ["_pattern"], markers), rules, ["_pattern"])
    return keyed.select(id_col, "_pattern").join(types, "_pattern", "left").select(id_col, "cell_type")


def major_function(df: DataFrame, rules: DataFrame, major: dict[str, str], id_col: str = "ID") -> DataFrame:
    """Cell ``type`` from major markers and ``function`` from functional markers.

    ``rules`` has ``rule_order``, ``Cell Type`` and ``Biomarker``. A rule named
    like a major type sets the type of positive cells that have no function yet;
    any other rule belongs to the first major type its name contains and sets the
    function of cells positive for both markers. Later rules win.
    """
    markers = [c for c in marker_columns(df) if c != id_col]
    # the answer follows from the positive markers of a cell, so the rules are matched once for each set of them
    cells = df.groupBy(id_col).agg(*(F.max(F.col(m).eqNullSafe(1)).alias(m) for m in markers))
    pattern = F.concat_ws(",", *(F.col(m).cast("int").cast("string") for m in markers))
    cells = cells.withColumn("_pattern", pattern)
    kinds = cells.select("_pattern", *(F.col(m).cast("int").alias(m) for m in markers)).distinct()
    found = _major_function(kinds, markers, rules, major)
    named = cells.select(id_col, "_pattern").join(found, "_pattern", "left").drop("_pattern")
    return df.select(id_col).join(named, id_col, "left").select(id_col, "type", "function")


def _major_function(df: DataFrame, markers, rules: DataFrame, major: dict[str, str], id_col: str = "_pattern") -> DataFrame:
    long = to_long(df, [id_col], markers).where("value = 1").select(id_col, "biomarker")
    named = F.col("Cell Type")
    owner = F.coalesce(*(F.when(named.contains(n), F.lit(m)) for n, m in major.items()))
    r = rules.select(
        "rule_order", named.alias("name"), F.col("Biomarker").alias("biomarker"),
        named.isin(*major).alias("is_major"), owner.alias("owner"),
    )
    hits = long.join(r, "biomarker")
    functional = (
        hits.where("NOT is_major")
        .join(long.withColumnRenamed("biomarker", "owner"), [id_col, "owner"])
        .groupBy(id_col)
        .agg(F.max_by("name", "rule_order").alias("function"), F.min("rule_order").alias("_first"))
    )
    typed = (
        hits.where("is_major")
        .join(functional.select(id_col, "_first"), id_col, "left")
        .where("_first IS NULL OR rule_order < _first")
        .groupBy(id_col)
        .agg(F.max_by("name", "rule_order").alias("type"))
    )
    return df.select(id_col).join(typed, id_col, "left").join(functional.drop("_first"), id_col, "left").select(
        id_col, "type", "function"
    )


def argmax_class(long: DataFrame, ids=("ID",), ties: str = "first") -> DataFrame:
    """Marker with the largest value; ties take the first name or keep all of them."""
    ids = list(ids)
    best = long.groupBy(*ids).agg(F.max("value").alias("_best"))
    top = long.join(best, ids).where(F.col("value") == F.col("_best")).drop("_best")
    if ties == "all":
        return top
    return top.groupBy(*ids).agg(F.min("biomarker").alias("biomarker"), F.first("value").alias("value"))


def argmax_wide(df: DataFrame, markers, name: str = "biomarker") -> DataFrame:
    """Marker of the largest value, first in the given order on ties, and all tied markers.

    Works on the row alone; adds ``name`` and ``tied``.
    """
    best = F.greatest(*(F.col(m) for m in markers))
    tied = F.filter(F.array(*(F.when(F.col(m) == best, F.lit(m)) for m in markers)), lambda v: v.isNotNull())
    return df.withColumn("tied", tied).withColumn(name, F.get("tied", F.lit(0)))


def gate_probabilities(df: DataFrame, classes, threshold: float) -> DataFrame:
    """One-hot argmax over the class columns; all zeros when every class is below the threshold.

    Ties take the first class. Works on a stored probability table, so
    thresholds can be changed without scoring again.
    """
    best = F.greatest(*(F.col(c) for c in classes))
    first = F.coalesce(*(F.when(F.col(c) == best, F.lit(i)) for i, c in enumerate(classes)))
    return df.withColumns({c: ((first == i) & (best >= threshold)).cast("int") for i, c in enumerate(classes)})


def auto_label(intensity: DataFrame, exclude=("DAPI", "Histones"), ids=("ID",)) -> DataFrame:
    """Label of a cell: the marker of highest mean intensity, nuclear stains left out."""
    return argmax_class(intensity.where(~F.col("biomarker").isin(*exclude)), ids)


def top_n_per_channel(long: DataFrame, n: int, id_col: str = "ID") -> DataFrame:
    """Union of the ``n`` brightest cells of each channel, without repeats."""
    top = top_per_key(long, ["biomarker"], [F.col("value").desc(), F.col(id_col)], n)
    return top.select(id_col).distinct()


def type_summary(types: DataFrame) -> DataFrame:
    """Cells per type and their share; untyped cells count as ``uncategorized``."""
    total = types.agg(F.count("*").alias("n")).scalar()
    named = types.select(F.coalesce("cell_type", F.lit("uncategorized")).alias("cell_type"))
    counts = named.groupBy("cell_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / total)


# --------------------------------------------------------------------- regions


def region_pixels(regions: DataFrame) -> DataFrame:
    """Rectangles ``(region, list_order, x0, x1, y0, y1)`` as pixels."""
    rows = regions.select("region", "list_order", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    return many(rows.select("region", "list_order", "y", F.explode(F.sequence("x0", "x1")).alias("x")))


def point_in_region(points: DataFrame, pixels: DataFrame, x: str = "centroid_x", y: str = "centroid_y", on=()) -> DataFrame:
    """Region of the pixel under each point; the region listed last wins.

    Region pixels are reduced to those under a point before anything else and the
    winner per pixel is an aggregate, so neither overlapping regions nor piles of
    points multiply rows.
    """
    on = list(on)
    spots = points.select(*on, F.col(y).alias("y"), F.col(x).alias("x")).distinct()
    named = (
        pixels.join(spots, [*on, "y", "x"], "left_semi")
        .groupBy(*on, "y", "x")
        .agg(F.max(F.struct("list_order", "region")).alias("_w"))
        .select(*on, "y", "x", F.col("_w.region").alias("region"))
    )
    # the planner takes these pixels for as few as the regions, and would broadcast them
    p = many(points.withColumns({"y": F.col(y), "x": F.col(x)}))
    return p.join(named, [*on, "y", "x"], "left").drop("y", "x")


def region_counts(df: DataFrame, markers) -> DataFrame:
    """Positive cells per region and marker; cells without a region are left out."""
    return (
        df.where("region IS NOT NULL AND region <> ''")
        .groupBy("region")
        .agg(*(F.sum(m).alias(m) for m in markers))
    )


def region_area(pixels: DataFrame) -> DataFrame:
    n = F.count("*")
    return pixels.groupBy("region").agg(n.alias("area_px"), area_um2(n).cast("long").alias("area_um"))


def region_table(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """Counts joined with areas; a region on one side only is kept."""
    return areas.join(counts, "region", "full")


def region_density(table: DataFrame, markers) -> DataFrame:
    """Density per region and marker, with the range over regions of each marker."""
    long = table.where("area_px IS NOT NULL").select("region", "area_px", *markers).unpivot(
        ["region", "area_px"], list(markers), "biomarker", "count"
    )
    dens = long.where("count IS NOT NULL").withColumn("density", density(F.col("count"), F.col("area_px")))
    span = dens.groupBy("biomarker").agg(F.min("density").alias("low"), F.max("density").alias("high"))
    return dens.join(span, "biomarker").select("region", "biomarker", "density", "low", "high")


def rule_channels(rules: DataFrame, channel_info: DataFrame) -> DataFrame:
    """Channels of the positive markers of each cell type."""
    pos = rules.where("required = 1").select("type", "biomarker")
    dim = channel_info.select(F.col("Biomarker").alias("biomarker"), F.col("Channel").alias("channel"))
    return pos.join(dim, "biomarker").select("type", "channel")


def channel_mean_image(rules: DataFrame, channel_info: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per cell type, the truncated mean over its positive channels at each pixel."""
    chosen = rule_channels(rules, channel_info)
    n = chosen.groupBy("type").agg(F.countDistinct("channel").alias("_n"))
    # pixels are dealt by place before they are repeated for their types, so the sums meet there; types and channels are few
    return (
        pixels.repartition("y", "x").join(F.broadcast(chosen), "channel")
        .groupBy("type", "y", "x")
        .agg(F.sum("value").alias("_s"))
        .join(F.broadcast(n), "type")
        .select("type", "y", "x", F.floor(F.col("_s") / F.col("_n")).alias("value"))
    )


def positive(marker: str) -> Column:
    return F.col(marker) == 1
