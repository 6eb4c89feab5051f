"""Queries on rasters, masks, un-mixing and registration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import pixels as px

from ..operators import masks, morphology as mo, patches, phenotype as ph, raster as ra, registration as rg, unmix as um
from .boxes import r6
from .evaluation import GT_DET
from .fixtures import MARKERS
from .phenotype import RULES, rule_matrix
from .registry import query

R = ["raster"]
# small boxes over the raster (64 columns, one row per embedding)
BOXES = "zb AS (SELECT y AS ID, (y * 7) % 48 AS xmin, y AS ymin, (y * 7) % 48 + 5 + y % 9 AS xmax, LEAST(y + 4 + y % 6, (SELECT MAX(y) + 1 FROM raster)) AS ymax FROM (SELECT DISTINCT y FROM raster))"
CHANNELS = """ch AS (SELECT 'R1C1.tif' AS channel, y, x, value FROM raster UNION ALL SELECT 'R1C2.tif', y, 63 - x, value FROM raster
UNION ALL SELECT 'R1C3.tif', y, x, value // 2 FROM raster)"""
FG = "fg AS (SELECT y, x FROM raster WHERE value > 1150)"


def zones(t):
    ys = t.embeddings.select(F.col("vec_id").alias("y"))
    top = ys.agg(F.max("y").alias("m")).scalar()
    return ys.select("y", top.alias("top")).selectExpr(
        "y AS ID", "(y * 7) % 48 AS xmin", "y AS ymin", "(y * 7) % 48 + 5 + y % 9 AS xmax", "least(y + 4 + y % 6, top + 1) AS ymax"
    )


def channels(t):
    return (
        t.raster.selectExpr("'R1C1.tif' AS channel", "y", "x", "value")
        .unionByName(t.raster.selectExpr("'R1C2.tif' AS channel", "y", "63 - x AS x", "value"))
        .unionByName(t.raster.selectExpr("'R1C3.tif' AS channel", "y", "x", "value DIV 2 AS value"))
    )


def fg(t):
    return t.raster.where("value > 1150").select("y", "x")


# --------------------------------------------------------------- tiles, painting


@query(
    "tile_grid",
    """WITH im AS (SELECT c_custkey AS image_id, 200 + c_custkey % 300 AS height, 150 + c_custkey % 410 AS width FROM customer),
s AS (SELECT *, UNNEST(RANGE(0, height, 90)) AS row0 FROM im), u AS (SELECT *, UNNEST(RANGE(0, width, 90)) AS col0 FROM s)
SELECT image_id, row0, col0, LEAST(row0 + 100, height) AS row1, LEAST(col0 + 100, width) AS col1, GREATEST(row0 - 30, 0) AS h_row0, LEAST(col0 + 130, width) AS h_col1 FROM u""",
)
def _(t):
    im = t.customer.selectExpr("c_custkey AS image_id", "200 + c_custkey % 300 AS height", "150 + c_custkey % 410 AS width")
    plain = ra.tile_grid(im, 100, 10).select("image_id", "row0", "col0", "row1", "col1")
    halo = ra.tile_grid(im, 100, 10, halo=30).select(
        "image_id", F.col("row0").alias("h_row0"), F.col("col0").alias("h_col0"), F.col("col1").alias("h_col1")
    )
    plain = plain.withColumns({"h_row0": F.greatest(F.col("row0") - 30, F.lit(0)), "h_col0": F.greatest(F.col("col0") - 30, F.lit(0))})
    return plain.join(halo, ["image_id", "h_row0", "h_col0"]).select("image_id", "row0", "col0", "row1", "col1", "h_row0", "h_col1")


@query(
    "filter_empty_tile",
    "SELECT y // 4 * 4 AS tile_y, x // 4 * 4 AS tile_x, MAX(value) AS peak FROM (SELECT y, x, GREATEST(value - 1250, 0) AS value FROM raster) GROUP BY ALL HAVING MAX(value) > 0",
    R,
)
def _(t):
    return ra.non_empty_tiles(t.raster.withColumn("value", F.greatest(F.col("value") - 1250, F.lit(0))), 4)


@query(
    "raster_points",
    """WITH g AS (SELECT c.ID, centroid_y AS y, centroid_x AS x, NeuN >= 0.5 AS n, S100 >= 0.6 AS s FROM cells c JOIN features f ON c.ID = f.ID),
l AS (SELECT 'all' AS class, y, x FROM g UNION ALL SELECT 'NeuN', y, x FROM g WHERE n UNION ALL SELECT 'S100', y, x FROM g WHERE s UNION ALL SELECT 'uncategorized', y, x FROM g WHERE NOT n AND NOT s),
o AS (SELECT dy, dx FROM (SELECT UNNEST(RANGE(-2, 3)) AS dy), (SELECT UNNEST(RANGE(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4)
SELECT class, y + dy AS y, x + dx AS x, COUNT(*) AS n FROM l, o GROUP BY ALL""",
    ["cells", "features"],
)
def _(t):
    marks = ph.gate_with(t.features.select("ID", "NeuN", "S100"), {"NeuN": 0.5, "S100": 0.6})
    return ra.marker_images(t.cells.join(marks, "ID"), ["NeuN", "S100"], 2)


@query(
    "seed_raster",
    """WITH o AS (SELECT dy, dx FROM (SELECT UNNEST(RANGE(-2, 3)) AS dy), (SELECT UNNEST(RANGE(-2, 3)) AS dx))
SELECT slide, centroid_y + dy AS y, centroid_x + dx AS x, MAX(ID) AS label FROM cells, o GROUP BY ALL""",
    ["cells"],
)
def _(t):
    p = t.cells.select("slide", "ID", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))
    return ra.seed_raster(p, 2, on=["slide"]).select("slide", "y", "x", "label")


@query("raster_conform", "SELECT y - 20 AS y, x - 10 AS x, value FROM raster WHERE y >= 20 AND y < 220 AND x >= 10 AND x < 110", R)
def _(t):
    return ra.conform(t.raster, 200, 100, 20, 10).select("y", "x", "value")


@query(
    "raster_sum",
    f"WITH {CHANNELS}, s AS (SELECT y, x, SUM(value) AS v FROM ch WHERE channel <> 'R1C3.tif' GROUP BY y, x) SELECT y, x, ROUND(v / (SELECT MAX(v) FROM s), 6) AS value FROM s",
    R,
)
def _(t):
    ch = channels(t)
    pick = lambda c: ch.where(F.col("channel") == c)
    return r6(ra.raster_sum(pick("R1C1.tif"), pick("R1C2.tif")), "value")


# ------------------------------------------------------------------- statistics


@query(
    "agg_zonal_mean",
    f"WITH {CHANNELS}, {BOXES} SELECT ID, channel, ROUND(AVG(value), 6) AS mean FROM zb JOIN ch ON ch.y >= ymin AND ch.y < ymax AND ch.x >= xmin AND ch.x < xmax GROUP BY ID, channel",
    R,
)
def _(t):
    return r6(ra.zonal_mean(zones(t), channels(t)), "mean")


LABELED = "lab AS (SELECT y, x, 1 + (y // 6) * 11 + x // 6 AS label FROM raster WHERE (y * x) % 5 <> 3)"


def labeled(t):
    return t.raster.where("(y * x) % 5 <> 3").selectExpr("y", "x", "1 + (y DIV 6) * 11 + x DIV 6 AS label")


@query(
    "agg_label_mean",
    f"WITH {CHANNELS}, {LABELED} SELECT label, channel, ROUND(AVG(value), 6) AS mean, CAST(SUM(value) AS BIGINT) AS total FROM lab JOIN ch USING (y, x) GROUP BY label, channel",
    R,
)
def _(t):
    return r6(ra.label_mean(labeled(t), channels(t)), "mean")


@query(
    "agg_region_props",
    f"WITH {LABELED} SELECT label, COUNT(*) AS area, ROUND(AVG(y), 6) AS centroid_y, ROUND(AVG(x), 6) AS centroid_x, MIN(y) AS ymin, MIN(x) AS xmin, MAX(y) AS ymax, MAX(x) AS xmax FROM lab GROUP BY label",
    R,
)
def _(t):
    return r6(ra.region_props(labeled(t)), "centroid_y", "centroid_x")


@query(
    "agg_image_stats",
    f"""WITH {CHANNELS} SELECT channel, MIN(value) AS lowest, MAX(value) AS highest, ROUND(AVG(value), 6) AS mean, ROUND(QUANTILE_CONT(value, 0.0002), 6) AS p0,
ROUND(QUANTILE_CONT(value, 0.998), 6) AS p1, ROUND(QUANTILE_CONT(value, 0.9999999), 6) AS p2 FROM ch GROUP BY channel""",
    R,
)
def _(t):
    return r6(ra.image_stats(channels(t), ["channel"], (0.02, 99.8, 99.99999)), "mean", "p0", "p1", "p2")


_CDF = "h AS (SELECT value, COUNT(*) AS n FROM raster GROUP BY value), c AS (SELECT value, n, SUM(n) OVER (ORDER BY value) / SUM(n) OVER () AS cdf FROM h)"


@query("win_cdf", f"WITH {_CDF} SELECT value, n, FLOOR(cdf * 100000 + 1e-7)::BIGINT AS cdf FROM c", R)
def _(t):
    return ra.cdf(t.raster).withColumn("cdf", F.floor(F.col("cdf") * 100000 + 1e-7))


@query(
    "agg_histogram_cdf",
    f"""WITH {_CDF}, k AS (SELECT MIN(value) FILTER (WHERE cdf > 0.01) AS lo, MIN(value) FILTER (WHERE cdf >= 0.99) AS hi FROM c)
SELECT y, x, CAST(FLOOR((GREATEST(LEAST(value, hi), lo) - lo) * 255.0::DOUBLE / (hi - lo)) AS BIGINT) AS stretched FROM raster, k""",
    R,
)
def _(t):
    return ra.stretch_by_cdf(t.raster).select("y", "x", "stretched")


@query(
    "agg_otsu",
    """WITH h AS (SELECT y // 50 AS crop, value, COUNT(*) AS n FROM raster GROUP BY ALL),
r AS (SELECT crop, value, SUM(n) OVER w AS n0, SUM(n * value) OVER w AS s0, SUM(n) OVER (PARTITION BY crop) AS n, SUM(n * value) OVER (PARTITION BY crop) AS s FROM h WINDOW w AS (PARTITION BY crop ORDER BY value)),
v AS (SELECT crop, value, n0::DOUBLE * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) ** 2 AS var FROM r WHERE n > n0)
SELECT crop, value AS threshold FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY crop ORDER BY ROUND(var, 4) DESC, value) = 1""",
    R,
)
def _(t):
    return ra.otsu(t.raster.withColumn("crop", F.floor(F.col("y") / 50)), ["crop"])


_DIFF = """d AS (SELECT a.y, a.x, CAST(a.value >= 1100 AS INT) AS f, CAST((a.value >= 1100) <> (b.value >= 1080) AS INT) AS df FROM raster a JOIN raster b ON a.y = b.y AND a.x = 63 - b.x),
e AS (SELECT y // 16 * 16 AS tile_y, x // 16 * 16 AS tile_x, SUM(df)::BIGINT AS diff_area, SUM(f)::BIGINT AS foreground FROM d GROUP BY ALL)"""


def difference(t):
    return ra.binary_difference(t.raster, t.raster.withColumn("x", 63 - F.col("x")), 1100, 1080)


@query("agg_tile_error", f"WITH {_DIFF} SELECT *, ROUND(CASE WHEN foreground > 0 THEN diff_area / foreground * 100 END, 6) AS error FROM e", R)
def _(t):
    return r6(ra.tile_error(difference(t), 16), "error")


@query("agg_pixel_mean_std", "SELECT x, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 6) AS std FROM raster GROUP BY x", R)
def _(t):
    return r6(px.pixel_mean_std(t.raster, ["x"]), "mean", "std")


def _info(t):
    return t.channel_info.withColumn("Channel", F.expr("CASE Biomarker WHEN 'NeuN' THEN 'R1C1.tif' WHEN 'S100' THEN 'R1C2.tif' WHEN 'Olig2' THEN 'R1C3.tif' ELSE 'none' END"))


@query(
    "agg_channel_mean_image",
    f"""WITH {CHANNELS}, {RULES}, p AS (SELECT type, 'R1C1.tif' AS channel FROM rules WHERE NeuN = 1 UNION ALL SELECT type, 'R1C2.tif' FROM rules WHERE S100 = 1 UNION ALL SELECT type, 'R1C3.tif' FROM rules WHERE Olig2 = 1)
SELECT type, y, x, (SUM(value) // COUNT(*))::BIGINT AS value FROM ch JOIN p USING (channel) GROUP BY type, y, x""",
    R,
)
def _(t):
    info = _info(t).where("Channel <> 'none'")
    return ph.channel_mean_image(ph.rules_to_long(rule_matrix(t)), info, channels(t))


@query("agg_line_fit", f"WITH {LABELED} SELECT label, ROUND(REGR_SLOPE(y, x), 6) AS slope, ROUND(REGR_INTERCEPT(y, x), 4) AS intercept FROM lab GROUP BY label", R)
def _(t):
    return ra.line_fit(labeled(t)).select("label", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


# -------------------------------------------------------------------- morphology

_COMPONENTS = """reach(sy, sx, y, x) AS (SELECT y, x, y, x FROM fg UNION SELECT r.sy, r.sx, f.y, f.x FROM reach r JOIN fg f ON ABS(f.y - r.y) <= 1 AND ABS(f.x - r.x) <= 1),
comp AS (SELECT y, x, MIN(sy * 4294967296 + sx) AS label FROM reach GROUP BY y, x)"""


@query("connected_components", f"WITH RECURSIVE {FG}, {_COMPONENTS} SELECT y, x, label FROM comp", R)
def components(t):
    return mo.label(fg(t))


@query("filter_label_area", f"WITH {LABELED} SELECT y, x, label FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING COUNT(*) BETWEEN 25 AND 30)", R)
def _(t):
    return mo.area_filter(labeled(t), 25, 30).select("y", "x", "label")


_CROPS = f"{LABELED}, cr AS (SELECT y // 20 AS crop, y % 20 AS y, x, 1 + (y % 20 // 6) * 11 + x // 6 AS label FROM lab)"


def crops(t):
    return labeled(t).selectExpr("y DIV 20 AS crop", "y % 20 AS y", "x", "1 + (y % 20 DIV 6) * 11 + x DIV 6 AS label")


@query(
    "clear_border_labels",
    f"""WITH {_CROPS}, i AS (SELECT crop, label, MAX(CAST(y < 3 OR x < 3 OR y >= 17 OR x >= 61 OR crop % 4 = 0 AS INT)) AS cut, COUNT(*) AS area FROM cr GROUP BY ALL),
k AS (SELECT crop, label FROM i WHERE cut = 0 UNION ALL SELECT crop, label FROM i WHERE crop IN (SELECT crop FROM i GROUP BY crop HAVING MIN(cut) = 1) QUALIFY ROW_NUMBER() OVER (PARTITION BY crop ORDER BY area DESC, label) = 1)
SELECT crop, y, x, label FROM cr SEMI JOIN k USING (crop, label)""",
    R,
)
def _(t):
    # every fourth crop is moved onto the border, so that all of its labels would go
    c = crops(t)
    moved = c.withColumn("y", F.when(F.col("crop") % 4 == 0, F.col("y") - 100).otherwise(F.col("y")))
    out = mo.clear_border(moved, 20, 64, 3, ["crop"])
    return out.withColumn("y", F.when(F.col("crop") % 4 == 0, F.col("y") + 100).otherwise(F.col("y"))).select("crop", "y", "x", "label")


@query(
    "pick_center_component",
    f"""WITH {_CROPS}, i AS (SELECT crop, label, (AVG(y) - 10) ** 2 + (AVG(x) - 32) ** 2 AS d, COUNT(*) AS area FROM cr GROUP BY ALL),
k AS (SELECT crop, label FROM i QUALIFY ROW_NUMBER() OVER (PARTITION BY crop ORDER BY d, area DESC, label) = 1) SELECT crop, y, x, label FROM cr SEMI JOIN k USING (crop, label)""",
    R,
)
def _(t):
    return mo.pick_center(crops(t), 10, 32).select("crop", "y", "x", "label")


_DISC1 = "o AS (SELECT dy, dx FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx))"


@query(
    "mask_dilate_erode",
    f"""WITH {FG}, {_DISC1}, d AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM fg, o), c AS (SELECT y + dy AS y, x + dx AS x FROM d, o GROUP BY ALL HAVING COUNT(*) = 5)
SELECT 'dilated' AS op, y, x FROM d UNION ALL SELECT 'closed', y, x FROM c""",
    R,
)
def _(t):
    tag = lambda df, n: df.select(F.lit(n).alias("op"), "y", "x")
    return tag(mo.dilate(fg(t), 1), "dilated").unionByName(tag(mo.close(fg(t), 1), "closed"))


@query(
    "mask_smooth",
    """WITH m AS (SELECT y, x FROM raster WHERE value > 990), o AS (SELECT UNNEST(RANGE(-5, 6)) AS d) SELECT m.y + a.d AS y, m.x + b.d AS x FROM m, o a, o b GROUP BY ALL HAVING COUNT(*) > 60.5""",
    R,
)
def _(t):
    return mo.smooth(t.raster.where("value > 990"))


@query(
    "cell_compartments",
    f"""WITH n AS (SELECT DISTINCT ID AS cell, centroid_y + j AS y, centroid_x + i AS x FROM cells, (SELECT UNNEST(RANGE(-2, 3)) AS j), (SELECT UNNEST(RANGE(-1, 2)) AS i)),
{_DISC1}, o2 AS (SELECT dy, dx FROM (SELECT UNNEST(RANGE(-2, 3)) AS dy), (SELECT UNNEST(RANGE(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4),
g AS (SELECT DISTINCT cell, y + dy AS y, x + dx AS x FROM n, o2), w AS (SELECT DISTINCT cell, y + dy AS y, x + dx AS x FROM g, o),
p AS (SELECT 'soma' AS part, * FROM (SELECT * FROM g EXCEPT SELECT * FROM n) UNION ALL SELECT 'membrane', * FROM (SELECT * FROM w EXCEPT SELECT * FROM g)
UNION ALL SELECT 'whole_cell', * FROM w UNION ALL SELECT 'cytoplasm', * FROM (SELECT * FROM g EXCEPT SELECT * FROM n))
SELECT cell, part, COUNT(*) AS n, CAST(SUM(y * 31 + x) AS BIGINT) AS checksum FROM p GROUP BY cell, part""",
    ["cells"],
)
def _(t):
    j, i = F.explode(F.sequence(F.lit(-2), F.lit(2))), F.explode(F.sequence(F.lit(-1), F.lit(1)))
    n = t.cells.select(F.col("ID").alias("cell"), "centroid_y", "centroid_x", j.alias("j")).select("*", i.alias("i"))
    parts = mo.compartments(n.selectExpr("cell", "centroid_y + j AS y", "centroid_x + i AS x"))
    return parts.groupBy("cell", "part").agg(F.count("*").alias("n"), F.sum(F.col("y") * 31 + F.col("x")).alias("checksum"))


@query(
    "intersect_pixels",
    f"""WITH {LABELED}, a AS (SELECT DISTINCT label FROM lab JOIN raster USING (y, x) WHERE value > 1200), b AS (SELECT DISTINCT label FROM lab JOIN raster USING (y, x) WHERE value < 800)
SELECT y, x, label FROM lab WHERE label IN (SELECT label FROM a) AND label IN (SELECT label FROM b)""",
    R,
)
def _(t):
    return mo.meeting_both(labeled(t), t.raster.where("value > 1200"), t.raster.where("value < 800")).select("y", "x", "label")


@query(
    "join_points_in_mask",
    f"WITH {FG}, p AS (SELECT ID, (ID * 37 % 5000) / 10.0::DOUBLE AS y, (ID * 53 % 640) / 10.0::DOUBLE AS x FROM cells) SELECT ID FROM p WHERE EXISTS (SELECT 1 FROM fg WHERE fg.y = FLOOR(p.y) AND fg.x = FLOOR(p.x))",
    ["raster", "cells"],
)
def _(t):
    p = t.cells.selectExpr("ID", "(ID * 37 % 5000) / 10.0D AS y", "(ID * 53 % 640) / 10.0D AS x")
    return masks.points_in_mask(p, fg(t)).select("ID")


@query(
    "grow_from_seeds",
    """WITH RECURSIVE op AS (SELECT y, x, value FROM raster WHERE value >= 1010), reach(y, x) AS (SELECT y, x FROM op WHERE value > 1280
UNION SELECT o.y, o.x FROM reach r JOIN op o ON (o.y = r.y AND ABS(o.x - r.x) = 1) OR (o.x = r.x AND ABS(o.y - r.y) = 1)) SELECT y, x FROM reach""",
    R,
)
def _(t):
    return mo.grow_from_seeds(t.raster.selectExpr("y", "x", "CASE WHEN value < 1010 THEN -1 WHEN value > 1280 THEN 1 ELSE 0 END AS state"))


_BACK = """o AS (SELECT dy, dx FROM (SELECT UNNEST(RANGE(-2, 3)) AS dy), (SELECT UNNEST(RANGE(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4),
lo AS (SELECT a.y, a.x, MIN(b.value) AS v FROM raster a, o JOIN raster b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x),
hi AS (SELECT a.y, a.x, MAX(b.v) AS v FROM raster a, o JOIN lo b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x)"""


@query("background_open", f"WITH {_BACK} SELECT r.y, r.x, GREATEST(r.value - hi.v, 0) AS value FROM raster r JOIN hi USING (y, x)", R)
def _(t):
    rows = t.embeddings.agg((F.max("vec_id") + 1).alias("n")).first()["n"]
    one = t.raster.withColumn("channel", F.lit(1))
    return mo.subtract_background(one, rows, 64, (4,), block=48).select("y", "x", "value")


@query(
    "merge_tiles",
    """WITH RECURSIVE t AS (SELECT slide, ID, centroid_y // 100 * 100 AS row0, centroid_x // 100 * 100 AS col0,
  centroid_y // 100 * 100 + 40 AS row1, centroid_x // 100 * 100 + CASE WHEN (centroid_y // 100 + centroid_x // 100) % 3 = 0 THEN 100 ELSE 40 END AS col1 FROM cells),
g AS (SELECT MIN(ID) AS id, COUNT(*) AS n, slide, row0, col0, row1, col1 FROM t GROUP BY ALL),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.slide = b.slide AND a.id <> b.id AND a.col0 <= b.col1 AND b.col0 <= a.col1 AND a.row0 <= b.row1 AND b.row0 <= a.row1),
r AS (SELECT id, id AS c FROM g UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
l AS (SELECT id, MIN(c) AS w FROM r GROUP BY id),
m AS (SELECT w, MIN(row0) AS row0, MIN(col0) AS col0, MAX(row1) AS row1, MAX(col1) AS col1, ANY_VALUE(slide) AS slide, SUM(n)::BIGINT AS tiles FROM g JOIN l USING (id) GROUP BY w)
SELECT slide, w AS "window", GREATEST(row0 - p, 0) AS row0, GREATEST(col0 - p, 0) AS col0, row1 + p AS row1, col1 + p AS col1, tiles FROM (SELECT *, CASE WHEN tiles > 1 THEN 20 ELSE 0 END AS p FROM m)""",
    ["cells"],
)
def _(t):
    # every cell stands in a tile of its slide; tiles of 40 pixels on a grid of 100 touch only their copies
    at = "centroid_y DIV 100 * 100", "centroid_x DIV 100 * 100"
    wide = "if((centroid_y DIV 100 + centroid_x DIV 100) % 3 = 0, 100, 40)"
    grid = t.cells.selectExpr(
        "slide", "ID AS tile_id", f"{at[0]} AS row0", f"{at[1]} AS col0", f"{at[0]} + 40 AS row1", f"{at[1]} + {wide} AS col1"
    )
    return mo.merge_tiles(grid, 20, ["slide"])


@query("extract_patches")
def _(t):
    rows = t.embeddings.agg((F.max("vec_id") + 1).alias("n")).first()["n"]
    out = patches.extract(zones(t), channels(t), rows, 64, margin=2, size=20)
    return out.select("ID", "channel", F.transform("patch", lambda v: F.round(v, 4)).alias("patch"))


@query(
    "auto_label_cells",
    f"""WITH {CHANNELS}, {BOXES}, z AS (SELECT ID, channel, AVG(value) AS m FROM zb JOIN ch ON ch.y >= ymin AND ch.y < ymax AND ch.x >= xmin AND ch.x < xmax WHERE channel <> 'R1C3.tif' GROUP BY ID, channel)
SELECT ID, channel AS label FROM z QUALIFY ROW_NUMBER() OVER (PARTITION BY ID ORDER BY m DESC, channel) = 1""",
    R,
)
def _(t):
    z = ra.zonal_mean(zones(t), channels(t)).select("ID", F.col("channel").alias("biomarker"), F.col("mean").alias("value"))
    return ph.auto_label(z, exclude=("R1C3.tif",)).select("ID", F.col("biomarker").alias("label"))


# --------------------------------------------------------------------- un-mixing


@query(
    "agg_gram",
    f"""WITH {CHANNELS}, w AS (SELECT y, x, MAX(value) FILTER (WHERE channel = 'R1C1.tif') AS a, MAX(value) FILTER (WHERE channel = 'R1C2.tif') AS b FROM ch GROUP BY y, x)
SELECT COUNT(*) AS n, SUM(a)::DOUBLE AS m_0, SUM(b)::DOUBLE AS m_1, SUM(a * a)::DOUBLE AS g_0_0, SUM(a * b)::DOUBLE AS g_0_1, SUM(b * b)::DOUBLE AS g_1_1 FROM w""",
    R,
)
def _(t):
    return um.gram(channels(t), ["R1C1.tif", "R1C2.tif"])


PAIRS = [("R1C1.tif", "R1C2.tif"), ("R1C1.tif", "R1C3.tif"), ("R1C3.tif", "R1C2.tif")]
_PAIR_SQL = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") v(target, channel))"
_CLOSED = f"""{CHANNELS}, {_PAIR_SQL}, wt AS (SELECT pr.target, pr.channel, GREATEST(LEAST(SUM(s.value * n.value) / SUM(n.value * n.value), 1), 0) AS weight FROM pr
JOIN ch s ON s.channel = pr.target JOIN ch n ON n.channel = pr.channel AND n.y = s.y AND n.x = s.x GROUP BY ALL)"""
def _weights(t):
    pairs = t.region.where("r_regionkey < 3").selectExpr(
        "element_at(array('R1C1.tif', 'R1C1.tif', 'R1C3.tif'), CAST(r_regionkey AS INT) + 1) AS target",
        "element_at(array('R1C2.tif', 'R1C3.tif', 'R1C2.tif'), CAST(r_regionkey AS INT) + 1) AS channel",
    )
    return um.fit_closed(channels(t), pairs)


@query("fit_unmix_closed", f"WITH {_CLOSED} SELECT target, channel, ROUND(weight, 6) AS weight FROM wt", R)
def _(t):
    return r6(_weights(t), "weight")


@query("fit_unmix_lasso")
def _(t):
    names = ["R1C1.tif", "R1C2.tif", "R1C3.tif"]
    return um.fit_lasso(channels(t), names, alpha=1e-4, scale=1000.0)


@query(
    "apply_unmix",
    f"""WITH {_CLOSED}, hw AS (SELECT target, channel, ROUND(weight, 3) / 4 AS w FROM wt), k AS (SELECT DISTINCT channel AS target, channel, 1.0::DOUBLE AS c FROM ch UNION ALL SELECT target, channel, -w FROM hw)
SELECT k.target AS channel, y, x, CAST(GREATEST(ROUND_EVEN(ROUND(SUM(value * c), 6), 0), 0) AS BIGINT) AS value FROM ch JOIN k USING (channel) GROUP BY k.target, y, x""",
    R,
)
def _(t):
    quarter = _weights(t).withColumn("weight", F.round("weight", 3) / 4)
    return um.apply(channels(t), quarter)


@query(
    "top3_noise_channels",
    """WITH w AS (SELECT n_name AS target, r_name AS channel, ((n_nationkey * 7 + r_regionkey * 3) % 6 - 2) / 10.0::DOUBLE AS weight FROM nation, region),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY weight DESC, channel DESC) AS rk FROM w WHERE weight > 0)
SELECT n.n_name AS target, MAX(channel) FILTER (WHERE rk = 1) AS "channel 1", MAX(channel) FILTER (WHERE rk = 2) AS "channel 2", MAX(channel) FILTER (WHERE rk = 3) AS "channel 3" FROM nation n LEFT JOIN k ON k.target = n.n_name GROUP BY n.n_name""",
)
def _(t):
    names = F.explode(F.expr("array('AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST')")).alias("r_name")
    w = t.nation.select("n_nationkey", F.col("n_name").alias("target"), names).join(t.region.select("r_name", "r_regionkey"), "r_name").selectExpr(
        "target", "r_name AS channel", "((n_nationkey * 7 + r_regionkey * 3) % 6 - 2) / 10.0D AS weight"
    )
    return um.noise_columns(w)


# ------------------------------------------------------------------ registration

_DESC = """e AS (SELECT vec_id AS kp_id, vec_id // 20 AS tile, vec_id % 2 AS side, embedding FROM embeddings),
hm AS (SELECT a.tile, a.kp_id AS l, b.kp_id AS r, LEN(LIST_FILTER(LIST_ZIP(a.embedding, b.embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS d FROM e a JOIN e b ON a.tile = b.tile WHERE a.side = 0 AND b.side = 1),
fw AS (SELECT * FROM hm QUALIFY ROW_NUMBER() OVER (PARTITION BY l ORDER BY d, r) = 1), bw AS (SELECT * FROM hm QUALIFY ROW_NUMBER() OVER (PARTITION BY r ORDER BY d, l) = 1),
mu AS (SELECT fw.tile, fw.l AS left_id, fw.r AS right_id, fw.d AS dist FROM fw JOIN bw ON fw.l = bw.l AND fw.r = bw.r)"""


def keypoints(t):
    word = lambda lo: F.aggregate(
        F.sequence(F.lit(lo), F.lit(lo + 31)), F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(F.col("embedding")[i] > 0, F.expr("1L") * F.pow(F.lit(2), i - lo).cast("long")).otherwise(F.lit(0)).cast("long"),
    )
    return t.embeddings.select(
        F.col("vec_id").alias("kp_id"), F.floor(F.col("vec_id") / 20).alias("tile"), (F.col("vec_id") % 2).alias("side"),
        F.array(word(0), word(32)).alias("descriptor"),
    )


@query(
    "join_mutual_descriptor",
    f"""WITH {_DESC} SELECT tile, left_id, right_id, dist FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tile ORDER BY dist, left_id) AS rn, COUNT(*) OVER (PARTITION BY tile) AS n FROM mu)
WHERE rn <= GREATEST(1, CAST(FLOOR(n * 0.5) AS BIGINT))""",
)
def _(t):
    k = keypoints(t)
    out = rg.mutual_matches(k.where("side = 0"), k.where("side = 1"), 2, ["tile"], keep=0.5)
    return out.select("tile", "left_id", "right_id", F.col("dist").cast("long").alias("dist"))


_WARP = [[1.01, 0.02, 12.0], [-0.015, 0.99, -7.0], [0.0, 0.0, 1.0]]


@query("warp_points", "SELECT ID, ROUND(centroid_x * 1.01::DOUBLE + centroid_y * 0.02::DOUBLE + 12, 6) AS x, ROUND(centroid_x * -0.015::DOUBLE + centroid_y * 0.99::DOUBLE - 7, 6) AS y FROM cells", ["cells"])
def _(t):
    p = t.cells.select("ID", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return r6(rg.warp_points(p, _WARP), "x", "y")


def matches(t):
    """Cell centres and their warped positions; every fifth pair is wrong."""
    wx, wy = rg.warp(F.col("centroid_x"), F.col("centroid_y"), _WARP)
    bad = F.col("ID") % 5 == 0
    return t.cells.select(
        F.col("ID").alias("match_id"), (F.floor(F.col("centroid_y") / 500) * 100 + F.floor(F.col("centroid_x") / 500)).alias("tile"),
        F.col("centroid_x").cast("double").alias("src_x"), F.col("centroid_y").cast("double").alias("src_y"),
        (wx + F.when(bad, F.col("ID") % 313 + 20).otherwise(F.col("ID") % 3 - 1)).cast("double").alias("dst_x"),
        (wy - F.when(bad, F.col("ID") % 211 + 20).otherwise(F.col("ID") % 3 - 1)).cast("double").alias("dst_y"),
    )


@query("fit_transform_ransac")
def _(t):
    m = matches(t)
    fit = rg.fit_ransac(m, "affine", 3, 5.0, max_trials=100, wave=25)
    return r6(rg.with_residual(m, fit["matrix"]).select("match_id", "tile", "residual"), "residual")


@query("fit_transform_ransac_grid")
def _(t):
    """Every configuration of the search, with where its transform puts the corners of a 1000 x 1000 field."""
    rows = []
    for r in rg.search_ransac(matches(t), max_trials=25):
        m = np.asarray(r["matrix"])
        corner = (m @ [1000.0, 1000.0, 1.0])[:2] / (m @ [1000.0, 1000.0, 1.0])[2]
        rows.append((r["min_samples"], r["threshold"], r["objective"], int(r["inlier_num"]), float(r["inlier_tile"]), *map(float, m[:2, 2] / m[2, 2]), *map(float, corner)))
    names = ["inlier_tile", "x0", "y0", "x1000", "y1000"]
    out = t.spark.createDataFrame(rows, "min_samples long, threshold double, objective string, inlier_num long, " + ", ".join(f"{n} double" for n in names))
    return r6(out, *names)


@query("local_refit")
def _(t):
    blocks = ph.region_pixels(t.regions).selectExpr("list_order + 1 AS label", "y", "x")
    pts = t.cells.select("ID", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    m = matches(t)
    fit = rg.fit_ransac(m, "affine", 3, 5.0, max_trials=50, wave=25)
    return r6(rg.local_refit(pts, m, fit["matrix"], blocks).select("ID", "local", "wx", "wy"), "wx", "wy")


@query(
    "flag_misaligned_tiles",
    f"""WITH {_DIFF}, m AS (SELECT y // 16 * 16 AS tile_y, x // 16 * 16 AS tile_x, SUM(value)::BIGINT AS total, COUNT(*) AS pixels FROM raster GROUP BY ALL),
i AS (SELECT tile_y, tile_x, (tile_y // 16 * 7 + tile_x // 16 * 3) % 10 / 10.0::DOUBLE AS inlier_rate FROM m)
SELECT tile_y, tile_x, ROUND(diff_area / foreground * 100, 6) AS error FROM m JOIN e USING (tile_y, tile_x) JOIN i USING (tile_y, tile_x)
WHERE total / pixels > (SELECT AVG(value) FROM raster) / 4 AND foreground > 0 AND diff_area / foreground * 100 > 1.2 AND inlier_rate < 0.4 AND diff_area > 4""",
    R,
)
def _(t):
    m = ra.with_tile(t.raster, 16).groupBy("tile_y", "tile_x").agg(F.sum("value").alias("total"), F.count("*").alias("pixels"))
    rates = m.select("tile_y", "tile_x", ((F.floor(F.col("tile_y") / 16) * 7 + F.floor(F.col("tile_x") / 16) * 3) % 10 / 10.0).alias("inlier_rate"))
    return r6(rg.flag_misaligned(m, ra.tile_error(difference(t), 16), rates, 16).select("tile_y", "tile_x", "error"), "error")


FILES = "files AS (SELECT 'S' || CAST(c_custkey // 20 AS VARCHAR) || '_R' || CAST(c_custkey % 20 // 5 + 1 AS VARCHAR) || 'C' || CAST(c_custkey % 5 + 1 AS VARCHAR) || '.tif' AS filename FROM customer)"


def files(t):
    return t.customer.selectExpr("concat('S', c_custkey DIV 20, '_R', c_custkey % 20 DIV 5 + 1, 'C', c_custkey % 5 + 1, '.tif') AS filename")


_PARSED = f"""{FILES}, pf AS (SELECT DISTINCT filename, CAST(REGEXP_EXTRACT(filename, 'R(\\d+)C', 1) AS INT) AS round, CAST(REGEXP_EXTRACT(filename, 'C(\\d+)', 1) AS INT) AS channel, REGEXP_EXTRACT(filename, '^(S[^_]*_)', 1) AS prefix FROM files)"""


@query(
    "registration_plan",
    f"WITH {_PARSED} SELECT a.prefix, a.round, a.channel, a.filename AS source_file, b.filename AS target_file FROM pf a LEFT JOIN pf b ON a.prefix = b.prefix AND a.channel = b.channel AND b.round = 2 WHERE a.round <> 2",
)
def _(t):
    return rg.registration_plan(files(t), 2)


@query(
    "make_channel_script",
    f"""WITH {_PARSED} SELECT filename, CASE WHEN channel = 5 THEN 'brightfield' END AS biomarker, CASE WHEN channel = 5 THEN 'No' ELSE 'Yes' END AS correction, 1200::BIGINT AS xmin, 3700::BIGINT AS ymax FROM pf""",
)
def _(t):
    s = rg.make_channel_script(files(t), (1200, 700, 5200, 3700), 5)
    return s.select("filename", "biomarker", F.col("intra channel correction").alias("correction"), F.col("xmin").cast("long").alias("xmin"), F.col("ymax").cast("long").alias("ymax"))


@query(
    "join_channel_mask_manifest",
    """WITH im AS (SELECT p_partkey // 20 AS data_set, p_partkey AS image_id, p_brand AS biomarker FROM part), mk AS (SELECT s_suppkey AS data_set, s_suppkey AS mask_id, 'Brand#' || CAST(s_suppkey % 5 + 1 AS VARCHAR) || CAST(s_suppkey % 4 + 1 AS VARCHAR) AS biomarker, s_suppkey % 2 = 0 AS seed, 'soma' AS part FROM supplier)
SELECT image_id, mask_id, im.biomarker AS description FROM im JOIN mk USING (data_set) WHERE seed UNION ALL SELECT image_id, mask_id, biomarker || ' with ' || part FROM im JOIN mk USING (data_set, biomarker) WHERE NOT seed""",
)
def _(t):
    im = t.part.selectExpr("p_partkey DIV 20 AS data_set", "p_partkey AS image_id", "p_brand AS biomarker")
    mk = t.supplier.selectExpr(
        "s_suppkey AS data_set", "s_suppkey AS mask_id", "concat('Brand#', s_suppkey % 5 + 1, s_suppkey % 4 + 1) AS biomarker",
        "s_suppkey % 2 = 0 AS is_seed", "'soma' AS part",
    )
    return rg.mask_manifest(im, mk)
