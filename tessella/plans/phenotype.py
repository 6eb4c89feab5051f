"""Queries on phenotyping, regions and point joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes as ob, nearest as nn, overlap as ov, phenotype as ph
from ..runtime import many, stage
from .fixtures import MARKERS
from .registry import query
from .evaluation import GT_DET, SMALL, sql_area, sql_inter

GATES = [("NeuN", 0.5), ("S100", 0.6), ("Olig2", 0.7), ("Iba1", 0.8)]
GATED = "gated AS (SELECT ID, " + ", ".join(f"CAST({m} >= {g} AS INT) AS {m}" for m, g in GATES) + ", CAST(RECA1 >= 0.4 AS INT) AS RECA1 FROM features)"


def gated(t):
    return ph.gate_with(t.features, {**dict(GATES), "RECA1": 0.4})


# Rules derived from the nation table: every nation is a cell type whose tokens
# follow from its key.
RULES = "rules AS (SELECT n_nationkey AS rule_order, n_name AS type, " + ", ".join(
    f"CASE (n_nationkey * {k} + {i}) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS {m}" for i, (m, k) in enumerate(zip(MARKERS, (1, 2, 4, 5, 7)))
) + " FROM nation)"


def rule_matrix(t):
    tok = lambda i, k: F.expr(f"CASE (n_nationkey * {k} + {i}) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '+-' END")
    return t.nation.select(
        F.col("n_nationkey").alias("rule_order"), F.col("n_name").alias("Type"),
        *(tok(i, k).alias(m) for i, (m, k) in enumerate(zip(MARKERS, (1, 2, 4, 5, 7)))),
    )


MATCH = " AND ".join(f"(r.{m} IS NULL OR r.{m} = g.{m})" for m in MARKERS)
TYPED = f"typed AS (SELECT g.ID, ARG_MAX(r.type, r.rule_order) AS cell_type FROM gated g LEFT JOIN rules r ON {MATCH} GROUP BY g.ID)"


@query(
    "join_align_tables",
    "SELECT 0::BIGINT AS only_features, 0::BIGINT AS only_boxes, (SELECT COUNT(*) FROM orders WHERE (o_orderkey + 1) % 97 = 0) AS different",
)
def _(t):
    moved = t.cells.withColumn("centroid_x", F.when(F.col("ID") % 97 == 0, F.col("centroid_x") + 1).otherwise(F.col("centroid_x")))
    return ph.mismatches(t.cells, moved)


@query(
    "join_threshold_gate",
    "SELECT ID, " + ", ".join(f"CAST({m} >= {g} AS BIGINT) AS {m}" for m, g in GATES) + " FROM features",
    ["features"],
)
def _(t):
    names = [m for m, _ in GATES]
    wide = ph.gate_wide(t.features, t.channel_info, names)
    return wide.select("ID", *(F.col(m).cast("long").alias(m) for m in names))


@query("join_cell_type_rules", f"WITH {GATED}, {RULES}, {TYPED} SELECT ID, cell_type FROM typed", ["features"])
def cell_types(t):
    return ph.assign_types_wide(gated(t), ph.rules_to_long(rule_matrix(t)))


MAJOR = {"ARGENTINA": "NeuN", "BRAZIL": "Iba1", "CANADA": "S100", "EGYPT": "Olig2", "ETHIOPIA": "RECA1"}
_OWNER = "CASE " + " ".join(f"WHEN POSITION('{n}' IN name) > 0 THEN '{m}'" for n, m in MAJOR.items()) + " END"
_LONG = "pos AS (" + " UNION ALL ".join(f"SELECT ID, '{m}' AS biomarker FROM gated WHERE {m} = 1" for m in MARKERS) + ")"


@query(
    "join_major_function",
    f"""WITH {GATED}, {_LONG}, mr AS (SELECT n_nationkey AS rule_order, CASE WHEN n_nationkey < 5 THEN n_name ELSE (ARRAY['ARGENTINA','BRAZIL','CANADA','EGYPT','ETHIOPIA'])[n_nationkey % 5 + 1] || ' sub ' || n_name END AS name,
 (ARRAY['NeuN','Iba1','S100','Olig2','RECA1'])[(n_nationkey * 3 + CASE WHEN n_nationkey < 5 THEN 0 ELSE 1 END) % 5 + 1] AS biomarker FROM nation),
r AS (SELECT *, name IN ('ARGENTINA','BRAZIL','CANADA','EGYPT','ETHIOPIA') AS is_major, {_OWNER} AS owner FROM mr),
fn AS (SELECT p.ID, ARG_MAX(r.name, r.rule_order) AS function, MIN(r.rule_order) AS first FROM pos p JOIN r ON p.biomarker = r.biomarker JOIN pos q ON q.ID = p.ID AND q.biomarker = r.owner WHERE NOT is_major GROUP BY p.ID),
ty AS (SELECT p.ID, ARG_MAX(r.name, r.rule_order) AS type FROM pos p JOIN r ON p.biomarker = r.biomarker LEFT JOIN fn ON fn.ID = p.ID WHERE is_major AND (fn.first IS NULL OR r.rule_order < fn.first) GROUP BY p.ID)
SELECT g.ID, type, function FROM gated g LEFT JOIN ty ON ty.ID = g.ID LEFT JOIN fn ON fn.ID = g.ID""",
    ["features"],
)
def _(t):
    names = ",".join(f"'{n}'" for n in MAJOR)
    rules = t.nation.select(
        F.col("n_nationkey").alias("rule_order"),
        F.expr(f"CASE WHEN n_nationkey < 5 THEN n_name ELSE concat(array({names})[n_nationkey % 5], ' sub ', n_name) END").alias("Cell Type"),
        F.expr(
            "array('NeuN','Iba1','S100','Olig2','RECA1')[(n_nationkey * 3 + CASE WHEN n_nationkey < 5 THEN 0 ELSE 1 END) % 5]"
        ).alias("Biomarker"),
    )
    return ph.major_function(gated(t), rules, MAJOR)


@query(
    "win_argmax_class",
    """WITH l AS (UNPIVOT (SELECT ID, NeuN, S100, Olig2, Iba1, RECA1 FROM features) ON NeuN, S100, Olig2, Iba1, RECA1 INTO NAME biomarker VALUE value)
SELECT ID, MIN(biomarker) AS biomarker, COUNT(*) AS ties FROM (SELECT ID, biomarker, RANK() OVER (PARTITION BY ID ORDER BY FLOOR(value * 20) DESC) AS rk FROM l) WHERE rk = 1 GROUP BY ID""",
    ["features"],
)
def _(t):
    coarse = t.features.withColumns({m: F.floor(F.col(m) * 20) for m in MARKERS})
    out = ph.argmax_wide(coarse, sorted(MARKERS))
    return out.select("ID", "biomarker", F.size("tied").cast("long").alias("ties"))


@query(
    "gate_probabilities",
    "WITH p AS (SELECT *, GREATEST(NeuN, S100, Olig2) AS best FROM features), f AS (SELECT *, CASE WHEN best < 0.75 THEN -1 WHEN NeuN = best THEN 0 WHEN S100 = best THEN 1 ELSE 2 END AS k FROM p) "
    "SELECT ID, CAST(k = 0 AS BIGINT) AS NeuN, CAST(k = 1 AS BIGINT) AS S100, CAST(k = 2 AS BIGINT) AS Olig2 FROM f",
    ["features"],
)
def _(t):
    classes = ["NeuN", "S100", "Olig2"]
    out = ph.gate_probabilities(t.features.select("ID", *classes), classes, 0.75)
    return out.select("ID", *(F.col(c).cast("long").alias(c) for c in classes))


@query(
    "topn_per_channel",
    """WITH l AS (UNPIVOT (SELECT ID, NeuN, S100, Olig2, Iba1, RECA1 FROM features) ON NeuN, S100, Olig2, Iba1, RECA1 INTO NAME biomarker VALUE value)
SELECT DISTINCT ID FROM l QUALIFY ROW_NUMBER() OVER (PARTITION BY biomarker ORDER BY value DESC, ID) <= 200""",
    ["features"],
)
def _(t):
    return ph.top_n_per_channel(ph.to_long(t.features), 200)


@query(
    "agg_cell_type_summary",
    f"""WITH {GATED}, {RULES}, {TYPED} SELECT COALESCE(cell_type, 'uncategorized') AS cell_type, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM typed), 6) AS share
FROM typed GROUP BY 1""",
    ["features"],
)
def _(t):
    return ph.type_summary(cell_types(t)).withColumn("share", F.round("share", 6))


# --------------------------------------------------------------------- regions

LOCATED = """located AS (SELECT c.ID, c.slide, c.centroid_x, c.centroid_y, ARG_MAX(r.region, r.list_order) AS region FROM cells c
LEFT JOIN regions r ON c.centroid_x BETWEEN r.x0 AND r.x1 AND c.centroid_y BETWEEN r.y0 AND r.y1 GROUP BY ALL)"""


def located(t):
    return ph.point_in_region(t.cells, ph.region_pixels(t.regions))


@query("join_point_in_region", f"WITH {LOCATED} SELECT ID, region FROM located", ["cells", "regions"])
def _(t):
    return located(t).select("ID", "region")


_COUNTED = f"""{LOCATED}, {GATED}, counts AS (SELECT region, SUM(NeuN)::BIGINT AS NeuN, SUM(S100)::BIGINT AS S100, SUM(Olig2)::BIGINT AS Olig2, SUM(Iba1)::BIGINT AS Iba1, SUM(RECA1)::BIGINT AS RECA1
 FROM located JOIN gated USING (ID) WHERE region IS NOT NULL GROUP BY region),
areas AS (SELECT region, (x1 - x0 + 1) * (y1 - y0 + 1) AS area_px, CAST(TRUNC((x1 - x0 + 1) * (y1 - y0 + 1) * 0.105625) AS BIGINT) AS area_um FROM regions)"""


def counted(t):
    return ph.region_counts(located(t).select("ID", "region").join(gated(t), "ID"), MARKERS)


@query("agg_region_counts", f"WITH {_COUNTED} SELECT * FROM counts", ["cells", "regions", "features"])
def _(t):
    return counted(t)


@query("agg_region_area", f"WITH {_COUNTED} SELECT * FROM areas", ["cells", "regions", "features"])
def _(t):
    return ph.region_area(ph.region_pixels(t.regions))


@query("join_region_area", f"WITH {_COUNTED} SELECT region, area_px, area_um, NeuN, Iba1 FROM areas FULL JOIN counts USING (region)", ["cells", "regions", "features"])
def _(t):
    return ph.region_table(counted(t), ph.region_area(ph.region_pixels(t.regions))).select("region", "area_px", "area_um", "NeuN", "Iba1")


@query(
    "agg_region_density",
    f"""WITH {_COUNTED}, l AS (UNPIVOT (SELECT region, area_px, NeuN, Iba1 FROM areas JOIN counts USING (region)) ON NeuN, Iba1 INTO NAME biomarker VALUE n),
d AS (SELECT region, biomarker, n * 1e6 / (area_px * 0.105625) AS density FROM l)
SELECT region, biomarker, ROUND(density, 4) AS density, ROUND(MIN(density) OVER (PARTITION BY biomarker), 4) AS low, ROUND(MAX(density) OVER (PARTITION BY biomarker), 4) AS high FROM d""",
    ["cells", "regions", "features"],
)
def _(t):
    table = ph.region_table(counted(t), ph.region_area(ph.region_pixels(t.regions)))
    out = ph.region_density(table, ["NeuN", "Iba1"])
    return out.withColumns({c: F.round(c, 4) for c in ("density", "low", "high")})


@query(
    "join_nearest_labelled",
    f"""WITH {LOCATED}, lab AS (SELECT * FROM located WHERE region IS NOT NULL), un AS (SELECT * FROM located WHERE region IS NULL),
d AS (SELECT u.ID, l.region, (u.centroid_x - l.centroid_x) ** 2 + (u.centroid_y - l.centroid_y) ** 2 AS d2, l.ID AS lid FROM un u JOIN lab l USING (slide))
SELECT ID, ARG_MIN(region, d2 * 1000000 + lid) AS region, ROUND(SQRT(MIN(d2)), 6) AS distance FROM d GROUP BY ID""",
    ["cells", "regions"],
)
def _(t):
    p = stage(located(t).select("slide", "ID", "region", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")))
    lab = p.where("region IS NOT NULL").withColumnRenamed("ID", "near_id")
    hit = nn.nearest(p.where("region IS NULL"), lab, "ID", "near_id", on=["slide"])
    return many(hit).join(lab.select("near_id", "region"), "near_id").select("ID", "region", F.round("distance", 6).alias("distance"))


@query(
    "join_nearest_mask",
    f"""WITH {GATED}, a AS (SELECT c.ID, c.slide, c.centroid_x AS x, c.centroid_y AS y FROM cells c JOIN gated g USING (ID) WHERE g.S100 = 1),
m AS (SELECT ID AS mask, slide, xmin AS x, ymin AS y FROM cells),
d AS (SELECT a.ID, m.mask, (a.x - m.x) ** 2 + (a.y - m.y) ** 2 AS d2 FROM a JOIN m ON a.slide = m.slide AND a.x BETWEEN m.x - 50 AND m.x + 50 AND a.y BETWEEN m.y - 50 AND m.y + 50)
SELECT ID, mask, ROUND(SQRT(d2), 6) AS distance FROM (SELECT *, RANK() OVER (PARTITION BY ID ORDER BY d2) AS rk FROM d WHERE d2 < 2500) WHERE rk = 1""",
    ["cells", "features"],
)
def _(t):
    a = t.cells.join(gated(t).where(ph.positive("S100")).select("ID"), "ID")
    a = a.select("slide", "ID", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    m = t.cells.select("slide", F.col("ID").alias("mask"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    return nn.nearest_within(a, m, "ID", "mask", 50.0, ["slide"]).select("ID", "mask", F.round("distance", 6).alias("distance"))


@query(
    "join_radius_self",
    """WITH s AS (SELECT slide, centroid_x AS x, centroid_y AS y, MIN(ID) AS id, COUNT(*) AS n FROM cells GROUP BY ALL)
SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS BIGINT) AS sq_dist FROM s a JOIN s b ON a.slide = b.slide AND b.x BETWEEN a.x AND a.x + 20
AND b.y BETWEEN a.y - 20 AND a.y + 20 AND (a.x < b.x OR (a.x = b.x AND a.y < b.y) OR (a.id = b.id AND a.n > 1)) WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 400""",
    ["cells"],
)
def _(t):
    return nn.radius_self(t.cells, 20.0, ["slide"]).select("id_a", "id_b", "n_a", "n_b", F.col("sq_dist").cast("long").alias("sq_dist"))


@query(
    "join_sq_dist",
    """SELECT d.det_id, g.gt_id, ROUND((d.xmin-g.xmin)**2 + (d.ymin-g.ymin)**2 + (d.xmax-g.xmax)**2 + (d.ymax-g.ymax)**2, 6) AS sq_dist FROM det d JOIN gt g ON d.image_id = g.image_id
WHERE (d.xmin-g.xmin)**2 + (d.ymin-g.ymin)**2 + (d.xmax-g.xmax)**2 + (d.ymax-g.ymax)**2 <= 900""",
    GT_DET,
)
def _(t):
    return ov.near_vectors(t.det, t.gt, 900.0, ["image_id"]).select(
        F.col("a.det_id").alias("det_id"), F.col("b.gt_id").alias("gt_id"), F.round("sq_dist", 6).alias("sq_dist")
    )


@query(
    "join_prune_nonoverlap",
    f"SELECT det_id FROM det d WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND {sql_inter('d', 'g')} / {sql_area('d')} >= 0.6)",
    GT_DET,
)
def _(t):
    return ov.prune_non_overlapping(t.det, t.gt, 0.6, ["image_id"], **SMALL).select("det_id")


@query(
    "join_dontcare_anti",
    f"SELECT det_id FROM det d WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.image_id = d.image_id AND g.difficult AND {sql_inter('d', 'g')} > 0)",
    GT_DET,
)
def _(t):
    return ov.drop_overlapping(t.det, t.gt.where("difficult"), ["image_id"], **SMALL).select("det_id")


_TILES = "tiles AS (SELECT CAST(ty * 450 AS BIGINT) AS tile_y, CAST(tx * 450 AS BIGINT) AS tile_x FROM (SELECT UNNEST(RANGE(7)) AS ty), (SELECT UNNEST(RANGE(10)) AS tx))"


@query(
    "join_tile_points",
    f"""WITH {_TILES}, p AS (SELECT ID, centroid_x AS x, centroid_y AS y FROM cells WHERE centroid_x <= 4100 AND centroid_y <= 3100)
SELECT ID, tile_y, tile_x, y BETWEEN tile_y AND LEAST(tile_y + 500, 3100) AND x BETWEEN tile_x AND LEAST(tile_x + 500, 4100) AS core FROM p, tiles
WHERE y BETWEEN tile_y - 30 AND LEAST(tile_y + 500, 3100) + 30 AND x BETWEEN tile_x - 30 AND LEAST(tile_x + 500, 4100) + 30""",
    ["cells"],
)
def _(t):
    p = t.cells.select("ID", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    keys = ["ID", "tile_y", "tile_x"]
    core = nn.points_in_tiles(p, 3100, 4100, 500, 50).select(*keys, F.lit(True).alias("core"))
    wide = nn.points_in_tiles(p, 3100, 4100, 500, 50, halo=30)
    return wide.join(core, keys, "left").select(*keys, F.coalesce("core", F.lit(False)).alias("core"))


@query(
    "join_tile_boxes",
    f"WITH {_TILES} SELECT ID, tile_y, tile_x FROM cells, tiles WHERE xmin >= tile_x AND xmax < tile_x + 500 AND ymin >= tile_y AND ymax < tile_y + 500",
    ["cells"],
)
def _(t):
    return nn.boxes_in_tiles(t.cells, 500, 450, 3100, 4100).select("ID", "tile_y", "tile_x")
