"""Readers and writers of cell tables, scripts and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import numbered
from ..operators.phenotype import marker_columns, to_long
from ..operators.registration import parse_names
from ..runtime import stage

BOX_SCHEMA = "ID long, centroid_x long, centroid_y long, xmin long, ymin long, xmax long, ymax long"
SCRIPT_FIXED = {"xmin": "long", "ymin": "long", "xmax": "long", "ymax": "long"}


def read_box_table(spark: SparkSession, path: str, sep: str = "\t", columns=None) -> DataFrame:
    """Box table from text; columns are found by name, the types are fixed."""
    df = spark.read.csv(path, sep=sep, header=True)
    types = dict(c.split() for c in BOX_SCHEMA.split(", "))
    names = columns or [c for c in types if c in df.columns]
    return df.select(*(F.col(c).cast(types[c]).alias(c) for c in names))


def write_box_table(df: DataFrame, path: str, order=None, sep: str = "\t") -> None:
    """Write boxes with ids 1..N in the given order and truncated centres."""
    out = numbered(df, order, "ID") if order is not None else df
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("long")
    out.select(
        "ID", mid("xmin", "xmax").alias("centroid_x"), mid("ymin", "ymax").alias("centroid_y"),
        *(F.col(c).cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")),
    ).write.csv(path, sep=sep, header=True)


def read_marker_table(spark: SparkSession, path: str, sep: str = ",", long: bool = False) -> DataFrame:
    """Wide marker table; every column that is not a key becomes a double marker."""
    df = spark.read.csv(path, sep=sep, header=True)
    markers = marker_columns(df)
    keys = [c for c in df.columns if c not in markers]
    typed = df.select(
        *(F.col(k) if k == "region" else F.col(k).cast("long").alias(k) for k in keys),
        *(F.col(m).cast("double").alias(m) for m in markers),
    )
    return to_long(typed, keys, markers) if long else typed


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Text with a header; null strings are written empty."""
    df.write.csv(path, sep=sep, header=True, emptyValue="", nullValue="")


def read_channel_script(spark: SparkSession, path: str) -> DataFrame:
    """Channel script; the optional ``structure`` and ``level`` columns become nulls when absent."""
    df = spark.read.csv(path, header=True)
    for c in ("structure", "level"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumns({c: F.col(c).cast(t) for c, t in SCRIPT_FIXED.items() if c in df.columns})


def read_rule_table(spark: SparkSession, paths) -> DataFrame:
    """Rule matrix from one text file per sheet; ``rule_order`` follows sheets, then rows.

    The row order within a sheet is the order in its file, and by name over files if a sheet has several.
    """
    sheets = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, p in enumerate(sheets):
        df = spark.read.csv(p, header=True, sep=",")
        df = df.withColumns({"sheet": F.lit(i), "_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    order = [F.col("sheet"), F.col("_path"), F.col("_block"), F.col("_at")]
    return numbered(stage(out, "rules"), order, "rule_order").drop("_path", "_block", "_at")


def file_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with round, channel and set prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("filename"))


def crop_corner(files: DataFrame, order: str = "x_y", name: str = "filename") -> DataFrame:
    """Crop corner from names like ``00300_00600.xml``; older tools wrote ``y_x``."""
    if order not in ("x_y", "y_x"):
        raise ValueError("order must be 'x_y' or 'y_x'")
    a = F.regexp_extract(name, r"(\d+)_(\d+)\.[^.]*$", 1).cast("long")
    b = F.regexp_extract(name, r"(\d+)_(\d+)\.[^.]*$", 2).cast("long")
    x, y = (a, b) if order == "x_y" else (b, a)
    return files.withColumns({"corner_x": x, "corner_y": y})


def image_index(files: DataFrame, name: str = "filename") -> DataFrame:
    return parse_names(files, name)


def class_folders(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with the class named by its folder; ids follow the class order.

    Folders may be plain names or ``key=value`` partition folders.
    """
    files = file_index(spark, path)
    named = files.withColumn("class", F.regexp_replace(F.element_at(F.split("path", "/"), -2), r"^[^=]*=", ""))
    ids = numbered(named.select("class").distinct(), [F.col("class")], "class_id")
    return named.join(ids, "class").select("path", "class", (F.col("class_id") - 1).alias("class_id"))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``key<TAB>name`` lines."""
    return spark.read.csv(path, sep="\t", schema="key string, name string")


def read_box_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``file,xmin,ymin,xmax,ymax`` lines, one row per box."""
    return spark.read.csv(path, schema="file string, xmin double, ymin double, xmax double, ymax double")


def read_mask_array(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated label matrices to sparse ``(file, label, y, x)``, one a file; 0 is background.

    Partition columns of the folder are kept. The row number is the rank of the line by split offset and position, computed
    over ranges, so a large matrix is read by many tasks.
    """
    text = spark.read.text(path)
    more = [c for c in text.columns if c != "value"]
    lines = text.select(
        *more, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value",
    )
    rows = numbered(lines, [F.col("_block"), F.col("_at")], "_row", ["_path"])
    name = F.element_at(F.split("_path", "/"), -1).alias("file")
    cells = rows.select(name, *more, (F.col("_row") - 1).alias("y"), F.posexplode(F.split("value", ",")).alias("x", "label"))
    return cells.select("file", *more, F.trim("label").cast("long").alias("label"), "y", F.col("x").cast("long").alias("x")).where("label > 0")


def write_raster_tiles(pixels: DataFrame, path: str, tile: int, channel: str = "channel") -> None:
    """Pixels to tile rows ``(channel, tile_y, tile_x, h, w, values)``, partitioned by channel.

    A tile holds at most ``tile`` squared values.
    """
    from ..operators.raster import with_tile

    at = (F.col("y") - F.col("tile_y")) * tile + F.col("x") - F.col("tile_x")
    tiles = with_tile(pixels, tile).groupBy(channel, "tile_y", "tile_x").agg(
        F.array_sort(F.collect_list(F.struct(at.cast("int").alias("k"), F.col("value").alias("v")))).alias("m"),
        (F.max("y") - F.min("tile_y") + 1).alias("h"), (F.max("x") - F.min("tile_x") + 1).alias("w"),
    )
    # the values in order, with zeros for the places left out before each and after the last
    zeros = lambda n: F.transform(F.array_repeat(F.lit(0), n), lambda v: v.cast(dict(pixels.dtypes)["value"]))
    ends = lambda i: F.when(i > 0, F.get("m", i - 1)["k"]).otherwise(F.lit(-1))
    twice = F.raise_error(F.lit("a tile has two pixels at one place"))
    gap = lambda e, i: F.when(e["k"] > ends(i), e["k"] - ends(i) - 1).otherwise(twice.cast("int"))
    filled = F.flatten(F.transform("m", lambda e, i: F.concat(zeros(gap(e, i)), F.array(F.coalesce(e["v"], F.lit(0))))))
    dense = F.concat(filled, zeros(F.lit(tile * tile - 1) - F.element_at("m", -1)["k"]))
    tiles.select(channel, "tile_y", "tile_x", "h", "w", dense.alias("values")).write.partitionBy(channel).parquet(path)


def read_raster_tiles(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """Tile rows back to pixels; zeros stay implicit, channel folders are pruned by filters."""
    t = spark.read.parquet(path)
    p = t.select("channel", "tile_y", "tile_x", F.posexplode("values").alias("i", "value")).where("value <> 0")
    return p.select("channel", (F.col("tile_y") + F.floor(F.col("i") / tile)).alias("y"), (F.col("tile_x") + F.col("i") % tile).alias("x"), "value")


def read_encoded_tiles(spark: SparkSession, path: str, decoder, schema: str) -> DataFrame:
    """Image files decoded by a caller-given function ``bytes -> DataFrame`` of ``schema``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                out = decoder(bytes(data))
                out.insert(0, "path", name)
                yield out

    return files.mapInPandas(run, f"path string, {schema}")


def shard_names(df: DataFrame, name: str = "name") -> DataFrame:
    """``base@N`` to its N shard names ``base-00000-of-0000N``; other names stay."""
    n = F.regexp_extract(name, r"@(\d+)", 1).cast("int")
    base = F.regexp_replace(name, r"@\d+", "")
    one = F.when(n.isNull(), F.array(F.col(name))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.format_string("%s-%05d-of-%05d", base, i, n))
    )
    return df.select(name, F.explode(one).alias("shard"))


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)
