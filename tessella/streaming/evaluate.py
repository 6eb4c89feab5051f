"""Structured Streaming: evaluation as data arrives, running means, new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.boxes import BOX
from ..operators import evaluation as ev

GT_SCHEMA = (
    "gt_id long, image_id long, class_id long, xmin double, ymin double, xmax double, ymax double, difficult boolean, group_of boolean, ts timestamp"
)
DET_SCHEMA = "det_id long, image_id long, class_id long, score double, xmin double, ymin double, xmax double, ymax double, ts timestamp"
BOX_SCHEMA = (
    "kind string, id long, image_id long, class_id long, score double, xmin double, ymin double, xmax double, ymax double,"
    " difficult boolean, group_of boolean, ts timestamp"
)
LEDGER_SCHEMA = "image_id long, class_id long, rank_id long, score double, tp double, n long"
COUNT_SCHEMA = "class_id long, n_gt double"
#: Folders that stored boxes are dealt to by image, so that a delivery reads those of its images alone.
BUCKETS = 64


def append(stream: DataFrame, path: str) -> None:
    """Append everything available to a Parquet table, exactly once, then stop.

    State is kept in as many partitions as the session's shuffle setting says when the checkpoint is created.
    """
    q = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def _stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one; none where nothing is written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def _write(df: DataFrame, path: str, batch: int, *by: str) -> None:
    """One batch of a table. A batch that runs again replaces what its first run wrote."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def _scored(boxes: DataFrame, threshold: float, group_of_weight: float, **grid) -> DataFrame:
    det = boxes.where("kind = 'det'").select(F.col("id").alias("det_id"), *ev.KEYS, "score", *BOX)
    gt = boxes.where("kind = 'gt'").select(F.col("id").alias("gt_id"), *ev.KEYS, *BOX, "difficult", "group_of")
    return ev.score_detections(ev.best_boxes(ev.valid_boxes(det), gt, **grid), threshold, group_of_weight)


def fold(delivery: DataFrame, batch: int, out: str, threshold: float, group_of_weight: float, **grid) -> None:
    """Take one delivery ``BOX_SCHEMA`` into the tables below ``out``.

    ``boxes`` holds the first copy of every box; copies that come later, however late, are dropped. Matches are formed
    again for the (image, class) groups with new boxes only, and ``ledger`` gets the difference: a row with ``n``
    1 for every scored row that is new, -1 for every one that no longer holds. ``counts`` gets the ground truth
    added to each class. What a batch writes follows from its rows and the batches before it, so a batch can run again.
    """
    spark = delivery.sparkSession
    bucket = F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    flags = {f: F.coalesce(f, F.lit(False)) for f in ("difficult", "group_of")}
    rows = delivery.where("id IS NOT NULL AND image_id IS NOT NULL").withColumns(flags).select("*", bucket)
    _write(rows, f"{out}/delivery", batch)
    rows = spark.read.parquet(f"{out}/delivery/batch={batch}")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    before = _stored(spark, f"{out}/boxes", f"{BOX_SCHEMA}, bucket int", batch).where(F.col("bucket").isin(touched))
    copy = [c for c in rows.columns if c not in ("kind", "image_id", "id", "ts", "bucket")]
    first = rows.groupBy("kind", "image_id", "id", "bucket").agg(F.min(F.struct("ts", *copy)).alias("x")).select("kind", "image_id", "id", "bucket", "x.*")
    seen = before.select("kind", "image_id", "id")
    names = [c.split()[0] for c in BOX_SCHEMA.split(", ")]
    _write(first.join(seen, ["kind", "image_id", "id"], "left_anti").select(*names, "bucket"), f"{out}/boxes", batch, "bucket")
    fresh = spark.read.schema(f"{BOX_SCHEMA}, bucket int").parquet(f"{out}/boxes/batch={batch}").select(*names)
    groups = fresh.select("image_id", "class_id").distinct()
    before = before.select(*names).join(groups, ["image_id", "class_id"], "left_semi")
    now = _scored(before.unionByName(fresh), threshold, group_of_weight, **grid).withColumn("n", F.lit(1))
    was = _scored(before, threshold, group_of_weight, **grid).withColumn("n", F.lit(-1))
    change = now.unionByName(was).groupBy("image_id", "class_id", "rank_id", "score", "tp").agg(F.sum("n").alias("n")).where("n <> 0")
    _write(change, f"{out}/ledger", batch)
    new = fresh.where("kind = 'gt'").withColumn("weight", F.when(F.col("group_of"), float(group_of_weight)).otherwise((~F.col("difficult")).cast("double")))
    _write(new.groupBy("class_id").agg(F.sum("weight").alias("n_gt")), f"{out}/counts", batch)


def stream_eval(
    spark: SparkSession, gt_path: str, det_path: str, out: str, threshold: float = 0.5, group_of_weight: float = 0.0, per_batch: int | None = None, **grid
) -> None:
    """Consume what has arrived of ground truth and detections, in any order, into the tables below ``out``; see ``fold``.

    Call again, with the same settings, when more files have arrived; progress is kept in a checkpoint. ``per_batch`` limits the files of
    each kind in one micro-batch. State is tables instead of values by key, so no image has to fit in a task.
    """
    reader = spark.readStream if per_batch is None else spark.readStream.option("maxFilesPerTrigger", per_batch)
    shared = [c.split()[0] for c in BOX_SCHEMA.split(", ")]
    gt = reader.schema(GT_SCHEMA).parquet(gt_path).select(F.lit("gt").alias("kind"), F.col("gt_id").alias("id"), "*", F.lit(None).cast("double").alias("score"))
    none = F.lit(None).cast("boolean")
    det = reader.schema(DET_SCHEMA).parquet(det_path).select(
        F.lit("det").alias("kind"), F.col("det_id").alias("id"), "*", none.alias("difficult"), none.alias("group_of")
    )
    both = gt.select(*shared).unionByName(det.select(*shared))
    take = lambda df, batch: fold(df, batch, out, threshold, group_of_weight, **grid)
    q = both.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def accepted(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The boxes that count so far: ``kind`` is ``gt`` or ``det``."""
    rows = _stored(spark, f"{out}/boxes", f"{BOX_SCHEMA}, bucket int").where(F.col("kind") == kind)
    names = [c.split()[0] for c in (GT_SCHEMA if kind == "gt" else DET_SCHEMA).split(", ")]
    return rows.withColumnRenamed("id", f"{kind}_id").select(*names)


def current_scores(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Scored rows and ground-truth counts of everything consumed so far, from the ledger; boxes are not read or matched again."""
    ledger = _stored(spark, f"{out}/ledger", LEDGER_SCHEMA)
    scored = ledger.groupBy("image_id", "class_id", "rank_id", "score", "tp").agg(F.sum("n").alias("n")).where("n > 0").drop("n")
    counts = _stored(spark, f"{out}/counts", COUNT_SCHEMA).groupBy("class_id").agg(F.sum("n_gt").alias("n_gt"))
    return scored, counts


def current_ap(spark: SparkSession, out: str) -> DataFrame:
    """Average precision per class over everything consumed so far."""
    return ev.average_precision(*current_scores(spark, out))


def running_mean(stream: DataFrame, value: str, correct, width: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Mean loss and accuracy per time window ``start``, restarted at every window. To be written by ``upsert``.

    A window's state goes when the watermark, ``delay`` behind the latest time, has passed it; rows later than that are left out.
    """
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, width))
    means = windows.agg(F.avg(value).alias("mean_loss"), F.avg(correct.cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return means.select(F.col("window.start").alias("start"), "mean_loss", "accuracy", "n")


def upsert(stream: DataFrame, path: str) -> None:
    """Write what is available of an aggregate in update mode: each micro-batch keeps its changed rows under its own number.

    A batch that runs again after a failure replaces its rows. ``latest`` reads the current row of each key, open windows included.
    """
    take = lambda df, batch: _write(df, path, batch)
    q = (
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", path + "-checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def latest(spark: SparkSession, path: str, schema, keys) -> DataFrame:
    """The last written row of each key of an ``upsert`` table."""
    rest = [c for c in schema.names if c not in keys]
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def process_new_files(spark: SparkSession, path: str, schema, out: str, each=lambda df: df) -> None:
    """Apply ``each`` to files that were not seen before; every file is processed once."""
    append(each(spark.readStream.schema(schema).parquet(path)), out)


def poll(spark: SparkSession, path: str, schema, out: str, interval: str = "5 minutes", each=lambda df: df):
    """Keep looking for new files at the given interval; returns the running query."""
    return (
        each(spark.readStream.schema(schema).parquet(path))
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
        .trigger(processingTime=interval).start()
    )
