"""Streaming forms of the periodic jobs.

Every job takes a ``checkpoint`` folder on storage all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .. import schema as S
from ..functions.times import hours_after
from ..operators import accuracy as A
from ..operators.cleaning import clean
from ..operators.service import metric_histogram, quantile_columns
from ..sources import snapshots
from ..sources.raw import LINE_SOURCE, _exists, numbered_lines, parse_lines
from . import state


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def prediction_ingest(
    spark: SparkSession, in_dir: str, out: str, schema: str | StructType, checkpoint: str,
    predicted_at: Callable[[], Column], every: str | None = None,
) -> StreamingQuery:
    """Forecast files to the prediction log, dealt into folders by the day a prediction is due. Ids come
    with the forecasts, so a batch that is run again after a failure writes the same rows."""
    stream = spark.readStream.schema(schema).json(in_dir)
    rows = A.prediction_rows(stream, predicted_at()).withColumn("due_day", due_day())
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _trigger(writer.partitionBy("due_day").outputMode("append"), every).start()


def due_day(due: Column | None = None) -> Column:
    """Folder of the prediction log: the day of reference plus horizon."""
    return F.to_date(hours_after(F.col("reference_date"), F.col("horizon")) if due is None else due)


def logged(spark: SparkSession, predictions_dir: str, asked: DataFrame) -> DataFrame:
    """Log rows of the predictions in ``asked`` (``id due_day``); only the folders of their days are read."""
    days = [r.due_day for r in asked.select("due_day").distinct().collect()]
    log = spark.read.parquet(predictions_dir).where(F.col("due_day").isin(days))
    return log.join(asked.select("id").distinct(), "id", "left_semi")


def accuracy_stream(
    spark: SparkSession, ticks_dir: str, predictions_dir: str, series: Callable[[], DataFrame],
    out: str, checkpoint: str, every: str | None = None, min_points: int = 1,
) -> StreamingQuery:
    """At each tick evaluates the predictions that have come due.

    ``ticks_dir`` receives one JSON line ``{"now": ...}`` per run; ``predictions_dir`` is the log
    that ``prediction_ingest`` writes, every id once. Its rows are read once, as a stream, and wait
    in keyed state until a tick has passed their due time
    (``state.due_predictions``). A tick reads the log folders of the days that are due and the
    series between their first reference and the tick. Predictions without enough
    actual values wait in ``waiting`` and are tried again at each tick. The result of a batch
    is a folder of its own in ``result``, replaced when the batch is run again.
    """
    result = "prediction_id string, bucket string, mae double, rmse double, mape_frac double, n_points bigint"
    ask = "id string, due_day date"

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        event = f"{out}/events/batch={batch_id}"
        batch.write.mode("overwrite").parquet(event)  # state is read once
        events = spark.read.schema("id string, due_us bigint, now_us bigint").parquet(event)
        before = f"{out}/waiting/batch={batch_id - 1}"
        held = spark.read.schema(ask).parquet(before) if _exists(spark, before) else spark.createDataFrame([], ask)
        asked = events.where("id IS NOT NULL").select("id", due_day(F.timestamp_micros("due_us")).alias("due_day")).unionByName(held)
        now = events.agg(F.timestamp_micros(F.max("now_us")).alias("now")).first().now
        waiting = asked
        if now is not None and not asked.isEmpty():
            predictions = logged(spark, predictions_dir, asked).withColumn(S.KEY, F.col("group_id"))
            first = predictions.agg(F.min("reference_date").alias("t")).first().t
            actual = series().where(F.col(S.TIME).between(F.lit(first), F.lit(now)))
            none = spark.createDataFrame([], result)
            new = A.accuracy_by_bucket(predictions, actual, none, F.lit(now), min_points=min_points)
            path = f"{out}/result/tick={batch_id}"
            new.withColumn("evaluated_at", F.lit(now)).write.mode("overwrite").parquet(path)
            done = spark.read.schema(result).parquet(path).select(F.col("prediction_id").alias("id")).distinct()
            waiting = asked.join(done, "id", "left_anti")
        waiting.write.mode("overwrite").parquet(f"{out}/waiting/batch={batch_id}")

    kinds = spark.read.parquet(predictions_dir).schema
    log = spark.readStream.schema(kinds).parquet(predictions_dir)
    ticks = spark.readStream.schema("now timestamp").json(ticks_dir)
    writer = state.due_predictions(log, ticks).writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def ttl_first_requests(
    stream: DataFrame, key: Sequence[str], ts: str, row_id: str, out: str, checkpoint: str, ttl: int = S.CACHE_TTL_SECONDS,
    late: str = "1 hour", every: str | None = None,
) -> StreamingQuery:
    """Requests that are not answered from a live earlier result go to one output, late ones to another.

    See ``state.ttl_requests``; ``read_requests`` reads either. Each batch is a folder of its own, replaced when it is run again.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{out}/batch={batch_id}")

    writer = state.ttl_requests(stream, key, ts, row_id, ttl, late).writeStream.foreachBatch(keep)
    return _trigger(writer.option("checkpointLocation", checkpoint), every).start()


def read_requests(spark: SparkSession, out: str, schema: str | StructType, late: bool = False) -> DataFrame:
    """What ``ttl_first_requests`` has written: results made, or the late rows (whose ``anchor_us`` is null)."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*fields, StructField("late", BooleanType()), StructField("batch", LongType())])).parquet(out)
    return rows.where(F.col("late") if late else ~F.col("late")).select(*[f.name for f in fields], "batch")


def newest_windows(df: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a windowed aggregation and keep what each batch has changed, in a folder of its own.

    Windows come out as soon as rows reach them, so none is held back for a
    watermark that never passes; a batch that is run again replaces its folder.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def read_windows(spark: SparkSession, out: str, key: Sequence[str], schema: str | StructType) -> DataFrame:
    """The latest state of every window written by ``newest_windows``."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*fields, StructField("batch", LongType())])).parquet(out)
    rest = [f.name for f in fields if f.name not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return last.select(*key, "__r.*")


def metric_rates_stream(
    stream: DataFrame, ts: str, label: str, window: str = "5 minutes", slide: str = "1 minute",
    late: str = "10 minutes", seconds: int = 300,
) -> DataFrame:
    """Events per second in sliding windows."""
    timed = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", late)
    return timed.groupBy(F.window("__et", window, slide).alias("w"), label).agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        label, F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(float(seconds))).alias("per_second")
    )


def latency_quantiles_stream(
    stream: DataFrame, ts: str, value: str, edges: Sequence[float] = tuple(S.INFERENCE_EDGES),
    window: str = "5 minutes", late: str = "10 minutes", q: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Bucket quantiles per time window."""
    timed = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", late)
    tagged = timed.withColumn("__w", F.window("__et", window))
    out = quantile_columns(metric_histogram(tagged, value, edges, ["__w"]), ["__w"], q)
    return out.select(F.col("__w.start").alias("window_start"), *[c for c in out.columns if c != "__w"])


def incremental_raw_ingest(
    spark: SparkSession, raw_dir: str, out: str, checkpoint: str, columns: Sequence[str],
    every: str | None = None, station: Column | None = None, glob: str = "*.{csv,CSV}",
) -> StreamingQuery:
    """Rows of new raw files go into the clean table, hour by hour.

    ``station`` reads a row's station from its ``path``, by default from the file's name.

    For each station and hour the row of the newest file stays (``file_time``, then path,
    then the line as text), whether it came before or comes now; only the partitions (station,
    year) that new rows reach are written anew, as a new version of the table (``sources/snapshots.py``). A batch
    that dies leaves the version before it readable, one that is sent again changes nothing.
    A file is always within one batch. Read the table with ``snapshots.read``.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        at = snapshots.pointer(spark, out)
        if at.batches.get(checkpoint, -1) >= batch_id or batch.isEmpty():
            return
        rows = parse_lines(numbered_lines(batch), columns)
        rows = (rows if station is None else rows.withColumn(S.KEY, station)).where(F.col(S.KEY).isNotNull())
        new = clean(rows.withColumnRenamed("path", "file"), (S.KEY, "file", "file_time")).withColumn("ano", F.year(S.TIME))
        if at.version:
            new = new.unionByName(snapshots.read(spark, out, only=new))
        rest = [c for c in new.columns if c not in (S.KEY, S.TIME, "file_time", "file")]
        newest = F.max(F.struct("file_time", "file", *rest)).alias("__n")
        merged = new.groupBy(S.KEY, S.TIME).agg(newest).select(S.KEY, S.TIME, "__n.*")
        snapshots.replace(merged, out, [S.KEY, "ano"], checkpoint, batch_id)

    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(raw_dir)
    stamped = lines.select("value", *[F.col(source).alias(c) for c, source in LINE_SOURCE.items()])
    writer = stamped.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()
