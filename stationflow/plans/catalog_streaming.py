"""Streaming jobs run over the tables until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..operators import accuracy as A
from ..session import shared_dir
from ..sources import sinks, snapshots
from ..streaming import jobs
from . import views as V
from .catalog_forecast import EDGES, ERRORS, FORECAST_SUMS, METRICS, TTL, _cum2, _sel2, with_forecast_sums
from .registry import query
from .views import NOW, PAIRS_NONE, RQ, now, rounded, wx


def _events(spark, sf) -> DataFrame:
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _to_files(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    out = shared_dir(spark, name)
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
    _finished(writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(out)


def _windows(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    spark = df.sparkSession
    out = shared_dir(spark, name)
    _finished(jobs.newest_windows(df, out, out + "-state"))
    return jobs.read_windows(spark, out, key, df.schema)


@query("""WITH m AS (SELECT event_type, date_trunc('minute', ts) AS b FROM events),
w AS (SELECT event_type, b - to_minutes(unnest([0, 1, 2, 3, 4])) AS window_start FROM m)
SELECT event_type, window_start, count(*) AS n FROM w GROUP BY 1, 2""")
def metric_rates_stream(spark, sf):
    out = jobs.metric_rates_stream(_events(spark, sf), "ts", "event_type")
    return _windows(out, "rates", ["event_type", "window_start"]).select("event_type", "window_start", "n")


@query(f"""WITH ew AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, value FROM events), {_cum2} {_sel2}""")
def latency_quantiles_stream(spark, sf):
    out = _windows(jobs.latency_quantiles_stream(_events(spark, sf), "ts", "value", EDGES), "latency", ["window_start"])
    return rounded(out.select("window_start", "count", "p50", "p95", "p99"), "p50", "p95", "p99", digits=4)


@query("SELECT event_id, user_id, event_type, anchor_us FROM (" + TTL.format(ttl=86400) + ") WHERE NOT is_hit")
def ttl_first_requests(spark, sf):
    """The events, then a heartbeat long after them, which closes what still waits."""
    out, beats = shared_dir(spark, "first-requests"), shared_dir(spark, "beats")
    columns = ["event_id", "user_id", "event_type", "ts"]
    kinds = V.table(spark, sf, "events").select(*columns).schema
    for rows in (V.table(spark, sf, "events").limit(0), V.table(spark, sf, "events").agg(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"),
        (F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"),
    )):
        rows.select(*columns).write.mode("append").parquet(beats)
        stream = _events(spark, sf).select(*columns).unionByName(spark.readStream.schema(kinds).parquet(beats))
        _finished(jobs.ttl_first_requests(stream, ["user_id", "event_type"], "ts", "event_id", out, out + "-state", 86400))
    return jobs.read_requests(spark, out, "user_id bigint, event_type string, event_id bigint, anchor_us bigint").drop("batch")


@query(f"""WITH {RQ} SELECT request_id AS id, 'tft_' || CAST(horizon AS VARCHAR) AS model_key, municipio AS group_id, reference_date, horizon,
TIMESTAMP '{NOW}' AS predicted_at, {FORECAST_SUMS} FROM rq""")
def prediction_ingest(spark, sf):
    src, out = shared_dir(spark, "forecasts"), shared_dir(spark, "log")
    points = V.prediction_points(spark, sf).drop("municipio")
    points.write.json(src)
    _finished(jobs.prediction_ingest(spark, src, out, points.schema, out + "-state", now))
    log = with_forecast_sums(spark.read.parquet(out))
    return log.select("id", "model_key", "group_id", "reference_date", "horizon", "predicted_at", "n_values", "weighted")


@query(f"{PAIRS_NONE} SELECT id AS prediction_id, bucket, {ERRORS}, count(*) AS n_points FROM pr GROUP BY 1, 2")
def accuracy_stream(spark, sf):
    log, ticks, out = (shared_dir(spark, n) for n in ("log", "ticks", "accuracy"))
    A.prediction_rows(V.prediction_points(spark, sf), now()).withColumn("due_day", jobs.due_day()).write.partitionBy("due_day").parquet(log)
    events = V.table(spark, sf, "events")
    events.agg(F.when(F.count(F.lit(1)) > 0, now()).alias("now")).write.json(ticks)
    _finished(jobs.accuracy_stream(spark, ticks, log, lambda: wx(spark, sf), out, out + "-state"))
    rows = spark.read.parquet(out + "/result").select("prediction_id", "bucket", *METRICS, "n_points")
    return rounded(rows, *METRICS)


@query(f"""WITH {V.WX} SELECT municipio, data_hora, CASE WHEN hour(data_hora) < 6 THEN 1.5 ELSE {V.sr('temp_ar_c AS x').rpartition(' AS ')[0]} END AS temp_ar_c FROM wx""")
def incremental_raw_ingest(spark, sf):
    """All stations' files; then files that hold the first hours of each day anew, with other values."""
    root, out = shared_dir(spark, "raw-files"), shared_dir(spark, "clean")
    names = {v: k for k, v in S.RENAME_MAP.items()}
    columns = [S.RAW_DATE, S.RAW_HOUR, names["temp_ar_c"]]
    rows = wx(spark, sf).select(S.KEY, S.TIME, "temp_ar_c")
    for part, data in (("a", rows), ("b", rows.where(F.hour(S.TIME) < 6).withColumn("temp_ar_c", F.lit(1.5)))):
        sinks.write_raw_station_files(data, f"{root}/{part}")
        _finished(jobs.incremental_raw_ingest(spark, root, out, out + "-state", columns, station=_station_folder(), glob="*.txt"))
    return rounded(snapshots.read(spark, out).select(S.KEY, S.TIME, "temp_ar_c"), "temp_ar_c")


def _station_folder():
    return F.regexp_extract("path", "municipio=([^/]+)", 1)
