import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from stationflow import schema as S
from stationflow.operators import service as M
from stationflow.sources import snapshots
from stationflow.streaming import jobs, state
from tests.test_cleaning import HEADER, station_file
from tests.test_forecast import points
from tests.test_text_and_service import brute_ttl, ttl_rows

REF = dt.datetime(2024, 1, 1)


def run(query):
    assert query.awaitTermination(120), "stream did not end"
    if query.exception():
        raise query.exception()


def test_predictions_are_logged_as_they_come(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = (
        "id string, model_type string, model_version string, group_id string, reference_date timestamp, horizon int, "
        "points array<struct<timestamp:timestamp,temp_ar_c:double>>"
    )

    def send(ident):
        rows = [(ident, "tft", "1", "a", REF, 1, [(REF + dt.timedelta(hours=1), 20.0)])]
        spark.createDataFrame(rows, schema).write.mode("append").json(src)
        run(jobs.prediction_ingest(spark, src, out, schema, ck, lambda: F.lit(REF)))

    send("p1")
    send("p2")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["p1", "p2"]


def test_predictions_are_evaluated_once(spark, tmp_path, hourly):
    log, ticks, out, ck = (str(tmp_path / n) for n in ("log", "ticks", "out", "ck"))
    rows = [(i, "a", REF, h, points(h)) for i, h in (("p72", 72), ("p168", 168))]
    spark.createDataFrame(rows, "id string, group_id string, reference_date timestamp, horizon int, forecast_json string").withColumn(
        "due_day", jobs.due_day()
    ).write.partitionBy("due_day").parquet(log)
    series = hourly(60, lambda i: {"temp_ar_c": 20.0 + i})

    def tick(name, hours):
        (tmp_path / "ticks").mkdir(exist_ok=True)
        (tmp_path / "ticks" / name).write_text(json.dumps({"now": (REF + dt.timedelta(hours=hours)).isoformat()}))
        run(jobs.accuracy_stream(spark, ticks, log, lambda: series, out, ck))
        return {(r["prediction_id"], r["bucket"]): r["n_points"] for r in spark.read.parquet(out + "/result").collect()} if (tmp_path / "out/result").exists() else {}

    assert tick("1.json", 71) == {}
    assert tick("1b.json", 72) == {}  # due is not yet passed
    first = tick("2.json", 73)
    assert first == {("p72", "near"): 24, ("p72", "mid"): 35}
    # frozen although more actual values would be there now; the longer one follows
    later = tick("3.json", 169)
    assert later == {**first, ("p168", "near"): 24, ("p168", "mid"): 35}
    assert spark.read.parquet(out + "/result").count() == 4


def test_predictions_wait_for_actual_values(spark, tmp_path, hourly):
    log, ticks, out, ck = (str(tmp_path / n) for n in ("log", "ticks", "out", "ck"))
    rows = [("p", "a", REF, 24, points(24)), ("late", "a", REF, 24, points(24)), ("other", "b", REF, 24, points(24))]
    schema = "id string, group_id string, reference_date timestamp, horizon int, forecast_json string"

    def send(some):
        spark.createDataFrame(some, schema).withColumn("due_day", jobs.due_day()).write.mode("append").partitionBy("due_day").parquet(log)

    def tick(hours, n):
        (tmp_path / "ticks").mkdir(exist_ok=True)
        (tmp_path / "ticks" / f"{hours}.json").write_text(json.dumps({"now": (REF + dt.timedelta(hours=hours)).isoformat()}))
        run(jobs.accuracy_stream(spark, ticks, log, lambda: hourly(n), out, ck, min_points=20))
        return sorted(r.prediction_id for r in spark.read.parquet(out + "/result").collect()) if (tmp_path / "out/result").exists() else []

    send(rows[:1] + rows[2:])
    assert tick(30, 10) == []  # too few actual values
    assert tick(40, 60) == ["p"]
    send(rows[1:2])  # logged long after its due time
    assert tick(50, 60) == ["late", "p"] and tick(60, 60) == ["late", "p"]


def test_a_tick_reads_what_is_due(spark, tmp_path):
    """400 predictions, 20 of them due on each day: a tick lets these out and reads the folder of their day."""
    log, ticks, ck = (str(tmp_path / n) for n in ("log", "ticks", "ck"))
    rows = [(f"p{i}", "a", REF + dt.timedelta(days=i % 20), 24, points(24)) for i in range(400)]
    schema = "id string, group_id string, reference_date timestamp, horizon int, forecast_json string"
    made = spark.createDataFrame(rows, schema).withColumn("due_day", jobs.due_day())
    made.write.partitionBy("due_day").parquet(log)
    (tmp_path / "ticks").mkdir()
    seen = []
    for day in (3, 4):
        (tmp_path / "ticks" / f"{day}.json").write_text(json.dumps({"now": (REF + dt.timedelta(days=day, minutes=1)).isoformat()}))
        due = state.due_predictions(spark.readStream.schema(made.schema).parquet(log), spark.readStream.schema("now timestamp").json(ticks))
        run(due.writeStream.foreachBatch(lambda b, i: seen.extend(b.where("id IS NOT NULL").collect())).option("checkpointLocation", ck).trigger(availableNow=True).start())
        assert len(seen) == 20 * (day)
    asked = spark.createDataFrame([(r.id, (REF + dt.timedelta(days=4)).date()) for r in seen[-20:]], "id string, due_day date")
    found = jobs.logged(spark, log, asked)
    assert found.count() == 20
    found.collect()
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "due_day=" in x or "PartitionFilters" in x]
    assert any("PartitionFilters: [isnotnull(due_day" in x or "PartitionFilters: [due_day" in x for x in scans), scans


def judged_requests(spark, root, batches):
    """(made, late) ids of requests that come in these batches, a heartbeat last."""
    schema = "k string, n int, ts timestamp, id bigint"
    for i, part in enumerate([*batches, [(None, 10**7, None)]]):
        spark.createDataFrame([(k, None if k == "k1" else 7, REF + dt.timedelta(seconds=t), r) for k, t, r in part], schema).coalesce(1).write.parquet(f"{root}/in/{i}")
        os.utime(root / "in" / str(i))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        run(jobs.ttl_first_requests(stream, ["k", "n"], "ts", "id", f"{root}/out", f"{root}/ck"))
    kinds = "k string, n int, id bigint, anchor_us bigint"
    return [{r.id: (r.k, r.n) for r in jobs.read_requests(spark, f"{root}/out", kinds, late).collect()} for late in (False, True)]


def test_requests_are_judged_in_order_of_time(spark, tmp_path):
    """Three ways to cut the batches, rows in any order within the watermark: the results are those of a loop over all."""
    rows = sorted(ttl_rows(), key=lambda r: (r[1], r[2]))
    want = {i for i, (hit, _) in brute_ttl(rows, 3600).items() if not hit}
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 3400))
    cuts = [[mixed], [[r for r in rows if r[1] < 15_000], [r for r in rows if r[1] >= 15_000]], [mixed[i : i + 190] for i in range(0, len(mixed), 190)]]
    keys = {i: (k, None if k == "k1" else 7) for k, _, i in rows}
    for n, cut in enumerate(cuts):
        made, late = judged_requests(spark, tmp_path / str(n), cut)
        assert made == {i: keys[i] for i in want} and late == {}


def test_late_requests_go_to_their_own_output(spark, tmp_path):
    made, late = judged_requests(spark, tmp_path, [[("a", 0, 1), ("a", 9000, 2)], [("a", 100, 3), ("b", 50, 4), ("b", 8000, 5)]])
    assert set(made) == {1, 2, 5} and set(late) == {3, 4}


@pytest.fixture
def events(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(src)
    return src


def collect_stream(spark, df, tmp_path, mode="complete"):
    name = "t" + tmp_path.name.replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run(q)
    return spark.table(name)


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_rates_equal_the_batch_form(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = spark.readStream.schema(batch.schema).parquet(events)
    cols = ["event_type", "window_start", "n", "per_second"]
    live = collect_stream(spark, jobs.metric_rates_stream(stream, "ts", "event_type"), tmp_path)
    assert rows_of(live.select(cols)) == rows_of(M.metric_rates(batch, "ts", "event_type").select(cols))


def test_latency_quantiles_equal_the_batch_form(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = spark.readStream.schema(batch.schema).parquet(events)
    edges = [1.0, 10.0, 50.0, 200.0]
    cols = ["window_start", "count", "p50", "p95", "p99"]
    live = collect_stream(spark, jobs.latency_quantiles_stream(stream, "ts", "value", edges), tmp_path)
    assert rows_of(live.select(cols)) == rows_of(M.latency_quantiles(batch, "ts", "value", edges).select(cols))


def test_every_window_is_delivered(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(batch.schema).parquet(events)
    rates = jobs.metric_rates_stream(stream, "ts", "event_type", late="400 days")
    out = str(tmp_path / "w")
    run(jobs.newest_windows(rates, out, out + "-state"))
    cols = ["event_type", "window_start", "n", "per_second"]
    live = jobs.read_windows(spark, out, cols[:2], rates.schema)
    assert rows_of(live.select(cols)) == rows_of(M.metric_rates(batch, "ts", "event_type").select(cols))


def test_raw_files_replace_their_hours(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    cols = HEADER.split(";")[:-1]

    def load():
        run(jobs.incremental_raw_ingest(spark, str(raw), out, ck, cols))
        df = snapshots.read(spark, out)
        return {(r[0], r[1]): r[2] for r in df.groupBy(S.KEY, "ano").agg(F.sum("temp_ar_c")).collect()}

    name = "INMET_S_RS_A881_DOM PEDRITO_01-01-{y}_A_31-12-{y}.CSV"
    station_file(raw / name.format(y=2023), ["2023/01/01;0000 UTC;1,0;0,0;"])
    station_file(raw / name.format(y=2024), ["2024/01/01;0000 UTC;2,0;0,0;", "2024/01/01;0100 UTC;3,0;0,0;"])
    assert load() == {("dom_pedrito", 2023): 1.0, ("dom_pedrito", 2024): 5.0}
    station_file(raw / name.format(y=2024).replace("_31-12", "_30-06"), ["2024/01/01;0000 UTC;10,0;0,0;"])
    # the newer file has one hour of the year; the other hours stay
    assert load() == {("dom_pedrito", 2023): 1.0, ("dom_pedrito", 2024): 13.0}
    station_file(raw / name.format(y=2024).replace("_31-12", "_31-03"), ["2024/01/01;0000 UTC;7,0;0,0;"])
    old = (REF - dt.timedelta(days=400)).timestamp()
    os.utime(raw / name.format(y=2024).replace("_31-12", "_31-03"), (old, old))
    assert load() == {("dom_pedrito", 2023): 1.0, ("dom_pedrito", 2024): 13.0}


def test_results_wait_for_requests_before_the_next_slot(spark, tmp_path):
    """A result still answers a request that comes later and lies before the first slot that waits."""
    made, late = judged_requests(spark, tmp_path, [[("a", 3000, 1), ("b", 9000, 2)], [("a", 6000, 3)]])
    assert set(made) == {1, 2} and late == {}


def test_state_grows_with_slots_and_not_with_keys(spark, tmp_path):
    schema = "k string, ts timestamp, id bigint"
    rows = [(f"k{i}", REF + dt.timedelta(seconds=60 * (i % 4)), i) for i in range(2000)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = jobs.ttl_first_requests(stream, ["k"], "ts", "id", f"{tmp_path}/out", f"{tmp_path}/ck")
    run(q)
    # before: an entry and a timer for each key, 2,000 of either
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 64 * 8
