"""The measurements: pairs of settings, trials that leave no trace, storage by group."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelake.cli import parser
from tidelake.plans import evaluation as E
from tidelake.plans.pipeline import Workspace, load_updates

TRIPS = "vendorid int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count int, trip_distance double, ratecodeid int, store_and_fwd_flag string, pulocationid int, dolocationid int, payment_type int, fare_amount double, total_amount double"
AIR = "state_code string, county_code string, site_num string, date_local string, time_local string, date_gmt string, time_gmt string, parameter_name string, sample_measurement double, date_of_last_change string, parameter_code int, poc int, method_name string"


def zones(spark):
    return spark.createDataFrame([(1, "Bronx", "A", "x"), (2, "Queens", "B", "x")], "locationid int, borough string, zone string, service_zone string")


def trips(spark, start, n, zone=lambda k: k % 2 + 1):
    moments = [start + timedelta(hours=k) for k in range(n)]
    return spark.createDataFrame([(1, m, m + timedelta(minutes=20), 1, 2.0, 1, "N", zone(k), 2, 1, 90.0 + k % 30, 130.0) for k, m in enumerate(moments)], TRIPS)


def weather(spark, month):
    return spark.createDataFrame([(2024, month, 1, h, 3.0, 0.0, 3) for h in range(24)], "year int, month int, day int, hour int, temp double, prcp double, coco int")


def air(spark, month):
    day = f"2024-0{month}-01"
    return spark.createDataFrame([("36", "005", "1", day, "05:00", day, "10:00", "PM2.5 - Local Conditions", 9.5, day, 1, 1, "A")], AIR)


def test_tuning_pairs(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    t = trips(spark, datetime(2024, 1, 20), 24 * 30, lambda k: k % 3 + 1).withColumns({"year": F.year("tpep_pickup_datetime"), "month": F.month("tpep_pickup_datetime")})
    found = E.tuning(t, zones(spark), 2024, 1)
    assert [len(found[n]) for n in ("caching", "pruning", "broadcast", "adaptive")] == [4, 2, 2, 2]
    assert found["pruning"][0].rows[0].n == 12 * 24 and {r.trip_count for r in found["caching"][0].rows} == {96, 144}
    assert "SortMergeJoin" in found["broadcast"][0].plan and "BroadcastHashJoin" in found["broadcast"][1].plan
    assert "InMemoryTableScan" in found["caching"][3].plan and "InMemoryTableScan" not in found["caching"][0].plan
    assert "AdaptiveSparkPlan" in found["adaptive"][1].plan and "AdaptiveSparkPlan" not in found["adaptive"][0].plan
    assert before == {k: spark.conf.get(k, None) for k in before} and not t.is_cached
    empty = E.tuning(t.limit(0), zones(spark), 2024, 12)
    assert empty["pruning"][1].rows[0].n == 0 and empty["adaptive"][0].rows == []


def test_same_rows():
    a = [Row(k=1, v=0.1 + 0.2), Row(k=None, v=float("nan")), Row(k=2, v=None)]
    assert E.same_rows(a, [Row(k=2, v=None), Row(k=None, v=float("nan")), Row(k=1, v=0.3)])
    assert not E.same_rows(a, a[:2]) and not E.same_rows([Row(k=1, v=1.0)], [Row(k=1, v=1.1)]) and not E.same_rows([Row(k=1, v=None)], [Row(k=1, v=1.0)])


def test_timing(spark):
    done = []
    found = E.timing(spark, lambda: done.append(1), warm=2, times=5)
    assert len(done) == 7 and len(found["runs"]) == 5 and found["median"] in found["runs"]


def test_trials_leave_no_trace(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PLATFORM_MONITORING", raising=False)
    monkeypatch.setenv("PLATFORM_VALIDATION", "on")
    ws = Workspace(spark, str(tmp_path))
    ws.ledger.start_run("initial_load")
    load_updates(ws, {"taxi_zones": zones(spark), "weather": weather(spark, 1), "air_quality": air(spark, 1), "trip_data": trips(spark, datetime(2024, 1, 1), 48)})
    rows = {k: ws.table(n).read().count() for k, n in (("trips", "trip_data"), ("all", "integrated_taxi_trips"))}
    update = {"weather": weather(spark, 2), "air_quality": air(spark, 2), "trip_data": trips(spark, datetime(2024, 2, 1), 24).withColumn("trip_distance", F.when(F.hour("tpep_pickup_datetime") == 3, -1.0).otherwise(F.col("trip_distance")))}
    found = E.overhead_trials(ws, update, reps=1)
    assert rows == {k: ws.table(n).read().count() for k, n in (("trips", "trip_data"), ("all", "integrated_taxi_trips"))}
    assert not ws.quarantine("trip_data").exists()  # the trials' own quarantine is gone
    assert set(found["configs"]) == set(E.CONFIGS) and {"total", "weather", "trip_data"} <= set(found["validation_overhead"])
    checked, unchecked = (found["trials"][n][0]["datasets"]["trip_data"] for n in ("baseline", "no_validation"))
    assert (checked["inserted_records"], checked["rejected_records"]) == (23, 1) and (unchecked["inserted_records"], unchecked["rejected_records"]) == (24, 0)
    labels = {r.pipeline for r in ws.ledger.runs.read().select("pipeline").distinct().collect()}
    assert labels == {"initial_load", "evaluation:warmup", "evaluation:baseline", "evaluation:no_validation"}  # nothing is recorded with monitoring off
    assert os.environ["PLATFORM_VALIDATION"] == "on" and "PLATFORM_MONITORING" not in os.environ

    out = E.evaluate(ws, update, trials=False, least=10)
    assert out["initial_load"]["trip_data"]["processed_records"] == 48 and out["update"]["datasets"]["trip_data"]["inserted_records"] == 23
    assert len(out["verification"]) == 7 and not any(out["verification"].values()) and set(out["noop_refresh"]["actions"].values()) == {"skip"}
    assert set(out["incremental_refresh"]["actions"].values()) == {"incremental"}
    size = out["storage_after_update"]
    assert size["curated"]["_total"]["live_bytes"] == sum(x["live_bytes"] for n, x in size["curated"].items() if n != "_total") > 0
    assert size["quarantine"]["trip_data"]["live_files"] > 0 and size["products"]["_total"]["log_bytes"] > 0 and "pipeline_runs" in size["monitoring"]


def test_overhead():
    assert E.overhead(3.0, 2.0) == {"seconds": 1.0, "pct_of_run_without": 50.0} and E.overhead(1.0, 0.0)["pct_of_run_without"] is None


def test_commands():
    args = parser().parse_args(["--root", "r", "evaluate", "--reps", "2", "--skip-trials", "weather=csv:x"])
    assert args.reps == 2 and args.skip_trials and args.sources == ["weather=csv:x"]
    assert parser().parse_args(["--root", "r", "tune", "--month", "2024-01"]).month == "2024-01"
    with pytest.raises(SystemExit):
        parser().parse_args(["--root", "r", "evaluate"])
