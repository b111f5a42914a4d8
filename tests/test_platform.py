"""Versioned tables, pipeline, ledger, products, refresh planning, streaming, ML."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake.plans import ledger, ml, products, refresh
from tidelake.plans.contracts import Contract
from tidelake.plans.pipeline import Workspace, integrate, load, load_updates
from tidelake.plans.rules import InRange
from tidelake.sources.table import Conflict, Files, Table, files_for, micros_of, moment_of, pinned
from tidelake.streaming.ingest import ingest_available


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_table(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(30)], "k int, p int, v double")
    assert t.create(df.filter("k < 20"), ["p"]) == 0
    assert t.insert_new(df, ["k"]) == 10 and t.insert_new(df, ["k"]) == 0 and t.latest_version() == 1
    assert t.read().count() == 30 and t.read(0).count() == 20
    assert t.changed_partitions(0, 1) == {(0,), (1,), (2,)} and t.changed_partitions(0, 7) is None
    t.replace(df.filter("p = 1").withColumn("v", F.lit(0.0)), {(1,)})
    assert t.changed_partitions(1, 2) == {(1,)} and t.read().filter("p = 1").agg(F.sum("v")).first()[0] == 0
    t.replace(df.limit(0), {(2,)})
    assert t.read().filter("p = 2").count() == 0 and t.detail()["rows"] == 20
    with pytest.raises(ValueError):
        t.replace(df, {(1,)})
    t.append(spark.createDataFrame([(99, 0, 1.0, "x")], "k int, p int, v double, extra string"))
    assert rows(t.read().filter("extra is not null"), "k", "extra") == [(99, "x")] and "extra" not in t.read(0).columns
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([("a", 0)], "k string, p int"))
    t.restore(1)
    assert t.read().count() == 30 and t.read().columns == ["k", "p", "v"]
    before = t.detail()["files"]
    t.compact()
    assert t.detail()["files"] <= before and t.read().count() == 30 and t.changed_partitions(t.latest_version() - 1, t.latest_version()) == set()
    assert "PartitionFilters: [isnotnull(p" in t.read().filter("p = 1")._jdf.queryExecution().toString()
    t.overwrite(df.select("k"), [])
    assert t.read().columns == ["k"] and t.history().count() == t.latest_version() + 1 and t.vacuum() >= 0
    assert t.storage()["live"] > 0 and files_for(0) == 1 and files_for(2_500_000) == 3
    first = t.commit_of(0)
    assert t.version_at(moment_of(first.timestamp - 1)) is None and t.version_at(moment_of(first.timestamp) + timedelta(days=1)) == t.latest_version()
    assert [t.version_at(moment_of(c.timestamp)) for c in t.commits()] == t.versions()
    assert all(micros_of(moment_of(x)) == x for x in range(1_700_000_000_000_000, 1_700_000_000_020_000, 7))
    versions, notes = pinned(t, {"other": t}, 0)
    assert versions == {"main": 0, "other": 0} and not notes


def test_lists_of_live_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidelake.sources.table.LIST_EVERY", 2)
    t = Table(spark, f"{tmp_path}/t")
    odd = "a b/c:d%e"
    df = spark.createDataFrame([(k, odd if k % 2 else None) for k in range(6)], "k int, p string")
    t.create(df, ["p"])
    t.replace(df.filter("k = 1"), {p for p in t.detail()["partitions"] if "HIVE" not in p[0]})
    t.append(df.filter("k = 0"))
    t.overwrite(df, ["p"])
    t.append(df.filter("k = 2"))
    assert [n for n in t.files.names("_log") if n.endswith(".live")] == [f"{v:020d}.live" for v in (2, 4)]
    sizes = []
    for v in t.versions():
        live = {}
        for c in t.commits()[: v + 1]:
            live = {p: a for p, a in live.items() if p not in c.remove} | {a["path"]: a for a in c.add}
        assert Table(spark, t.root)._live(v)[1] == live
        sizes.append((t.read(v).count(), t.detail(v)["rows"]))
    assert sizes == [(6, 6), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert {r.p for r in t.read().collect()} == {odd, None} and t.read().columns == ["k", "p"]


def test_commits_exclude_each_other(spark, tmp_path, monkeypatch):
    t = Table(spark, f"{tmp_path}/t")
    t.create(spark.range(5))
    assert not t.files.create(f"_log/{0:020d}.json", "{}")
    gone = list(t._live()[1])
    t.overwrite(spark.range(3))
    with pytest.raises(Conflict):
        t._commit("x", t.schema(), [], [], gone)
    with pytest.raises(Conflict):
        t._commit("x", t.schema(), [], [], [], base=0)
    # A file that comes while a replacement is under way isn't removed unseen.
    base = t.latest_version()
    live = iter([{"a"}, {"a", "b"}])
    create, t.files.create = t.files.create, lambda *a: False
    with pytest.raises(Conflict):
        t._commit("x", t.schema(), [], [], lambda files: list(files)[: len(next(live)) - 1])
    t.files.create = create
    assert t.latest_version() == base
    t.files.fs.create(t.files._path(f"_log/{base + 1:020d}.json.lock"), False).close()  # of a writer that died
    monkeypatch.setattr("tidelake.sources.table.STALE_LOCK", 0)
    assert t.append(spark.range(2)) == base + 1
    assert isinstance(t.files, Files)


WEATHER = Contract("w", required=("year", "temp"), rules=(InRange("temp", -50, 60), InRange("humidity", 0, 100)), undeclared="evolve")


def test_two_releases(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    one = spark.createDataFrame([(2025, 0, 1.0), (2025, 1, 2.0), (2025, 2, None)], "year int, hour int, temp double")
    two = spark.createDataFrame([(2025, 1, 2.0, 5), (2025, 5, 3.0, 6), (2025, 5, 3.0, 6), (2025, 6, 85.0, 1), (2025, 7, 1.0, 140)], "year int, hour int, temp double, humidity int")
    ws.ledger.start_run("test")
    _, a = load(ws, "w", one, ["hour"], rules=WEATHER)
    assert (a["write_mode"], a["inserted_records"]) == ("created", 3)
    clean, b = load(ws, "w", two, ["hour"], rules=WEATHER)
    assert (b["inserted_records"], b["dropped_records"], b["quarantined_records"]) == (1, 1, 3)
    assert clean.count() == 1  # still the batch, though the table has taken it in
    _, again = load(ws, "w", two, ["hour"], rules=WEATHER)
    assert again["inserted_records"] == 0 and again["write_mode"] == "unchanged"
    assert ws.quarantine("w").read().count() == b["quarantined_records"] + again["quarantined_records"]
    _, c = load(ws, "w", one.drop("temp"), ["hour"], rules=WEATHER)
    assert c["status"] == "rejected"
    _, e = load(ws, "w", one.withColumn("temp", F.lit("2024-01-01").cast("date")), ["hour"], rules=WEATHER)
    assert e["status"] == "rejected" and ws.table("w").latest_version() == 1
    with pytest.raises(ZeroDivisionError):
        load(ws, "w", one, ["hour"], rules=WEATHER, process=lambda df: 1 / 0)
    ws.ledger.flush()
    runs, checks = ws.ledger.runs.read(), ws.ledger.checks.read()
    assert rows(runs.groupBy("status").count(), "status", "count") == [("failed", 1), ("rejected", 2), ("succeeded", 3)]
    assert len(runs.columns) == 29 and len(checks.columns) == 11
    assert max(r.schema_version for r in runs.collect()) >= 2
    for query, which in ledger.QUERIES.values():
        assert query(runs if which == "runs" else checks).collect() is not None
    worst = ledger.failing_datasets(runs).first()
    assert (worst.executions, worst.executions_with_failures, worst.rejected_records) == (6, 4, 4 + 5 + 3 + 3)
    assert ledger.failing_rules(checks).first().executions_failed == 2 and ledger.category_totals(checks).count() > 0
    history = ledger.schema_history(runs).collect()
    assert [r.schema_version for r in history] == [1, 2, 3, 4] and "humidity" in history[1].changes_when_introduced
    stored = ws.quarantine("w").read()
    assert stored.join(runs, stored._execution_id == runs.execution_id, "left_semi").count() == stored.count()
    assert ledger.latest_results(runs, checks).count() == 0 and ledger.latest_status(runs).first().status == "failed"


def test_monitoring_off(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PLATFORM_MONITORING", "off")
    ws = Workspace(spark, str(tmp_path))
    load(ws, "x", spark.range(3), ["id"])
    ws.ledger.flush()
    assert not ws.ledger.runs.exists()


def integrated(spark, months, n=3, **more):
    data = []
    for y, m in months:
        for k in range(n):
            ts = datetime(y, m, 1 + k, 5 + k)
            data.append((f"{y}-{m}-{k}", ts, ts, 1.0 + k, 10.0, 12.0, 2.5, 0.0, 10.0 * k, 3, "zone" if k else None, "boro", y, m, 1 + k))
    df = spark.createDataFrame(data, "surrogate_key string, tpep_pickup_datetime timestamp_ntz, pickup_hour timestamp_ntz, trip_distance double, fare_amount double, total_amount double, temp double, prcp double, pm25 double, coco int, pickup_zone string, pickup_borough string, year int, month int, passenger_count int")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def actions(ws):
    return {p.product: (p.action, sorted(p.months)) for p in refresh.refresh_affected(ws, least=1)}


def test_refresh(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    source = ws.table("integrated_taxi_trips")
    source.create(integrated(spark, [(2024, 1), (2024, 2)]), ["year", "month"])
    assert all(a == ("full", []) for a in actions(ws).values())
    assert all(a[0] == "skip" for a in actions(ws).values())
    source.append(integrated(spark, [(2024, 3)]))
    assert all(a == ("incremental", [(2024, 3)]) for a in actions(ws).values())
    source.replace(integrated(spark, [(2024, 2)], 2), {(2024, 2)})
    assert all(a == ("incremental", [(2024, 2)]) for a in actions(ws).values())
    source.replace(source.read().limit(0), {(2024, 1)})  # the month leaves the window
    assert all(a == ("incremental", [(2024, 1)]) for a in actions(ws).values())
    stored = ws.product("borough_mobility_summary").read()
    assert rows(stored.select("month").distinct(), "month") == [(2,), (3,)]
    window = products.window_of(source.detail(), 1)
    assert set(products.verify(ws, list(products.PRODUCTS.values()), window).values()) == {0}
    source.append(integrated(spark, [(2024, 4)], humidity=50.0))  # an optional column comes
    assert all(a == ("incremental", [(2024, 4)]) for a in actions(ws).values())
    assert ws.product("daily_mobility_summary").read().filter("avg_humidity = 50").count() == 3
    source.overwrite(source.read().drop("pm25"))
    plans = {p.product: p.action for p in refresh.refresh_affected(ws, dry_run=True, least=1)}
    assert plans["air_quality_impact_summary"] == "blocked" and plans["taxi_zone_statistics"] != "blocked"
    source.overwrite(integrated(spark, [(2024, 3)]).withColumn("trip_distance", F.col("trip_distance").cast("float")))
    assert {p.product: p.action for p in refresh.refresh_affected(ws, dry_run=True, least=1)}["taxi_zone_statistics"] == "full"
    assert {p.action for p in refresh.refresh_affected(ws, dry_run=True, force_full=True, least=1)} == {"full"}
    impact = products.weather_rollup(ws.product("weather_impact_summary").read())
    assert impact.count() == 1 and {"source_version", "created_at", "stddev_trip_distance"} <= set(impact.columns)
    assert set(products.register_views(ws)) == {*products.PRODUCTS, "weather_impact_summary_monthly", "borough_mobility_summary_monthly"}
    assert products.distance_by_weather(impact).first().weather_category == "Clear/Fair" and products.zone_variation(impact, 1).count() == 0
    assert products.peak_hours(spark.table("borough_mobility_summary")).count() >= 1
    assert products.borough_rollup(stored).count() >= 1 and products.Registry(ws).latest().count() == 5


def test_planner_order():
    p = products.PRODUCTS["taxi_zone_statistics"]
    columns = dict.fromkeys(p.required, "int")
    entry = {"schema_version": p.version, "source_columns": json.dumps(columns), "source_version": 3}
    plan = lambda **kw: refresh.plan_product(**({"product": p, "columns": columns, "source_version": 4, "entry": entry, "stored": {(2024, 1)}, "window": {(2024, 1)}, "changed": {(2024, 1)}} | kw)).action
    assert [plan(columns={}), plan(entry=None), plan(stored=None), plan(source_version=3), plan(changed=None), plan(), plan(changed={(2020, 1)}), plan(entry=entry | {"schema_version": "0"})] == [
        "blocked", "full", "full", "skip", "full", "incremental", "skip", "full"
    ]


def test_late_weather(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    zones = spark.createDataFrame([(1, "Bronx", "A", "x"), (2, "Queens", "B", "x")], "locationid int, borough string, zone string, service_zone string")
    weather = lambda hours, **kw: spark.createDataFrame([(2024, 1, 1, h, 3.0) for h in hours], "year int, month int, day int, hour int, temp double").withColumns({k: F.lit(v) for k, v in kw.items()})
    air = spark.createDataFrame([("36", "005", "1", "2024-01-01", "05:00", "2024-01-01", "10:00", "PM2.5 - Local Conditions", 8.0, "2024-02-01", 1, 1, "A"), ("36", "005", "1", "2024-01-01", "05:00", "2024-01-01", "10:00", "PM2.5 - Local Conditions", 10.0, "2024-02-01", 1, 1, "B"), ("36", "005", "1", "2024-01-01", "05:00", "2024-01-01", "10:00", "Lead (TSP) LC", 2.0, "2024-02-01", 2, 1, "A")], "state_code string, county_code string, site_num string, date_local string, time_local string, date_gmt string, time_gmt string, parameter_name string, sample_measurement double, date_of_last_change string, parameter_code int, poc int, method_name string")
    trip = lambda h: (1, datetime(2024, 1, 1, h), datetime(2024, 1, 1, h, 20), 1, 2.0, 1, "N", 1, 2, 1, 10.0, 12.0)
    trips = spark.createDataFrame([trip(5), trip(6)], "vendorid int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count int, trip_distance double, ratecodeid int, store_and_fwd_flag string, pulocationid int, dolocationid int, payment_type int, fare_amount double, total_amount double")
    done = load_updates(ws, {"taxi_zones": zones, "weather": weather([5]), "air_quality": air, "trip_data": trips})
    assert done["integrated_taxi_trips"]["inserted_records"] == 2 and done["air_quality"]["quarantined_records"] == 0
    table = ws.table("integrated_taxi_trips")
    assert rows(table.read().fillna(-1.0), "temp", "pm25", "pickup_zone", "dropoff_borough") == [(-1.0, -1.0, "A", "Queens"), (3.0, 9.0, "A", "Queens")]
    assert rows(table.read().filter("lead_tsp_lc is not null"), "temp", "lead_tsp_lc") == [(3.0, 2.0)]
    done = load_updates(ws, {"weather": weather([5, 6], humidity=40)})
    assert done["reenriched"]["months"] == [(2024, 1)]
    assert rows(table.read().fillna({"humidity": -1}), "temp", "humidity") == [(3.0, -1), (3.0, 40)]
    assert integrate(ws.table("trip_data").read(), ws.table("weather").read(), ws.table("air_quality").read(), zones).count() == 2


def test_stream_as_batch(spark, tmp_path):
    ws = Workspace(spark, f"{tmp_path}/ws")
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    df.filter("id < 10").write.parquet(f"{tmp_path}/in/a")
    path = f"{tmp_path}/in/*"
    ingest_available(ws, "s", path, df.schema, ["id"], f"{tmp_path}/cp")
    df.write.parquet(f"{tmp_path}/in/b")
    ingest_available(ws, "s", path, df.schema, ["id"], f"{tmp_path}/cp")
    assert rows(ws.table("s").read(), "id", "v") == [(k, 2 * k) for k in range(20)]


ZONES = [(1, "Manhattan", "A", "Yellow Zone"), (2, "Queens", "B", "Boro Zone"), (3, "Bronx", "C", "Boro Zone"), (264, "Unknown", "N/A", "N/A")]
DATASET = ml.DatasetConfig(test_weeks=1, validation_weeks=1, lags=(1, 24), hourly=("temp", "coco", "pm25"))


def zones_of(spark):
    return spark.createDataFrame(ZONES, "locationid int, borough string, zone string, service_zone string")


def pickups(spark, data):
    """Pickups (moment, zone); the temperature is the hour of the day."""
    full = [(at, zone, float(at.hour), 8.0, 3, at.year, at.month) for at, zone in data]
    return spark.createDataFrame(full, "tpep_pickup_datetime timestamp_ntz, pulocationid int, temp double, pm25 double, coco int, year int, month int")


def hourly(start, end, zone=1, skipped=()):
    moments = [start + timedelta(hours=h) for h in range(int((end - start).total_seconds() // 3600))]
    return [(m + timedelta(minutes=30), zone) for m in moments if m not in skipped]


def by_cell(df):
    return {(r.pulocationid, r.pickup_hour): r for r in df.collect()}


def test_dataset_cells_lags_and_splits(spark):
    start, end, day = datetime(2024, 1, 1), datetime(2024, 1, 22), lambda d, h: datetime(2024, 1, d, h)
    data = hourly(start, end) + hourly(start, end, 264) + [(day(2, h), 2) for h in range(8, 16)] + [(day(20, h), 3) for h in range(24)]
    got = by_cell(ml.build_dataset(pickups(spark, data), zones_of(spark), start, end, DATASET))
    assert {z for z, _ in got} == {1, 2} and len(got) == 2 * 21 * 24  # zone 3 has no pickup in the training week, 264 is no place
    quiet = got[2, day(2, 7)]
    assert (quiet.trip_count, quiet.temp, quiet.pickup_borough, quiet.pickup_service_zone) == (0, 7.0, "Queens", "Boro Zone")
    assert (got[2, day(2, 9)].trip_count_lag_1h, got[2, day(2, 8)].trip_count_lag_1h, got[2, day(3, 8)].trip_count_lag_24h) == (1, 0, 1)
    assert got[1, start].trip_count_lag_1h is None and got[1, day(1, 23)].trip_count_lag_24h is None
    hours = {s: sorted(h for (z, h), r in got.items() if z == 1 and r.split == s) for s in ("train", "validation", "test")}
    assert {s: (h[0], len(h)) for s, h in hours.items()} == {"train": (day(1, 0), 168), "validation": (day(8, 0), 168), "test": (day(15, 0), 168)}
    with pytest.raises(ValueError):
        ml.split_boundaries(start, datetime(2024, 1, 20), DATASET)
    with pytest.raises(ValueError):
        ml.build_dataset(pickups(spark, data).drop("pm25"), zones_of(spark), start, end, DATASET)
    # Seven pickups in a week are one a day, six aren't.
    for n, chosen in ((7, {1, 2}), (6, {1})):
        few = pickups(spark, hourly(start, end) + [(day(2, h), 2) for h in range(n)])
        assert {z for z, _ in by_cell(ml.build_dataset(few, zones_of(spark), start, end, DATASET))} == chosen


def test_dataset_counts_trusted_rejections(spark):
    start, end, at = datetime(2024, 1, 1), datetime(2024, 1, 22), datetime(2024, 1, 2, 8, 20)
    reasons = {"a": ["not_null(passenger_count)"], "b": ["positive(passenger_count)"], "c": ["not_null(passenger_count)", "positive(trip_distance)"], "d": ["non_negative_amounts"]}
    quarantine = spark.createDataFrame([(at, 1, k, reasons[k]) for k in "aabcd"], "tpep_pickup_datetime timestamp_ntz, pulocationid int, surrogate_key string, _rejection_reasons array<string>")
    more = ml.quarantined_pickups(quarantine, DATASET.trusted_reasons)
    got = by_cell(ml.build_dataset(pickups(spark, hourly(start, end)), zones_of(spark), start, end, DATASET, more))
    assert (got[1, datetime(2024, 1, 2, 8)].trip_count, got[1, datetime(2024, 1, 2, 8)].temp, got[1, datetime(2024, 1, 2, 9)].trip_count_lag_1h) == (3, 8.0, 3)


def test_dataset_follows_the_wall_clock(spark):
    zone, start, end = spark.conf.get("spark.sql.session.timeZone"), datetime(2024, 3, 4), datetime(2024, 4, 1)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Stockholm")
    try:
        got = by_cell(ml.build_dataset(pickups(spark, hourly(start, end, skipped={datetime(2024, 3, 10, 2)})), zones_of(spark), start, end, DATASET))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    at = lambda d, h: got[1, datetime(2024, 3, d, h)]
    assert len(got) == 4 * 7 * 24 - 1 and (1, datetime(2024, 3, 10, 2)) not in got
    assert (at(31, 2).trip_count, at(31, 3).trip_count, at(10, 3).trip_count_lag_1h, at(10, 4).trip_count_lag_1h) == (1, 1, None, 1)


def test_dataset_window_and_history(spark):
    trips = pickups(spark, [(datetime(2023, 12, 31, 23, 40), 1)] + hourly(datetime(2024, 1, 1), datetime(2024, 2, 12, 5)))
    months = sorted((r.year, r.month) for r in products.reporting_window(trips, 100).collect())
    assert months == [(2024, 1), (2024, 2)]
    assert ml.resolve_window(trips, DATASET, months) == (datetime(2024, 1, 1), datetime(2024, 2, 13))
    other = ml.DatasetConfig(start=datetime(2023, 6, 1), end=datetime(2024, 2, 5))
    assert ml.resolve_window(trips, other, months) == (datetime(2024, 1, 1), datetime(2024, 2, 5))
    reported, end = trips.filter("year = 2024"), datetime(2024, 2, 13)
    first = ml.build_dataset(reported, zones_of(spark), datetime(2024, 1, 1), end, DATASET).orderBy("pickup_hour").first()
    assert first.pickup_hour == datetime(2024, 1, 1) and first.trip_count_lag_1h is None
    assert ml.build_dataset(reported, zones_of(spark), datetime(2024, 1, 8), end, DATASET).orderBy("pickup_hour").first().trip_count_lag_24h == 1


def test_features_and_model(spark, tmp_path):
    start, end = datetime(2024, 3, 4), datetime(2024, 3, 25)
    data = [(m + timedelta(minutes=k), 1) for m, _ in hourly(start, end) for k in range(1 + m.hour // 6)] + [x for x in hourly(start, end, 2) if x[0].hour % 2]
    df = ml.build_dataset(pickups(spark, data), zones_of(spark), start, end, DATASET).cache()
    summary = {r.split: r for r in ml.split_summary(df, "trip_count", ["temp"]).collect()}
    assert (summary["train"].rows, summary["test"].rows) == (336, 336)
    found = ml.signal(df, DATASET)
    assert 0 < found["structure"]["zone"] <= found["structure"]["zone_x_hour_of_week"] <= 1 and found["correlation"]["trip_count_lag_24h"]["r_target"] > 0.9
    assert set(found["correlation"]["coco"]) == {"eta_squared_residual"} and found["structure"]["zone_x_hour_of_week_r2_on_validation"] > 0.9
    assert ml.group_mean_baseline(df, "trip_count", ["pulocationid"]).count() == 3
    features = ml.FeatureConfig()
    model, plan = ml.fit_features(df, features)
    assert plan.dropped["pm25"] == "constant" and plan.dropped["snwd"] == "missing"
    ready = model.transform(df)
    assert len(ml.slots(ready)) == ready.first().features.size and set(ml.learned(model)) == {"medians", "mean", "std", "labels"}
    unseen = model.transform(df.limit(1).withColumn("pickup_borough", F.lit("nowhere"))).first()
    assert unseen.features.size == ready.first().features.size
    trained, score = ml.train_model(df, features, f"{tmp_path}/m", iterations=3, depth=3)
    assert score["test"]["r2"] > 0.5
    ml.manifest(f"{tmp_path}/x.json", config=DATASET, score=score, columns=ml.column_dictionary(df, {}))
    assert json.load(open(f"{tmp_path}/x.json"))["config"]["test_weeks"] == 1
    probe = ml.importance_probe(ready, "trip_count", trees=3, depth=3)
    assert abs(sum(probe["importance"].values()) - 1) < 1e-6 and abs(sum(probe["by_slot"].values()) - 1) < 1e-6
    assert [ml.source_of(x) for x in ("scaled_0", "cat_pickup_borough_hot_Queens", "cal_hour_hot_5", "missing_temp", "log_trip_count_lag_1h")] == ["0", "pickup_borough", "hour", "temp", "trip_count_lag_1h"]


def test_cli_surface():
    from tidelake.cli import parser

    args = parser().parse_args(["--root", "r", "refresh", "--product", "a", "--product", "b", "--dry-run", "--verify"])
    assert args.product == ["a", "b"] and args.dry_run and args.verify and not args.full
    assert parser().parse_args(["--root", "r", "dataset", "--start", "2024-01-01", "--source-version", "3"]).source_version == 3


def test_queries_match_oracle(spark):
    """Each registered query against its SQL in DuckDB."""
    import duckdb

    from tidelake import queries

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet')")
    for name in queries.SQL:
        want = con.execute(queries.SQL[name])
        names = [x[0] for x in want.description]
        got = queries.QUERIES[name](spark, d)
        assert sorted(names) == sorted(got.columns), name
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect()), name


def test_time_trend_by_sql(spark, tmp_path):
    """Against its SQL where moments are missing or prices aren't numbers; with moments in common, against the SQL ordered by
    execution, too, for any order of the rows."""
    import duckdb

    from tidelake import queries

    def trend(name, orders, sql):
        data = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string, o_orderpriority string")
        data.withColumn("o_orderdate", F.to_timestamp_ntz("day")).drop("day").coalesce(1).write.parquet(f"{tmp_path}/{name}/orders.parquet")
        con = duckdb.connect()
        con.execute(f"create view orders as select * from read_parquet('{tmp_path}/{name}/orders.parquet/*.parquet')")
        got = queries.QUERIES["ledger_processing_time_trend"](spark, f"{tmp_path}/{name}")
        return [sorted(str(tuple(x)) for x in found) for found in (got.collect(), con.execute(sql).fetchall())]

    sql = queries.SQL["ledger_processing_time_trend"]
    odd = [(1, 7, "O", 10.5, None, "a"), (2, 8, "O", 20.5, "2024-01-02 00:00:00", "a"), (3, 9, "O", 40.5, "2024-01-03 00:00:00", "a"), (4, None, "O", None, "2024-01-04 00:00:00", "a"), (5, 3, "O", float("nan"), "2024-01-01 00:00:00", "b"), (6, 3, None, 1e300, "2024-01-01 00:00:00", None)]
    alike = [(86400 * k + 5, k, "O", 1000.0 * k * k, "2024-01-01 00:00:00", "ab"[k % 2]) for k in range(9)]
    for name, orders, text in (("odd", odd, sql), ("alike", alike, sql.replace("BY started_at", "BY started_at, execution_id")), ("turned", alike[::-1], sql.replace("BY started_at", "BY started_at, execution_id"))):
        got, want = trend(name, orders, text)
        assert got == want
