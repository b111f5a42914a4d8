"""Ingestion, conformance, rules, drift and joins."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import expressions, temporal
from tidelake.functions.conform import MALFORMED, conform_types
from tidelake.functions.names import normalized, quoted
from tidelake.operators import joins, relational
from tidelake.plans import drift, rules
from tidelake.plans.contracts import CONTRACTS, Contract, contract
from tidelake.sources.readers import describe_source, normalized_schema, read, shifted_release


def test_conform(spark):
    rows = [("3.0", "1.5", "2024-01-02"), ("12.5", "abc", "2024-13-01"), (None, None, None), ("99999999999", " 7 ", "2024-01-02"), (" 7 ", "", "x")]
    df = spark.createDataFrame(rows, "i string, d string, dt string")
    got = conform_types(df, {"i": T.IntegerType(), "d": T.DoubleType(), "dt": T.DateType()}).collect()
    assert [r[MALFORMED] for r in got] == [None, "i=12.5; d=abc; dt=2024-13-01", None, "i=99999999999", "d=; dt=x"]
    assert [r.i for r in got] == [3, None, None, None, 7]
    wide = spark.createDataFrame([(2**40, 1.5), (5, 2.0)], "a bigint, b double")
    again = conform_types(wide, {"a": T.IntegerType(), "b": T.LongType()}).collect()
    assert [(r.a, r.b, r[MALFORMED]) for r in again] == [(None, None, f"a={2**40}; b=1.5"), (5, 2, None)]


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "w.csv").write_text("hour,day,month,year,Temp ,surprise\n1,2,3,2024,5.5,x\n2,2,3,2024,bad,y\n")
    declared = T.StructType([T.StructField(n, t) for n, t in (("Year", T.IntegerType()), ("month", T.IntegerType()), ("day", T.IntegerType()), ("hour", T.IntegerType()), ("temp", T.DoubleType()))])
    df = read(spark, f"{tmp_path}/w.csv", "csv", declared)
    got = df.orderBy("hour").collect()
    assert (got[0].year, got[0].hour, got[0].temp, got[0].surprise, got[0][MALFORMED]) == (2024, 1, 5.5, "x", None)
    assert got[1].temp is None and got[1][MALFORMED] == "temp=bad"
    assert dict(df.dtypes)["surprise"] == "string" and describe_source(df) == "w.csv"
    with pytest.raises(ValueError):
        read(spark, "x", "orc")
    assert normalized(" State Code") == "state_code" and quoted("a`b") == "`a``b`"
    assert normalized_schema(declared).names[0] == "year"


def test_time(spark):
    df = spark.createDataFrame([(2024, 3, 10, 2), (2024, 13, 1, 0), (None, 1, 1, 1)], "y int, m int, d int, h int")
    got = [r[0] for r in df.select(temporal.parts_timestamp(*[F.col(c) for c in "ymdh"])).collect()]
    assert got == [datetime(2024, 3, 10, 2), None, None]  # an hour that New York skipped
    ts = spark.createDataFrame([("2024-03-10 02:30:00",), ("bad",)], "t string").select(temporal.text_timestamp(F.col("t")).alias("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in ts.select(temporal.local_hour(F.col("t"))).collect()] == [datetime(2024, 3, 10, 2), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def line(spark):
    rows = [("a", 1, 2.0, 1), ("a", 1, 2.0, 1), (None, 1, 1.0, 1), ("c", -1, 1.0, 1), ("d", 1, 1.0, 9), ("e", 2, 900.0, 2)]
    return spark.createDataFrame(rows, "key string, passengers int, distance double, zone int")


RULES = [*rules.not_null("key"), rules.Unique(("key",)), rules.InRange("passengers", 0, 9), rules.InRange("distance", 0, 500, action=rules.WARN), rules.ReferenceExists("zone", "zones", "locationid"), rules.Check("gone", "nosuch > 1")]


def test_rules(spark):
    zones = spark.createDataFrame([(1,), (2,)], "locationid int")
    out = rules.validate(line(spark), RULES, rules.Context(references={"zones": zones}))
    assert (out.total, out.quarantined, out.dropped, out.warned) == (6, 4, 0, 1)
    assert {r.key for r in out.valid.collect()} == {"a", "e"}
    status = {c["name"]: (c["status"], c["failed"]) for c in out.checks}
    assert status["unique(key)"] == ("failed", 1) and status["in_range(distance,0,500)"] == ("warning", 1) and status["gone"][0] == "skipped"
    assert status["reference_exists(zone,zones)"] == ("failed", 1)
    assert {tuple(r._rejection_reasons) for r in out.rejected.collect()} == {("unique(key)",), ("not_null(key)",), ("in_range(passengers,0,9)",), ("reference_exists(zone,zones)",)}
    with pytest.raises(ValueError):
        rules.flag(line(spark), [*RULES, RULES[0]])


def test_rules_off(spark, monkeypatch):
    monkeypatch.setenv("PLATFORM_VALIDATION", "off")
    out = rules.validate(line(spark), RULES)
    assert (out.total, out.quarantined, out.checks) == (6, 0, [])


def test_unique_keeps_the_better_row(spark):
    df = spark.createDataFrame([("a", 0), ("a", 3)], "key string, passengers int")
    out = rules.validate(df, [rules.Unique(("key",)), rules.Positive("passengers")])
    assert [r.passengers for r in out.valid.collect()] == [3]


def test_drop_and_loaded(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), (None, 2)], "key string, n int")
    loaded = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    out = rules.validate(df, [rules.NotAlreadyLoaded(("key",)), rules.Positive("n")], rules.Context(loaded))
    assert (out.quarantined, out.dropped, [r.n for r in out.valid.collect()]) == (1, 1, [2])
    assert rules.validate(df, [rules.NotAlreadyLoaded(("key",))]).checks[0]["note"] == "first load"


def test_drift():
    s = lambda **kw: T.StructType([T.StructField(k, v) for k, v in kw.items()])
    found = drift.source_changes(["a", "x"], ["a", "b"], ["a", "b"])
    assert [(c.column, c.action) for c in found] == [("b", drift.REJECT), ("x", drift.DROP_COLUMN)]
    batch = s(a=T.LongType(), t=T.StringType(), n=T.IntegerType())
    target = s(a=T.DoubleType(), t=T.TimestampNTZType(), m=T.StringType())
    assert {c.column: c.action for c in drift.target_changes(batch, target)} == {"a": drift.CAST, "t": drift.REJECT, "n": drift.EVOLVE, "m": drift.FILL_NULL}


def test_contracts():
    assert len(CONTRACTS["trip_data"].rules) >= 19 and len(CONTRACTS["weather"].rules) == 16
    assert contract("other").rules == () and len(CONTRACTS["trip_data"].declared) == 20
    names = [r.name for r in CONTRACTS["weather"].all_rules(["timestamp"], ["timestamp", MALFORMED])]
    assert names[:4] == ["well_formed", "not_null(timestamp)", "unique(timestamp)", "not_already_loaded(timestamp)"]
    assert Contract("x").columns() == []


def test_joins_and_relational(spark):
    r = random.Random(1)
    left = [(k, r.choice([None, 1, 2, 3])) for k in range(30)]
    a = spark.createDataFrame(left, "k int, v int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, name string")
    got = joins.lookup(a, b, {"v": "id"}, "p_", ["name"]).collect()
    assert len(got) == 30 and all((x.p_name or None) == {1: "x", 2: "y"}.get(x.v) for x in got)
    assert joins.missing_reference(a, "v", b, "id", "bad").filter("bad").count() == sum(v == 3 for _, v in left)
    hours = spark.createDataFrame([("z", datetime(2024, 1, 1, h), h) for h in (0, 1, 3)], "z string, h timestamp_ntz, n int")
    assert [x.n_lag_1h for x in joins.lagged(hours, "z", "h", "n", (1,)).orderBy("h").collect()] == [None, 0, None]
    diff = joins.differences(a, a.withColumn("v", F.when(F.col("k") == 3, 99).otherwise(F.col("v"))), ["k"], ["v"])
    assert [x.a_k for x in diff.collect()] == [3]
    piv = relational.pivoted(spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 1.0)], "k int, n string, v double"), ["k"], "n", "v", {"first": ["a"], "second": ["b"], "third": ["c"]})
    assert sorted(map(tuple, piv.collect()), key=str) == [(1, 3.0, None, None), (2, None, 1.0, None)]
    assert expressions.month_predicate([(2024, 2), (2024, 1), (2023, 5)]) == "(year = 2023 AND month IN (5)) OR (year = 2024 AND month IN (1, 2))"
    assert expressions.month_predicate([]) == "FALSE"
    key = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert key.select(expressions.surrogate_key("x", "y", "z")).distinct().count() == 1
    assert key.select(expressions.surrogate_key("x", "y", "z", null_token="~")).distinct().count() == 2


def test_release_is_reproducible(spark):
    df = spark.createDataFrame([(k, datetime(2024, 1, 1 + k), float(k)) for k in range(20)], "k int, t timestamp_ntz, v double")
    one, two = (shifted_release(df, ["t"], 12, ["v"], 5, 0.2) for _ in range(2))
    assert one.exceptAll(two).count() == 0 and one.first().t.year == 2025 and one.count() >= 20


def test_exact_sum(spark):
    nan, inf = float("nan"), float("inf")
    cases = {"small": [1e-5] * 1000, "tiny": [1e-30] * 4, "large": [1e15, 1e15, 0.25], "huge": [1e300, 1e300], "mixed": [0.1] * 30, "nan": [1.0, nan], "inf": [inf, 1.0], "none": [None, None], "part": [None, 2.5], "many": [9e24] * 30}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double").repartition(7)
    got = {r.k: r.s for r in df.groupBy("k").agg(expressions.exact_sum(F.col("v")).alias("s")).collect()}
    assert got["mixed"] == 3.0 and got["none"] is None and got["part"] == 2.5 and got["small"] == 0.01 and got["large"] == 2e15 + 0.25
    assert got["nan"] != got["nan"] and got["inf"] == inf and abs(got["tiny"] / 4e-30 - 1) < 1e-12 and abs(got["huge"] / 2e300 - 1) < 1e-12 and abs(got["many"] / 2.7e26 - 1) < 1e-12
