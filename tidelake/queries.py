"""The query library over the driver's tables, with the same queries in DuckDB's SQL.

Order lines stand for trips with a place and a price (fact A), events for an hourly stream with a code (fact B).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import expressions as X
from tidelake.functions import temporal
from tidelake.functions.conform import MALFORMED, conform_types
from tidelake.operators import joins as J
from tidelake.operators import relational as R
from tidelake.plans import ledger, rules
from tidelake.plans.products import MIN_ZONE_TRIPS, PM25_BANDS, WEATHER_CATEGORIES
from tidelake.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {FACTS}\n{sql}"
        return f

    return add


def s(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def avg(x: str) -> str:
    return f"({s(x)} / nullif(count({x}), 0))"


# Written out, so that the oracle doesn't share the engine's constants.
_CASES = (
    "WHEN code IN (1, 2, 3) THEN 'Clear/Fair' WHEN code IN (4, 5) THEN 'Cloudy/Overcast' WHEN code IN (6, 7) THEN 'Fog' WHEN code IN (8, 9, 17, 18) THEN 'Rain' "
    "WHEN code IN (14, 15, 16, 19, 20) THEN 'Snow' WHEN code IN (21, 22, 23, 24, 25, 26, 27) THEN 'Storm'"
)
_BANDS = "WHEN v < 12 THEN 'Good' WHEN v < 35.4 THEN 'Moderate'"
_RULES = (
    "CASE WHEN l_quantity > 45 THEN 'in_range(l_quantity,1,45)' END", "CASE WHEN l_discount <= 0 THEN 'positive(l_discount)' END", "CASE WHEN NOT (l_returnflag IN ('A', 'N')) THEN 'allowed_values(l_returnflag)' END"
)
FACTS = f"""a AS (SELECT l.*, o_orderdate, o_custkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, c_nationkey, n_name AS zone, r_name AS borough
  FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
b0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 28 AS code, date_trunc('hour', ts) AS hour FROM events),
b AS (SELECT *, CASE {_CASES} ELSE 'Unknown' END AS category FROM b0),
f AS (SELECT *, list_filter([{_RULES[0]}, {_RULES[1]}], lambda x: x IS NOT NULL) AS q, list_filter([{_RULES[2]}], lambda x: x IS NOT NULL) AS w FROM lineitem)"""


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fact A from its sources. The optimizer sends whatever dimension proves small; nations and regions are lookups."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    fact = table(spark, d, "lineitem")
    out = fact.join(orders, fact.l_orderkey == orders.o_orderkey, "left").drop("o_orderkey")
    out = out.join(customers, out.o_custkey == customers.c_custkey, "left").drop("c_custkey")
    return J.lookup(out, places(spark, d), {"c_nationkey": "n_nationkey"}, columns=("zone", "borough")).withColumns(temporal.calendar(F.col("o_orderdate")))


def places(spark: SparkSession, d: str) -> DataFrame:
    return J.lookup(table(spark, d, "nation"), table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, columns=("r_name",)).withColumnsRenamed({"n_name": "zone", "r_name": "borough"})


_CURATED: dict[tuple[str, str], str] = {}


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Fact A as a curated table, partitioned by year and month: joined once for a session and data folder, like the
    integrated table that the loads keep, and read by all analyses."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CURATED:
        t = _scratch(spark, "lines")
        t.create(joined_lines(spark, d), ["year", "month"])
        _CURATED[key] = t.root
    from tidelake.sources.table import Table

    return Table(spark, _CURATED[key]).read()


def events(spark: SparkSession, d: str) -> DataFrame:
    """Fact B."""
    code = F.get_json_object("props", "$.k").try_cast("int") % 28
    df = table(spark, d, "events").withColumns({"code": code, "hour": temporal.local_hour(F.col("ts"))})
    return df.withColumn("category", X.category(F.col("code"), WEATHER_CATEGORIES))


def count(name: str) -> Column:
    return F.count("*").alias(name)


# analyses


@query(f"SELECT year, month, zone, borough, count(*) AS lines, {avg('l_extendedprice')} AS avg_price FROM a GROUP BY ALL")
def monthly_demand_per_zone(spark, d):
    return lines(spark, d).groupBy("year", "month", "zone", "borough").agg(count("lines"), X.exact_avg(F.col("l_extendedprice")).alias("avg_price"))


@query(f"SELECT category, count(*) AS n, {avg('value')} AS avg_value, round(stddev(value), 6) AS stddev_value FROM b WHERE code IS NOT NULL GROUP BY category")
def distance_by_condition(spark, d):
    return events(spark, d).filter("code is not null").groupBy("category").agg(count("n"), X.exact_avg(F.col("value")).alias("avg_value"), F.round(F.stddev("value"), 6).alias("stddev_value"))


def _hourly(spark, d):
    return events(spark, d).groupBy("hour").agg(X.exact_avg(F.col("value")).alias("context"), count("n"))


@query(f"SELECT hour, {avg('value')} AS context, count(*) AS n FROM b GROUP BY hour")
def hourly_context_vs_demand(spark, d):
    return _hourly(spark, d)


@query(f"SELECT round(corr(context, n), 6) AS r FROM (SELECT hour, {avg('value')} AS context, count(*) AS n FROM b GROUP BY hour)")
def context_demand_correlation(spark, d):
    return _hourly(spark, d).agg(F.round(F.corr("context", "n"), 6).alias("r"))


@query(f"SELECT band, count(*) AS n, {avg('value')} AS avg_value FROM (SELECT value, CASE {_BANDS.replace('v <', 'value <')} ELSE 'Unhealthy' END AS band FROM b) GROUP BY band")
def demand_by_band(spark, d):
    return events(spark, d).groupBy(X.band(F.col("value"), PM25_BANDS, "Unhealthy").alias("band")).agg(count("n"), X.exact_avg(F.col("value")).alias("avg_value"))


@query("""SELECT event_type, sum(n)::BIGINT AS total, round(stddev(n), 6) AS stddev_n, round(stddev(n) / nullif(avg(n), 0), 6) AS variation
FROM (SELECT event_type, category, count(*) AS n FROM b GROUP BY ALL) GROUP BY event_type HAVING sum(n) >= 500 AND count(*) >= 2""")
def zone_condition_variation(spark, d):
    by = events(spark, d).groupBy("event_type", "category").agg(count("n")).groupBy("event_type")
    out = by.agg(F.sum("n").alias("total"), F.round(F.stddev("n"), 6).alias("stddev_n"), F.round(X.safe_ratio(F.stddev("n"), F.avg("n")), 6).alias("variation"), count("k"))
    return out.filter(f"total >= {MIN_ZONE_TRIPS} and k >= 2").drop("k")


_GRID = "SELECT dayname(ts) AS weekday, hour(ts)::INT AS h, count(*) AS n FROM b GROUP BY ALL"


@query(_GRID)
def hourly_counts_per_weekday(spark, d):
    return events(spark, d).groupBy(F.date_format("ts", "EEEE").alias("weekday"), F.hour("ts").alias("h")).agg(count("n"))


@query(f"SELECT weekday, h, n FROM (SELECT *, rank() OVER (PARTITION BY weekday ORDER BY n DESC) AS r FROM ({_GRID})) WHERE r = 1")
def peak_hour_per_weekday(spark, d):
    return R.top_ranked(hourly_counts_per_weekday(spark, d), ["weekday"], "n")


_TREND = f"SELECT year, month, count(*) AS n, {s('l_extendedprice')} AS revenue FROM a GROUP BY ALL"


@query(f"SELECT *, lag(n) OVER o AS previous_n, n - lag(n) OVER o AS change, 100.0::DOUBLE * (n - lag(n) OVER o) / nullif(lag(n) OVER o, 0) AS change_percent FROM ({_TREND}) WINDOW o AS (ORDER BY year, month)")
def monthly_trend(spark, d):
    by = lines(spark, d).groupBy("year", "month").agg(count("n"), X.exact_sum(F.col("l_extendedprice")).alias("revenue"))
    return R.change(by, ["year", "month"], "n")


def _by_place(df: DataFrame, spark: SparkSession, d: str, **measures: Column) -> DataFrame:
    """Measures by nation, then the nation's region: the lookup meets a few rows, not the fact's."""
    by = df.groupBy("c_nationkey").agg(*measures.values())
    return J.lookup(by, places(spark, d), {"c_nationkey": "n_nationkey"}, columns=("zone", "borough"))


@query("SELECT borough, count(*) AS lines FROM a GROUP BY borough")
def lines_per_region(spark, d):
    return _by_place(lines(spark, d), spark, d, n=count("n")).groupBy("borough").agg(F.sum("n").alias("lines"))


@query(f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, sum(CAST(epoch(l_shipdate) AS BIGINT) - CAST(epoch(o_orderdate) AS BIGINT))::DOUBLE / nullif(count(l_shipdate), 0) / 60 AS avg_minutes FROM a WHERE o_orderdate IS NOT NULL GROUP BY 1")
def avg_shipping_minutes_per_day(spark, d):
    # Whole seconds add up exactly.
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    by = lines(spark, d).filter("o_orderdate is not null").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(seconds).cast("double").alias("s"), F.count("l_shipdate").alias("n"))
    return by.select(F.col("day").cast("string").alias("day"), (X.safe_ratio(F.col("s"), F.col("n")) / 60).alias("avg_minutes"))


@query(f"SELECT borough, {avg('l_extendedprice')} AS avg_price FROM a GROUP BY borough")
def avg_price_per_region(spark, d):
    by = _by_place(lines(spark, d), spark, d, s=X.exact_sum(F.col("l_extendedprice")).alias("s"), n=F.count("l_extendedprice").alias("n"))
    return by.groupBy("borough").agg(X.safe_ratio(X.exact_sum(F.col("s")), F.sum("n")).alias("avg_price"))


@query("SELECT zone, borough, count(*) AS n FROM a WHERE l_extendedprice > 50000 AND zone IS NOT NULL GROUP BY ALL")
def expensive_lines_by_region(spark, d):
    return lines(spark, d).filter((F.col("l_extendedprice") > 50000) & F.col("zone").isNotNull()).groupBy("zone", "borough").agg(count("n"))


@query("""SELECT year, month, count(*) AS n FROM a WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY ALL""")
def partition_filtered_count(spark, d):
    from datetime import datetime

    period = temporal.between_months(datetime(1996, 3, 1), datetime(1996, 7, 1), "o_orderdate")
    return lines(spark, d).filter(period).groupBy("year", "month").agg(count("n"))


# enrichment and joins

@query(f"""SELECT e.event_id, e.hour, p.first_avg, p.second_avg FROM b e LEFT JOIN (SELECT hour, {avg("CASE WHEN code < 14 THEN value END")} AS first_avg, {avg("CASE WHEN code >= 14 THEN value END")} AS second_avg FROM b GROUP BY hour) p ON e.hour = p.hour""")
def enrich_hourly_pivot(spark, d):
    df = events(spark, d)
    half = F.when(F.col("code") < 14, "first").when(F.col("code") >= 14, "second")
    context = df.withColumn("half", half).groupBy("hour").agg(*[X.exact_avg(F.when(F.col("half") == n, F.col("value"))).alias(f"{n}_avg") for n in ("first", "second")])
    return J.enriched(df, "hour", context, "hour", ["first_avg", "second_avg"]).select("event_id", "hour", "first_avg", "second_avg")


@query("SELECT o_orderkey, o_custkey % 2000 AS k, NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 2000) AS lacking FROM orders")
def reference_check(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("k"))
    return J.missing_reference(orders, "k", table(spark, d, "customer"), "c_custkey", "lacking")


@query("SELECT o_orderkey, o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS loaded FROM orders")
def not_already_loaded(spark, d):
    orders = table(spark, d, "orders")
    return J.marked(orders.select("o_orderkey"), orders.filter("o_orderstatus = 'F'"), ["o_orderkey"], "loaded")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def insert_only_merge(spark, d):
    orders = table(spark, d, "orders")
    return J.not_loaded(orders, orders.filter("o_orderstatus = 'F'"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey AS key, n, m FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber > 1) AS m FROM lineitem GROUP BY ALL) WHERE n <> m""")
def verify_diff(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    full = df.groupBy("key").agg(count("n"))
    part = df.groupBy("key").agg(F.count_if(F.col("l_linenumber") > 1).alias("n"))
    return J.differences(full, part, ["key"], ["n"]).select(F.coalesce("a_key", "b_key").alias("key"), F.col("a_n").alias("n"), F.col("b_n").alias("m"))


# products


@query(f"""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, dayname(o_orderdate) AS weekday, year, month, count(*) AS trips, {s('l_extendedprice')} AS revenue, {avg('l_quantity')} AS avg_quantity FROM a GROUP BY ALL""")
def daily_summary(spark, d):
    by = lines(spark, d).groupBy(F.to_date("o_orderdate").cast("string").alias("day"), F.date_format("o_orderdate", "EEEE").alias("weekday"), "year", "month")
    return by.agg(count("trips"), X.exact_sum(F.col("l_extendedprice")).alias("revenue"), X.exact_avg(F.col("l_quantity")).alias("avg_quantity"))


@query("""SELECT *, rank() OVER (PARTITION BY year, month ORDER BY trips DESC)::INT AS zone_rank, trips::DOUBLE / (sum(trips) OVER (PARTITION BY year, month))::DOUBLE AS share
FROM (SELECT year, month, zone, borough, count(*) AS trips FROM a WHERE zone IS NOT NULL GROUP BY ALL)""")
def zone_statistics(spark, d):
    by = lines(spark, d).filter("zone is not null").groupBy("year", "month", "zone", "borough").agg(count("trips"))
    return R.share_of_total(R.ranked(by, ["year", "month"], "trips", "zone_rank"), ["year", "month"], "trips", "share")


_IMPACT = f"SELECT year(ts)::INT AS year, month(ts)::INT AS month, category, event_type, count(*) AS trips, {s('value')} AS sum_value, {s('value * value')} AS sum_value2 FROM b WHERE category <> 'Unknown' GROUP BY ALL"


@query(_IMPACT)
def condition_impact_monthly(spark, d):
    v = F.col("value")
    by = events(spark, d).filter("category <> 'Unknown'").groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), "category", "event_type")
    return by.agg(count("trips"), X.exact_sum(v).alias("sum_value"), X.exact_sum(v * v, 4).alias("sum_value2"))  # of values with two decimals


@query(f"""SELECT category, n AS trips, t / n AS avg_value, CASE WHEN n > 1 THEN sqrt(greatest(q - t * t / n, 0) / (n - 1)) END AS stddev_value
FROM (SELECT category, sum(trips)::BIGINT AS n, {s('sum_value')} AS t, {s('sum_value2')} AS q FROM ({_IMPACT}) GROUP BY category)""")
def condition_impact_rollup(spark, d):
    sums = condition_impact_monthly(spark, d).groupBy("category").agg(F.sum("trips").alias("trips"), X.exact_sum(F.col("sum_value")).alias("t"), X.exact_sum(F.col("sum_value2")).alias("q"))
    return sums.select("category", "trips", X.safe_ratio(F.col("t"), F.col("trips")).alias("avg_value"), X.sample_stddev(F.col("trips"), F.col("t"), F.col("q")).alias("stddev_value"))


@query(f"SELECT hour, n, v, CASE {_BANDS} ELSE 'Unhealthy' END AS band FROM (SELECT hour, count(*) AS n, {avg('value')} AS v FROM b GROUP BY hour)")
def hourly_impact_summary(spark, d):
    by = events(spark, d).groupBy("hour").agg(count("n"), X.exact_avg(F.col("value")).alias("v"))
    return by.withColumn("band", X.band(F.col("v"), PM25_BANDS, "Unhealthy"))


_PROFILE = f"SELECT year, month, borough, (dayofweek(o_orderdate) + 1)::INT AS weekday, count(*) AS trips, {s('l_extendedprice')} AS sum_price FROM a WHERE borough IS NOT NULL GROUP BY ALL"


@query(_PROFILE)
def region_profile_monthly(spark, d):
    by = lines(spark, d).filter("borough is not null").groupBy("year", "month", "borough", F.dayofweek("o_orderdate").alias("weekday"))
    return by.agg(count("trips"), X.exact_sum(F.col("l_extendedprice")).alias("sum_price"))


@query(f"SELECT borough, weekday, sum(trips)::BIGINT AS trips, {s('sum_price')} / sum(trips)::BIGINT AS avg_price FROM ({_PROFILE}) GROUP BY ALL")
def region_profile_rollup(spark, d):
    return region_profile_monthly(spark, d).groupBy("borough", "weekday").agg(F.sum("trips").alias("trips"), X.safe_ratio(X.exact_sum(F.col("sum_price")), F.sum("trips")).alias("avg_price"))


@query("SELECT year, month, count(*) AS rows FROM a WHERE year IS NOT NULL GROUP BY ALL HAVING count(*) >= 500")
def reporting_window(spark, d):
    from tidelake.plans.products import reporting_window as window

    return window(lines(spark, d), 500)


# keys, rules, validation


@query("SELECT md5(concat_ws('||', l_orderkey, l_linenumber, l_returnflag)) AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def surrogate_key_dedupe(spark, d):
    return table(spark, d, "lineitem").groupBy(X.surrogate_key("l_orderkey", "l_linenumber", "l_returnflag").alias("key")).agg(count("n")).filter("n > 1")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_quantity > 45)::INT, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def unique_keep_best(spark, d):
    order = [(F.col("l_quantity") > 45).cast("int"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return R.first_per(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], *order).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def repeated_keys(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.repeated(df, ["l_orderkey", "l_linenumber"]).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")))


LINE_RULES = [rules.InRange("l_quantity", 1, 45), rules.Positive("l_discount"), rules.AllowedValues("l_returnflag", ("A", "N"), action=rules.WARN)]


def _flagged(spark, d):
    return rules.flag(table(spark, d, "lineitem"), LINE_RULES)[0]


@query("""SELECT count(*) AS total, count(*) FILTER (len(q) > 0) AS quarantined, 0::BIGINT AS dropped, count(*) FILTER (len(q) = 0 AND len(w) > 0) AS warned,
count(*) FILTER (list_contains(q, 'in_range(l_quantity,1,45)')) AS failed_0, count(*) FILTER (list_contains(q, 'positive(l_discount)')) AS failed_1, count(*) FILTER (len(w) > 0) AS failed_2 FROM f""")
def rule_violation_counts(spark, d):
    return rules.counts(_flagged(spark, d), LINE_RULES)


@query("SELECT reason, count(*) AS rows FROM (SELECT unnest(q) AS reason FROM f) GROUP BY reason")
def rule_reasons_exploded(spark, d):
    return rules.reasons_counted(_flagged(spark, d), rules.REASONS[rules.QUARANTINE])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM f WHERE len(q) = 0")
def valid_rows(spark, d):
    return _flagged(spark, d).filter(F.size(rules.REASONS[rules.QUARANTINE]) == 0).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, array_to_string(q, '; ') AS reasons FROM f WHERE len(q) > 0")
def quarantined_rows(spark, d):
    out = _flagged(spark, d).filter(F.size(rules.REASONS[rules.QUARANTINE]) > 0)
    return out.select("l_orderkey", "l_linenumber", F.array_join(rules.REASONS[rules.QUARANTINE], "; ").alias("reasons"))


@query("SELECT l_orderkey, l_linenumber FROM f WHERE len(list_filter(q, lambda x: x <> 'positive(l_discount)')) = 0 AND len(q) > 0")
def trusted_rejections(spark, d):
    q = F.col(rules.REASONS[rules.QUARANTINE])
    return _flagged(spark, d).filter(X.allowed_only(q, ["positive(l_discount)"]) & (F.size(q) > 0)).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_id::INT END AS i, CASE WHEN event_id % 3 = 2 THEN 'i=' || event_id || '.5' END AS malformed FROM events""")
def conformed_types(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 1, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 3 == 2, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("i"))
    return conform_types(e, {"i": T.IntegerType()}).withColumnRenamed(MALFORMED, "malformed")


@query()
def schema_drift_report(spark, d):
    from tidelake.plans import drift

    orders = table(spark, d, "orders").schema
    batch = T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("o_totalprice", T.LongType()), T.StructField("o_channel", T.StringType())])
    return drift.report(spark, drift.source_changes([f.name for f in batch], [f.name for f in orders], ["o_orderdate"]) + drift.target_changes(batch, orders))


# windows


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    return R.first_per(table(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark, d):
    return R.first_per(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


_DAILY = "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL"


@query(f"SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS average FROM ({_DAILY})")
def moving_average_3(spark, d):
    by = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(count("n"))
    return R.moving_average(by, ["event_type"], ["day"], "n", 3, "average")


@query(f"SELECT *, lag(n) OVER o AS previous_n, n - lag(n) OVER o AS change, 100.0::DOUBLE * (n - lag(n) OVER o) / nullif(lag(n) OVER o, 0) AS change_percent FROM ({_DAILY}) WINDOW o AS (PARTITION BY event_type ORDER BY day)")
def change_vs_previous(spark, d):
    by = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(count("n"))
    return R.change(by, ["day"], "n", ["event_type"])


@query("SELECT o_orderpriority, min_by(o_orderkey, o_orderkey) AS first_key, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def min_by_first_seen(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_key"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT zone, count(*) FILTER (l_returnflag = 'R')::DOUBLE / nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS ratio FROM a GROUP BY zone")
def safe_ratio(spark, d):
    return lines(spark, d).groupBy("zone").agg(X.safe_ratio(F.count_if(F.col("l_returnflag") == "R").cast("double"), F.count_if(F.col("l_linestatus") == "O")).alias("ratio"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, d):
    return R.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT 'customer' AS side, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier")
def stacked_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return R.stacked(c, table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation")))


# training data

_HOURS = "SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS hour"
_CELLS = f"""SELECT g.hour, g.event_type, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT * FROM ({_HOURS}), (SELECT DISTINCT event_type FROM events)) g
LEFT JOIN (SELECT hour, event_type, count(*) AS n FROM b GROUP BY ALL) c ON c.hour = g.hour AND c.event_type = g.event_type"""


def _cells(spark, d):
    df = events(spark, d)
    hours = spark.range(30 * 24).select((temporal.ntz("2024-01-01 00:00:00") + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("hour"))
    counts = df.groupBy("hour", "event_type").agg(count("n"))
    return J.zero_filled(J.grid(hours, df.select("event_type").distinct()), counts, ["hour", "event_type"], "n")


@query(_CELLS)
def zone_hour_grid(spark, d):
    return _cells(spark, d)


_SPLIT = "CASE WHEN hour < TIMESTAMP '2024-01-17' THEN 'train' WHEN hour < TIMESTAMP '2024-01-24' THEN 'validation' ELSE 'test' END"
_LAGGED = f"""SELECT c.*, p.n AS n_lag_1h, q.n AS n_lag_24h, {_SPLIT.replace('hour', 'c.hour')} AS split FROM ({_CELLS}) c
LEFT JOIN ({_CELLS}) p ON p.event_type = c.event_type AND p.hour = c.hour - INTERVAL 1 HOUR LEFT JOIN ({_CELLS}) q ON q.event_type = c.event_type AND q.hour = c.hour - INTERVAL 24 HOUR"""


@query(_LAGGED)
def training_dataset(spark, d):
    return J.lagged(_cells(spark, d), "event_type", "hour", "n", (1, 24)).withColumn("split", temporal.split_label(F.col("hour"), "2024-01-17 00:00:00", "2024-01-24 00:00:00"))


@query(f"SELECT split, count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour, sum(n)::BIGINT AS total, avg(n) AS mean, avg((n = 0)::INT::DOUBLE) AS zero_share, avg((n_lag_24h IS NULL)::INT::DOUBLE) AS null_lag FROM ({_LAGGED}) GROUP BY split")
def split_summary(spark, d):
    return training_dataset(spark, d).groupBy("split").agg(
        count("rows"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.avg((F.col("n") == 0).cast("double")).alias("zero_share"), X.null_share("n_lag_24h").alias("null_lag")
    )


@query("""SELECT round((b - t * t / n) / (q - t * t / n), 6) AS eta_squared FROM (SELECT sum(c) AS n, sum(t) AS t, sum(q) AS q, sum(t * t / c) AS b
FROM (SELECT l_returnflag, count(*) AS c, sum(l_quantity) AS t, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1))""")
def eta_squared(spark, d):
    return R.eta_squared(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select(F.round("eta_squared", 6).alias("eta_squared"))


@query("""SELECT round(1 - sum(pow(l_quantity - m, 2)) / sum(pow(l_quantity - g, 2)), 6) AS r_squared
FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m, avg(l_quantity) OVER () AS g FROM lineitem)""")
def group_mean_r2(spark, d):
    df = R.group_mean(table(spark, d, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", "mean")
    return R.r_squared(df, "l_quantity", "mean").select(F.round("r_squared", 6).alias("r_squared"))


@query("""SELECT 'l_quantity' AS feature, 0.0::DOUBLE AS null_share, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem
UNION ALL SELECT 'l_tax', avg((nullif(l_tax, 0) IS NULL)::INT::DOUBLE), min(nullif(l_tax, 0)), max(nullif(l_tax, 0)) FROM lineitem""")
def feature_profile(spark, d):
    return R.profile(table(spark, d, "lineitem").select("l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("l_tax")), ["l_quantity", "l_tax"])


@query()
def feature_vectors(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from tidelake.plans import ml

    config = ml.FeatureConfig(numeric=("n_lag_1h",), skewed=("n_lag_24h",), categorical=("event_type",), target="n")
    df = training_dataset(spark, d).withColumnRenamed("hour", "pickup_hour")
    train = df.filter("split = 'train'")
    model = Pipeline(stages=ml.feature_stages(ml.plan_features(train, config), config)).fit(train)
    return model.transform(df).select("pickup_hour", "event_type", "split", vector_to_array("features").alias("features"))


# versioned tables and ledgers


def _scratch(spark: SparkSession, name: str):
    import uuid

    from tidelake.session import shared_folder
    from tidelake.sources.table import Table

    return Table(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


_YEARS = "year(o_orderdate)::INT"


@query(f"SELECT {_YEARS} AS year, count(*) AS n, {s('CASE WHEN ' + _YEARS + ' = 1996 THEN 2 * o_totalprice ELSE o_totalprice END')} AS total FROM orders GROUP BY 1")
def replace_partition(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    t = _scratch(spark, "replace")
    t.create(orders, ["year"])
    t.replace(orders.filter("year = 1996").withColumn("o_totalprice", 2 * F.col("o_totalprice")), {(1996,)})
    return t.read().groupBy("year").agg(count("n"), X.exact_sum(F.col("o_totalprice")).alias("total"))


@query(f"SELECT {_YEARS} AS year, count(*) FILTER (o_orderstatus = 'F') AS before, count(*) AS after FROM orders GROUP BY 1")
def time_travel_diff(spark, d):
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    t = _scratch(spark, "travel")
    t.create(orders.filter("o_orderstatus = 'F'"), ["year"])
    t.insert_new(orders, ["o_orderkey"])
    before = t.read(0).groupBy("year").agg(count("before"))
    return t.read().groupBy("year").agg(count("after")).join(before, "year", "left").withColumn("before", F.coalesce("before", F.lit(0)))


def _ledger(spark, d):
    """A ledger derived from orders: one execution each, so that its queries have an oracle."""
    o, k, price = table(spark, d, "orders"), F.col("o_custkey"), F.col("o_totalprice")
    return o.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").cast("string").alias("execution_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "rejected").otherwise("succeeded").alias("status"),
        # Moments that repeat only where date and key's remainder do.
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("started_at"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("pipeline"),
        # Spark's floor is a long, which holds neither NaN nor what lies beyond; doubles from 2**53 on are whole.
        F.when(F.abs(price) < 2.0**53, F.floor(price).cast("double")).otherwise(price).alias("execution_time_seconds"), (k % 5).cast("double").alias("validate_seconds"), (k % 3).cast("double").alias("write_seconds"),
        (k * 100).alias("processed_records"), (k % 7).alias("rejected_records"), (k % 4).alias("quarantined_records"), (k % 7 - k % 4).alias("dropped_records"), (k % 2).alias("warning_records"), (k * 90).alias("inserted_records"),
        (k % 3).cast("int").alias("validation_failures"), (k % 3 + 1).cast("int").alias("schema_version"), F.concat(F.lit("c"), (F.col("o_orderkey") % 11).cast("string")).alias("schema_changes"), (F.col("o_orderkey") % 13).alias("target_version"),
        F.lit(None).cast("string").alias("error_message"),
    )


_LEDGER = """(SELECT o_orderpriority AS dataset, o_orderkey::VARCHAR AS execution_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'rejected' ELSE 'succeeded' END AS status,
o_orderdate + to_seconds(o_orderkey % 86400) AS started_at, 'p' || (o_custkey % 2) AS pipeline, floor(o_totalprice) AS execution_time_seconds, (o_custkey % 5)::DOUBLE AS validate_seconds, (o_custkey % 3)::DOUBLE AS write_seconds,
o_custkey * 100 AS processed_records, o_custkey % 7 AS rejected_records, o_custkey % 4 AS quarantined_records, o_custkey % 7 - o_custkey % 4 AS dropped_records, o_custkey % 2 AS warning_records, o_custkey * 90 AS inserted_records,
(o_custkey % 3)::INT AS validation_failures, (o_custkey % 3 + 1)::INT AS schema_version, 'c' || (o_orderkey % 11) AS schema_changes, o_orderkey % 13 AS target_version, NULL::VARCHAR AS error_message FROM orders) e"""


@query(f"""SELECT dataset, count(*) AS executions, sum((validation_failures > 0)::INT)::BIGINT AS executions_with_failures, sum(validation_failures)::BIGINT AS failed_checks, sum(rejected_records)::BIGINT AS rejected_records,
round(100.0::DOUBLE * sum(rejected_records)::DOUBLE / nullif(sum(processed_records), 0)::DOUBLE, 3) AS pct_records_rejected FROM {_LEDGER} GROUP BY 1""")
def ledger_failing_datasets(spark, d):
    return ledger.failing_datasets(_ledger(spark, d))


@query(f"""SELECT dataset, count(*) AS executions, round(avg(execution_time_seconds), 2) AS avg_seconds, round(max(execution_time_seconds), 2) AS max_seconds, round(sum(execution_time_seconds), 2) AS total_seconds,
round(avg(validate_seconds), 2) AS avg_validate_seconds, round(avg(write_seconds), 2) AS avg_write_seconds, round(sum(processed_records)::DOUBLE / nullif(sum(execution_time_seconds), 0)) AS records_per_second FROM {_LEDGER} WHERE status = 'succeeded' GROUP BY 1""")
def ledger_slowest_datasets(spark, d):
    return ledger.slowest_datasets(_ledger(spark, d))


@query(f"""SELECT started_at, pipeline, dataset, status, processed_records, rejected_records, quarantined_records, dropped_records, warning_records,
round(100.0::DOUBLE * rejected_records::DOUBLE / nullif(processed_records, 0)::DOUBLE, 3) AS pct_rejected, inserted_records FROM {_LEDGER}""")
def ledger_rejections_per_execution(spark, d):
    return ledger.rejections_per_execution(_ledger(spark, d))


@query(f"""SELECT dataset, started_at, pipeline, processed_records, execution_time_seconds, round(execution_time_seconds - lag(execution_time_seconds) OVER o, 2) AS change_vs_previous,
round(avg(execution_time_seconds) OVER (PARTITION BY dataset ORDER BY started_at ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg_3, round(processed_records::DOUBLE / nullif(execution_time_seconds, 0)) AS records_per_second
FROM {_LEDGER} WHERE status = 'succeeded' WINDOW o AS (PARTITION BY dataset ORDER BY started_at)""")
def ledger_processing_time_trend(spark, d):
    return ledger.processing_time_trend(_ledger(spark, d))


@query(f"SELECT dataset, schema_version, min(started_at) AS first_seen, max(started_at) AS last_seen, count(*) AS executions, arg_min(schema_changes, started_at) AS changes_when_introduced FROM {_LEDGER} GROUP BY 1, 2")
def ledger_schema_history(spark, d):
    return ledger.schema_history(_ledger(spark, d))


@query(f"""SELECT dataset, started_at, pipeline, status, schema_version, processed_records, inserted_records, rejected_records, validation_failures, execution_time_seconds, target_version, error_message
FROM {_LEDGER} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY started_at DESC, execution_id DESC) = 1""")
def ledger_latest_status(spark, d):
    return ledger.latest_status(_ledger(spark, d))


def _results(spark, d):
    """Check results derived from the same."""
    return _ledger(spark, d).select(
        "execution_id", "dataset", F.when(F.col("quarantined_records") < 2, "low").otherwise("high").alias("rule_name"), F.lit("invalid_value").alias("category"), F.lit("quarantine").alias("action"),
        F.when(F.col("status") == "failed", "failed").otherwise("passed").alias("status"), F.nullif("rejected_records", F.lit(0)).alias("failed_records"), F.col("processed_records").alias("checked_records"), F.lit(None).cast("string").alias("details"),
    )


_RESULTS = f"""(SELECT execution_id, dataset, CASE WHEN quarantined_records < 2 THEN 'low' ELSE 'high' END AS rule_name, 'invalid_value' AS category, 'quarantine' AS action, CASE WHEN status = 'failed' THEN 'failed' ELSE 'passed' END AS status,
nullif(rejected_records, 0) AS failed_records, processed_records AS checked_records, NULL::VARCHAR AS details, started_at FROM {_LEDGER})"""


@query(f"""SELECT dataset, rule_name, category, action, count(*) AS executions_failed, sum(coalesce(failed_records, 0))::BIGINT AS failed_records FROM {_RESULTS} WHERE status IN ('failed', 'warning')
GROUP BY ALL ORDER BY executions_failed DESC, failed_records DESC, dataset, rule_name LIMIT 25""")
def ledger_failing_rules(spark, d):
    return ledger.failing_rules(_results(spark, d))


@query(f"""SELECT * EXCLUDE (execution_id, started_at) FROM {_RESULTS} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY started_at DESC, execution_id DESC) = 1""".replace("SELECT * EXCLUDE", "SELECT * FROM (SELECT * EXCLUDE", 1) + ") WHERE status <> 'passed'")
def ledger_latest_results(spark, d):
    return ledger.latest_results(_ledger(spark, d), _results(spark, d))


@query(f"SELECT dataset, category, sum((status IN ('failed', 'warning'))::INT)::BIGINT AS checks_with_findings, sum(coalesce(failed_records, 0))::BIGINT AS records_flagged FROM {_RESULTS} GROUP BY 1, 2 HAVING checks_with_findings > 0")
def ledger_category_totals(spark, d):
    return ledger.category_totals(_results(spark, d))


# the products as they are, over order lines that play trips


def trips(spark: SparkSession, d: str) -> DataFrame:
    """Order lines under the names that the products read; prices and quantities stand for amounts and distances."""
    df = lines(spark, d)
    number = lambda c: F.col(c).cast("double")
    return df.select(
        F.col("o_orderdate").alias("tpep_pickup_datetime"), temporal.local_hour(F.col("o_orderdate")).alias("pickup_hour"), F.col("l_quantity").alias("trip_distance"), F.col("l_extendedprice").alias("total_amount"),
        F.col("l_extendedprice").alias("fare_amount"), F.col("l_linenumber").alias("passenger_count"), (F.col("l_suppkey") % 40).cast("double").alias("temp"), number("l_linenumber").alias("prcp"),
        F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 50).cast("double")).alias("pm25"), (F.col("l_partkey") % 29).cast("int").alias("coco"), F.col("zone").alias("pickup_zone"), F.col("borough").alias("pickup_borough"),
        (F.col("l_suppkey") % 100).cast("double").alias("humidity"), "year", "month",
    )


# Values have two decimals at most, so that sums of these decimals are exact and each average is rounded from the same double.
def _sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def _mean(x: str, places: int) -> str:
    # Half up by the digits that the double shows, which is Spark's rule for doubles.
    return f"CAST(round(CAST(CAST({_sum(x)} / nullif(count({x}), 0)::DOUBLE AS VARCHAR) AS DECIMAL(38,16)), {places}) AS DOUBLE)"


_TRIPS = """(SELECT o_orderdate AS ts, date_trunc('hour', o_orderdate) AS pickup_hour, l_quantity AS dist, l_extendedprice AS amount, l_linenumber::DOUBLE AS people, (l_suppkey % 40)::DOUBLE AS temp, l_linenumber::DOUBLE AS prcp,
CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 50)::DOUBLE END AS pm25, l_partkey % 29 AS code, zone AS pickup_zone, borough AS pickup_borough, (l_suppkey % 100)::DOUBLE AS humidity, year, month FROM a) t"""
_BASIC = f"count(*) AS trip_count, round({_sum('dist')}, 2) AS total_distance_miles"


def _product(name: str):
    def build(spark, d):
        from tidelake.plans.products import PRODUCTS

        product, df = PRODUCTS[name], trips(spark, d)
        return product.build(df.withColumns({c: F.lit(None).cast("double") for c in product.optional if c not in df.columns}))

    build.__name__ = f"product_{name}"
    return build


query(f"""SELECT ts::DATE AS service_date, dayname(ts) AS day_of_week, {_BASIC}, round({_sum('amount')}, 2) AS total_revenue, {_mean('dist', 3)} AS avg_trip_distance, {_mean('amount', 2)} AS avg_trip_revenue, {_mean('people', 2)} AS avg_passengers,
{_mean('temp', 1)} AS avg_temp_c, {_mean('prcp', 2)} AS avg_precip_mm, {_mean('pm25', 1)} AS avg_pm25, {_mean('humidity', 1)} AS avg_humidity, year, month FROM {_TRIPS} GROUP BY 1, 2, year, month""")(_product("daily_mobility_summary"))
query(f"""SELECT *, rank() OVER (PARTITION BY year, month ORDER BY trip_count DESC)::INT AS demand_rank, round(100 * (trip_count::DOUBLE / sum(trip_count) OVER (PARTITION BY year, month)::DOUBLE), 3) AS pct_of_monthly_trips
FROM (SELECT year, month, pickup_zone, pickup_borough, {_BASIC}, round({_sum('amount')}, 2) AS total_revenue, {_mean('dist', 3)} AS avg_trip_distance, {_mean('amount', 2)} AS avg_fare FROM {_TRIPS} WHERE pickup_zone IS NOT NULL GROUP BY 1, 2, 3, 4)""")(_product("taxi_zone_statistics"))
_WEATHER = f"""SELECT year, month, CASE {_CASES} ELSE 'Unknown' END AS weather_category, pickup_zone, pickup_borough, {_BASIC}, round({_sum('amount')}, 2) AS total_revenue, {_mean('dist', 3)} AS avg_trip_distance,
round(stddev(dist), 3) AS stddev_trip_distance, {_sum('dist')} AS sum_distance, {_sum('dist * dist')} AS sum_sq_distance, {_sum('amount')} AS sum_revenue FROM {_TRIPS} WHERE weather_category <> 'Unknown' AND pickup_zone IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""
query(_WEATHER)(_product("weather_impact_summary"))
query(f"""SELECT pickup_hour, round(level, 2) AS pm25, CASE WHEN level < 12 THEN 'Good' WHEN level < 35.4 THEN 'Moderate' ELSE 'Unhealthy' END AS aqi_band, trip_count, total_distance_miles, avg_trip_distance, NULL::DOUBLE AS avg_aqi, year, month
FROM (SELECT pickup_hour, {_sum('pm25')} / count(pm25)::DOUBLE AS level, {_BASIC}, {_mean('dist', 3)} AS avg_trip_distance, year, month FROM {_TRIPS} WHERE pm25 IS NOT NULL GROUP BY pickup_hour, year, month)""")(_product("air_quality_impact_summary"))
_BOROUGH = f"""SELECT year, month, pickup_borough, dayname(ts) AS day_of_week, (dayofweek(ts) + 1)::INT AS day_of_week_num, hour(ts)::INT AS hour_of_day, {_BASIC}, round({_sum('amount')}, 2) AS total_revenue, {_mean('dist', 3)} AS avg_trip_distance,
{_sum('dist')} AS sum_distance, {_sum('amount')} AS sum_revenue FROM {_TRIPS} WHERE pickup_borough IS NOT NULL GROUP BY ALL"""
query(_BOROUGH)(_product("borough_mobility_summary"))
_ALL = f"sum(trip_count)::BIGINT AS trip_count, round({_sum('sum_distance')}, 2) AS total_distance_miles, round({_sum('sum_revenue')}, 2) AS total_revenue, round({_sum('sum_distance')} / sum(trip_count)::DOUBLE, 3) AS avg_trip_distance"


@query(f"""SELECT weather_category, pickup_zone, pickup_borough, {_ALL}, round(CASE WHEN sum(trip_count) > 1 THEN sqrt(greatest({_sum('sum_sq_distance')} - {_sum('sum_distance')} * {_sum('sum_distance')} / sum(trip_count)::DOUBLE, 0)
/ (sum(trip_count) - 1)::DOUBLE) END, 3) AS stddev_trip_distance FROM ({_WEATHER}) GROUP BY 1, 2, 3""")
def weather_impact_all_months(spark, d):
    from tidelake.plans.products import weather_rollup

    return weather_rollup(QUERIES["product_weather_impact_summary"](spark, d))


@query(f"SELECT pickup_borough, day_of_week, day_of_week_num, hour_of_day, {_ALL} FROM ({_BOROUGH}) GROUP BY 1, 2, 3, 4")
def borough_mobility_all_months(spark, d):
    from tidelake.plans.products import borough_rollup

    return borough_rollup(QUERIES["product_borough_mobility_summary"](spark, d))


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@query(f"SELECT weekday, h, n FROM (SELECT *, rank() OVER (PARTITION BY weekday ORDER BY n DESC) AS r FROM ({_GRID})) WHERE r = 1")
def peak_hours_in_order_of_weekdays(spark, d):
    """As peak_hour_per_weekday, from Monday on."""
    rank = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.col("weekday"))
    return peak_hour_per_weekday(spark, d).orderBy(rank, "h")


#: The six analyses that the integrated table answers.
ANALYSES = ("monthly_demand_per_zone", "distance_by_condition", "hourly_context_vs_demand", "zone_condition_variation", "peak_hour_per_weekday", "monthly_trend")


def run_all(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: QUERIES[name](spark, d) for name in ANALYSES}


@query(f"SELECT split, event_type, count(*) AS hours, sum(n)::BIGINT AS n, count(n_lag_24h) AS lagged, min(n) AS least, max(n) AS most FROM ({_LAGGED}) GROUP BY 1, 2")
def dataset_by_split_and_type(spark, d):
    by = training_dataset(spark, d).groupBy("split", "event_type")
    return by.agg(count("hours"), F.sum("n").alias("n"), F.count("n_lag_24h").alias("lagged"), F.min("n").alias("least"), F.max("n").alias("most"))
