"""Data products: monthly aggregates that are kept up to date from the source table's log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.expressions import band, category, exact_avg, exact_sum, month_predicate, safe_ratio, sample_stddev
from tidelake.functions.names import quoted
from tidelake.operators.joins import differences
from tidelake.operators.relational import first_per, ranked, share_of_total, top_ranked
from tidelake.plans.pipeline import Workspace

Month = tuple[int, int]
#: Weather condition codes by category, and limits of fine-particle bands; fixed values.
WEATHER_CATEGORIES = {
    "Clear/Fair": (1, 2, 3), "Cloudy/Overcast": (4, 5), "Fog": (6, 7), "Rain": (8, 9, 17, 18), "Snow": (14, 15, 16, 19, 20), "Storm": (21, 22, 23, 24, 25, 26, 27),
}
PM25_BANDS = ((12.0, "Good"), (35.4, "Moderate"))
#: Trips from which on a month counts as reported, and a zone's variation as more than noise; fixed values.
MIN_MONTH_TRIPS, MIN_ZONE_TRIPS = 1000, 500


def weather_category():
    return category(F.col("coco"), WEATHER_CATEGORIES)


@dataclass(frozen=True)
class Product:
    """``build`` turns the shared slice into rows with year and month; ``grain`` and ``measures`` serve verification."""

    name: str
    version: str
    build: Callable[[DataFrame], DataFrame]
    grain: tuple[str, ...]
    measures: tuple[str, ...]
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    rollup: Callable[[DataFrame], DataFrame] | None = None


#: Optional columns of the source and the types that they have where the source lacks them.
OPTIONAL = {"humidity": "double", "aqi": "double"}
SOURCE = "integrated_taxi_trips"


def total(column: str, places: int):
    return F.round(exact_sum(F.col(column)), places)


def mean(column: str, places: int):
    return F.round(exact_avg(F.col(column)), places)


def trips_and_distance() -> list:
    return [F.count("*").alias("trip_count"), total("trip_distance", 2).alias("total_distance_miles")]


def daily_mobility(df: DataFrame) -> DataFrame:
    """A row for each day; weather and air as the average trip met them."""
    ts = F.col("tpep_pickup_datetime")
    return df.groupBy("year", "month", F.to_date(ts).alias("service_date"), F.date_format(ts, "EEEE").alias("day_of_week")).agg(
        *trips_and_distance(), total("total_amount", 2).alias("total_revenue"), mean("trip_distance", 3).alias("avg_trip_distance"), mean("total_amount", 2).alias("avg_trip_revenue"),
        mean("passenger_count", 2).alias("avg_passengers"), mean("temp", 1).alias("avg_temp_c"), mean("prcp", 2).alias("avg_precip_mm"), mean("pm25", 1).alias("avg_pm25"), mean("humidity", 1).alias("avg_humidity"),
    )


def zone_statistics(df: DataFrame) -> DataFrame:
    """A row for each month and zone, with its rank and its share of the month's trips in percent."""
    by = df.filter("pickup_zone is not null").groupBy("year", "month", "pickup_zone", "pickup_borough").agg(
        *trips_and_distance(), total("total_amount", 2).alias("total_revenue"), mean("trip_distance", 3).alias("avg_trip_distance"), mean("fare_amount", 2).alias("avg_fare")
    )
    ranks = ranked(by, ["year", "month"], "trip_count", "demand_rank")
    shares = share_of_total(ranks, ["year", "month"], "trip_count", "pct_of_monthly_trips")
    return shares.withColumn("pct_of_monthly_trips", F.round(100 * F.col("pct_of_monthly_trips"), 3))


def weather_impact(df: DataFrame) -> DataFrame:
    """A row for each month, weather category and zone; the unrounded sums add up over months."""
    d = F.col("trip_distance")
    by = df.withColumn("weather_category", weather_category()).filter("weather_category <> 'Unknown' and pickup_zone is not null")
    sums = by.groupBy("year", "month", "weather_category", "pickup_zone", "pickup_borough").agg(
        *trips_and_distance(), total("total_amount", 2).alias("total_revenue"), mean("trip_distance", 3).alias("avg_trip_distance"), F.round(F.stddev(d), 3).alias("stddev_trip_distance"),
        exact_sum(d).alias("sum_distance"), exact_sum(d * d).alias("sum_sq_distance"), exact_sum(F.col("total_amount")).alias("sum_revenue"),
    )
    return sums


def air_impact(df: DataFrame) -> DataFrame:
    """A row for each hour with a fine-particle reading."""
    by = df.filter("pm25 is not null").groupBy("year", "month", "pickup_hour").agg(
        exact_avg(F.col("pm25")).alias("level"), *trips_and_distance(), mean("trip_distance", 3).alias("avg_trip_distance"), mean("aqi", 1).alias("avg_aqi")
    )
    return by.withColumn("pm25", F.round("level", 2)).withColumn("aqi_band", band(F.col("level"), PM25_BANDS, "Unhealthy")).drop("level")


def borough_mobility(df: DataFrame) -> DataFrame:
    """A row for each month, borough, weekday and hour."""
    ts = F.col("tpep_pickup_datetime")
    by = df.filter("pickup_borough is not null").groupBy("year", "month", "pickup_borough", F.date_format(ts, "EEEE").alias("day_of_week"), F.dayofweek(ts).alias("day_of_week_num"), F.hour(ts).alias("hour_of_day"))
    return by.agg(
        *trips_and_distance(), total("total_amount", 2).alias("total_revenue"), mean("trip_distance", 3).alias("avg_trip_distance"),
        exact_sum(F.col("trip_distance")).alias("sum_distance"), exact_sum(F.col("total_amount")).alias("sum_revenue"),
    )


STAMPS = ("source_table", "source_version", "schema_version", "created_at", "refreshed_at")


def stamps_rolled_up(product: DataFrame) -> list:
    """What the stamps of several months come to."""
    least = {"created_at"}
    return [(F.min if c in least else F.max)(c).alias(c) for c in STAMPS if c in product.columns]


def _rollup(product: DataFrame, *keys: str, more: list) -> DataFrame:
    n, s = F.sum("trip_count"), exact_sum(F.col("sum_distance"))
    return product.groupBy(*keys).agg(
        n.alias("trip_count"), F.round(s, 2).alias("total_distance_miles"), F.round(exact_sum(F.col("sum_revenue")), 2).alias("total_revenue"), F.round(safe_ratio(s, n), 3).alias("avg_trip_distance"),
        *more, *stamps_rolled_up(product),
    )


def weather_rollup(product: DataFrame, *keys: str) -> DataFrame:
    """The product over all months, from the sums: by category, zone and borough, unless ``keys`` name other columns."""
    deviation = sample_stddev(F.sum("trip_count"), exact_sum(F.col("sum_distance")), exact_sum(F.col("sum_sq_distance")))
    return _rollup(product, *(keys or ("weather_category", "pickup_zone", "pickup_borough")), more=[F.round(deviation, 3).alias("stddev_trip_distance")])


def borough_rollup(product: DataFrame) -> DataFrame:
    """The product over all months: a weekly profile of each borough."""
    return _rollup(product, "pickup_borough", "day_of_week", "day_of_week_num", "hour_of_day", more=[])


_DISTANCES = ("trip_count", "total_distance_miles", "total_revenue", "avg_trip_distance")
PRODUCTS = {p.name: p for p in (
    Product(
        "daily_mobility_summary", "1.1", daily_mobility, ("year", "month", "service_date", "day_of_week"), (*_DISTANCES, "avg_trip_revenue", "avg_passengers", "avg_temp_c", "avg_precip_mm", "avg_pm25", "avg_humidity"),
        ("tpep_pickup_datetime", "trip_distance", "total_amount", "passenger_count", "temp", "prcp", "pm25"), ("humidity",),
    ),
    Product(
        "taxi_zone_statistics", "1.1", zone_statistics, ("year", "month", "pickup_zone", "pickup_borough"), (*_DISTANCES, "avg_fare", "demand_rank", "pct_of_monthly_trips"),
        ("pickup_zone", "pickup_borough", "trip_distance", "total_amount", "fare_amount"),
    ),
    Product(
        "weather_impact_summary", "2.0", weather_impact, ("year", "month", "weather_category", "pickup_zone", "pickup_borough"), (*_DISTANCES, "stddev_trip_distance", "sum_distance", "sum_sq_distance", "sum_revenue"),
        ("coco", "pickup_zone", "pickup_borough", "trip_distance", "total_amount"), (), weather_rollup,
    ),
    Product(
        "air_quality_impact_summary", "1.1", air_impact, ("year", "month", "pickup_hour", "aqi_band"), ("pm25", "trip_count", "total_distance_miles", "avg_trip_distance", "avg_aqi"),
        ("pickup_hour", "pm25", "trip_distance"), ("aqi",),
    ),
    Product(
        "borough_mobility_summary", "2.0", borough_mobility, ("year", "month", "pickup_borough", "day_of_week", "day_of_week_num", "hour_of_day"), (*_DISTANCES, "sum_distance", "sum_revenue"),
        ("pickup_borough", "tpep_pickup_datetime", "trip_distance", "total_amount"), (), borough_rollup,
    ),
)}


def register_views(ws: Workspace) -> list[str]:
    """A view for each product that is there; one with a rollup has its monthly table as ``<name>_monthly``, and under its own
    name what all months come to."""
    out = []
    for p in PRODUCTS.values():
        if not ws.product(p.name).exists():
            continue
        stored = ws.product(p.name).read()
        if p.rollup:
            stored.createOrReplaceTempView(f"{p.name}_monthly")
            out.append(f"{p.name}_monthly")
        (p.rollup(stored) if p.rollup else stored).createOrReplaceTempView(p.name)
        out.append(p.name)
    return out


def distance_by_weather(impact: DataFrame) -> DataFrame:
    """The second analysis, from the weather product over all months."""
    by = impact.groupBy("weather_category").agg(F.sum("trip_count").alias("trip_count"), F.round(safe_ratio(exact_sum(F.col("total_distance_miles")), F.sum("trip_count")), 3).alias("avg_distance"))
    return by.orderBy(F.desc("avg_distance"))


def zone_variation(impact: DataFrame, least: int = MIN_ZONE_TRIPS, most: int = 10) -> DataFrame:
    """The fourth analysis, from the same: zones whose demand varies most between categories."""
    by = impact.groupBy("pickup_zone").agg(F.sum("trip_count").alias("total_trips"), F.round(safe_ratio(F.stddev("trip_count"), F.avg("trip_count")), 4).alias("coeff_of_variation"), F.count("*").alias("n"))
    return by.filter((F.col("total_trips") >= least) & (F.col("n") >= 2)).drop("n").orderBy(F.desc("coeff_of_variation"), "pickup_zone").limit(most)


def peak_hours(profile: DataFrame) -> DataFrame:
    """The fifth analysis, from the borough product over all months."""
    city = profile.groupBy("day_of_week", "day_of_week_num", "hour_of_day").agg(F.sum("trip_count").alias("trip_count"))
    return top_ranked(city, ["day_of_week"], "trip_count").orderBy("day_of_week_num", "hour_of_day").select("day_of_week", "hour_of_day", "trip_count")


def reporting_window(df: DataFrame, least: int = MIN_MONTH_TRIPS) -> DataFrame:
    """Months with enough rows."""
    return df.filter("year is not null").groupBy("year", "month").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least).select("year", "month", "rows")


def window_of(detail: dict, least: int = MIN_MONTH_TRIPS) -> set[Month]:
    """The same from the table's log, without a job."""
    return {(int(y), int(m)) for (y, m), n in detail["partitions"].items() if n >= least and y.isdigit() and m.isdigit()}


def sliced(df: DataFrame, months: Iterable[Month], products: Sequence[Product]) -> DataFrame:
    """The columns that the products need, of the months that they need; optional columns as NULL where missing."""
    wanted = list(dict.fromkeys(["year", "month", *(c for p in products for c in (*p.required, *p.optional))]))
    missing = [c for p in products for c in p.required if c not in df.columns]
    if missing:
        raise ValueError(f"the source lacks {sorted(set(missing))}")
    columns = [F.col(quoted(c)) if c in df.columns else F.lit(None).cast(OPTIONAL[c]).alias(c) for c in wanted]
    return df.filter(month_predicate(months)).select(*columns)


def stamped(df: DataFrame, product: Product, source_version: int, created: datetime, refreshed: datetime) -> DataFrame:
    """``df`` with where it comes from, its definition's version, when its table was made and when its rows were."""
    return df.withColumns({
        "source_table": F.lit(SOURCE), "source_version": F.lit(source_version).cast("long"), "schema_version": F.lit(product.version),
        "created_at": F.lit(created).cast("timestamp"), "refreshed_at": F.lit(refreshed).cast("timestamp"),
    })


REGISTRY = (
    "product_name string, source_table string, source_version long, schema_version string, created_at timestamp, refreshed_at timestamp, row_count long, size_bytes long, num_files long, build_seconds double, "
    "partitioned_by string, refresh_mode string, refreshed_partitions string, reason string, source_columns string"
)


def months_text(months: Iterable[Month]) -> str:
    return ",".join(f"{y}-{m:02d}" for y, m in sorted(months)) or "-"


class Registry:
    def __init__(self, ws: Workspace) -> None:
        self.table, self.spark = ws.product("_registry"), ws.spark

    def add(self, rows: list[dict]) -> None:
        schema = T.StructType.fromDDL(REGISTRY)
        self.table.append(self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema), files=1)

    def latest(self) -> DataFrame | None:
        return first_per(self.table.read(), ["product_name"], F.desc("refreshed_at"), F.desc("source_version")) if self.table.exists() else None

    def entry(self, name: str) -> dict | None:
        rows = self.latest()
        found = rows.filter(F.col("product_name") == name).first() if rows is not None else None
        return found.asDict() if found else None


def source_columns(schema: T.StructType, product: Product) -> dict[str, str]:
    types = {f.name: f.dataType.simpleString() for f in schema}
    return {c: types[c] for c in (*product.required, *product.optional) if c in types}


def refresh(ws: Workspace, products: Sequence[Product], window: set[Month], months: set[Month] | None = None, cache: bool = True, reason: str = "asked for") -> list[dict]:
    """Builds products from one shared slice: all months of the window, or the months given (the others stay)."""
    import time

    source = ws.table(SOURCE)
    version, schema = source.latest_version(), source.schema()
    todo = sorted(window if months is None else months & window)
    slice_ = sliced(source.read(version), todo, products)
    if cache:
        # Several products read the slice; what doesn't fit in memory goes to disk.
        slice_ = slice_.persist(StorageLevel.MEMORY_AND_DISK)
    entries = []
    try:
        for p in products:
            began, target, now = time.perf_counter(), ws.product(p.name), datetime.now(timezone.utc)
            created = target.detail()["created"] if target.exists() else now
            built = stamped(p.build(slice_), p, version, created, now)
            note = {"product": p.name, "source_table": SOURCE, "source_version": version, "schema_version": p.version, "refreshed_at": now.isoformat(), "partitions": "all" if months is None else months_text(months), "reason": reason}
            if not target.exists():
                target.create(built, ["year", "month"], metadata=note)
            elif months is None:
                target.overwrite(built, ["year", "month"], metadata=note)
            else:
                target.replace(built, months, metadata=note)
            detail = target.detail()
            entries.append({
                "product_name": p.name, "source_table": SOURCE, "source_version": version, "schema_version": p.version, "created_at": created, "refreshed_at": now, "row_count": detail["rows"],
                "size_bytes": detail["bytes"], "num_files": detail["files"], "build_seconds": round(time.perf_counter() - began, 2), "partitioned_by": "year,month", "refresh_mode": "full" if months is None else "incremental",
                "refreshed_partitions": note["partitions"], "reason": reason, "source_columns": json.dumps(source_columns(schema, p)),
            })
    finally:
        if cache:
            slice_.unpersist()
    Registry(ws).add(entries)
    return entries


def verify(ws: Workspace, products: Sequence[Product], window: set[Month], tolerance: float = 0.0015) -> dict[str, int]:
    """Rows by which each stored product differs from one built anew."""
    source = ws.table(SOURCE).read()
    out = {}
    for p in products:
        stored, fresh = ws.product(p.name).read(), p.build(sliced(source, sorted(window), [p]))
        out[p.name] = differences(stored, fresh, p.grain, p.measures, tolerance).count()
        if p.rollup:  # what the months come to, against the same from the rows
            grain, measures = [c for c in p.grain if c not in ("year", "month")], [c for c in p.measures if not c.startswith("sum_")]
            out[f"{p.name} (all months)"] = differences(p.rollup(stored), p.rollup(fresh), grain, measures, tolerance).count()
    return out
