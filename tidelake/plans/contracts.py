"""Dataset contracts: declared schema, required columns, rules, policy for undeclared columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidelake.functions.conform import MALFORMED
from tidelake.functions.names import normalized
from tidelake.plans import drift
from tidelake.plans.rules import WARN, AllowedValues, Check, InRange, NotAlreadyLoaded, Observed, Positive, ReferenceExists, Rule, Unique, WellFormed, not_null


TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def schema(text: str) -> T.StructType:
    """A schema from ``name type, ...``, which needs no session (unlike Spark's parser); names may hold blanks."""
    fields = [x.strip().rsplit(" ", 1) for x in text.split(",")]
    return T.StructType([T.StructField(name.strip("`"), TYPES[kind], True) for name, kind in fields])


@dataclass(frozen=True)
class Contract:
    name: str
    declared: T.StructType = field(default_factory=T.StructType)
    required: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    undeclared: str = drift.DROP_COLUMN
    keys_checked: bool = True

    def columns(self) -> list[str]:
        return [normalized(f.name) for f in self.declared]

    def all_rules(self, key: Sequence[str], columns: Sequence[str]) -> list[Rule]:
        """The rules that every dataset has, then its own."""
        own_names = {r.name for r in self.rules}
        common: list[Rule] = [WellFormed()] if MALFORMED in columns else []
        if self.keys_checked:
            common += [*not_null(*key), Unique(tuple(key)), NotAlreadyLoaded(tuple(key))]
        return [r for r in common if r.name not in own_names] + list(self.rules)


#: Declared schemas, plausible ranges and code lists of the public sources; fixed values.
TRIPS = schema(
    "ride_id bigint, VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count int, trip_distance double, RatecodeID int, "
    "store_and_fwd_flag string, PULocationID int, DOLocationID int, payment_type int, fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, "
    "improvement_surcharge double, total_amount double, congestion_surcharge double, Airport_fee double"
)
ZONES = schema("LocationID int, Borough string, Zone string, service_zone string")
WEATHER = schema(
    "year int, month int, day int, hour int, temp double, temp_source string, rhum int, rhum_source string, prcp double, prcp_source string, snwd double, snwd_source string, "
    "wdir int, wdir_source string, wspd double, wspd_source string, wpgt double, wpgt_source string, pres double, pres_source string, cldc int, cldc_source string, coco int, coco_source string, humidity int"
)
AIR = schema(
    "`State Code` string, `County Code` string, `Site Num` string, `Parameter Code` int, POC int, Latitude double, Longitude double, Datum string, `Parameter Name` string, `Date Local` date, "
    "`Time Local` string, `Date GMT` date, `Time GMT` string, `Sample Measurement` double, `Units of Measure` string, MDL double, Uncertainty double, Qualifier string, `Method Type` string, "
    "`Method Code` int, `Method Name` string, `State Name` string, `County Name` string, `Date of Last Change` date, aqi int"
)

CONTRACTS = {
    "weather": Contract(
        "weather", WEATHER, ("year", "month", "day", "hour", "temp"),
        (
            *not_null("temp"), Positive("year"), InRange("month", 1, 12), InRange("day", 1, 31), InRange("hour", 0, 23), InRange("temp", -40, 50), InRange("rhum", 0, 100), InRange("humidity", 0, 100),
            InRange("prcp", 0, 300), InRange("snwd", 0, 3000), InRange("wdir", 0, 360), InRange("wspd", 0, 250), InRange("wpgt", 0, 350), InRange("pres", 870, 1090), InRange("cldc", 0, 8), InRange("coco", 1, 27),
        ),
    ),
    "air_quality": Contract(
        "air_quality", AIR,
        ("state_code", "county_code", "site_num", "parameter_code", "poc", "parameter_name", "date_local", "time_local", "date_gmt", "time_gmt", "sample_measurement", "method_name", "date_of_last_change"),
        (
            *not_null("timestamp_local", "timestamp_gmt", "timestamp_last_change", "sample_measurement"), InRange("sample_measurement", -10, 1000), InRange("aqi", 0, 500),
            InRange("latitude", -90, 90), InRange("longitude", -180, 180),
            Check("gmt_offset_plausible", "timestamp_gmt - timestamp_local BETWEEN INTERVAL '-14' HOUR AND INTERVAL '14' HOUR"),
        ),
    ),
    "taxi_zones": Contract("taxi_zones", ZONES, ("locationid", "borough", "zone"), (Positive("locationid"), *not_null("borough", "zone"))),
    "trip_data": Contract(
        "trip_data", TRIPS,
        ("vendorid", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance", "pulocationid", "dolocationid", "fare_amount", "total_amount"),
        (
            *not_null("tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance", "pulocationid", "dolocationid"),
            Positive("passenger_count"), Positive("trip_distance"), InRange("trip_distance", None, 500),
            Check("dropoff_after_pickup", "tpep_dropoff_datetime >= tpep_pickup_datetime"),
            Check("trip_under_24h", "tpep_dropoff_datetime <= tpep_pickup_datetime + INTERVAL 24 HOURS"),
            Check("pickup_after_2009", "year(tpep_pickup_datetime) >= 2009"),
            Check("non_negative_amounts", "fare_amount >= 0 AND total_amount >= 0"),
            AllowedValues("vendorid", (1, 2, 6, 7)), AllowedValues("ratecodeid", (1, 2, 3, 4, 5, 6, 99)), AllowedValues("payment_type", (0, 1, 2, 3, 4, 5, 6)), AllowedValues("store_and_fwd_flag", ("Y", "N")),
            ReferenceExists("pulocationid", "taxi_zones", "locationid"), ReferenceExists("dolocationid", "taxi_zones", "locationid"),
        ),
    ),
    # Its rows come from trips that were checked, so keys aren't checked again.
    "integrated_taxi_trips": Contract(
        "integrated_taxi_trips", rules=(Observed("temp", "weather_observation_exists", action=WARN), Observed("pm25", "air_quality_observation_exists", action=WARN)), undeclared=drift.EVOLVE, keys_checked=False
    ),
}


def contract(name: str) -> Contract:
    """The contract of a dataset; an empty one for others."""
    return CONTRACTS.get(name, Contract(name, undeclared=drift.EVOLVE))
