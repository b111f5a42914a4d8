"""Measurements: what a setting does to a query, what validation and monitoring add to a load, what tables take up."""

from __future__ import annotations

import math
import os
import statistics
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.temporal import in_period
from tidelake.operators.joins import small
from tidelake.plans import products, refresh
from tidelake.plans.pipeline import Workspace, load_updates
from tidelake.sources.table import Files, Table

#: Settings of the trials; the first is what the others are compared with.
CONFIGS = {"baseline": {}, "no_validation": {"PLATFORM_VALIDATION": "off"}, "no_monitoring": {"PLATFORM_MONITORING": "off"}}
GROUPS = ("curated", "quarantine", "monitoring", "products")


# one query under several settings


@dataclass
class Measured:
    """One run of a query with few result rows: aggregates, by zone and month at most."""

    setting: str
    seconds: float
    rows: list[Row]
    plan: str


def measured(setting: str, df: DataFrame) -> Measured:
    """Collects and times; the plan is the one that was run, with what adaptive execution made of it."""
    began = time.perf_counter()
    rows = df.collect()
    took = time.perf_counter() - began
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return Measured(setting, round(took, 4), rows, df._jdf.queryExecution().explainString(mode))


def same_rows(one: Sequence[Row], other: Sequence[Row], tolerance: float = 1e-9) -> bool:
    """The same rows in any order; doubles may differ by the order in which tasks added them up."""

    def order(row):
        exact = [(v is not None, str(v)) for v in row if not isinstance(v, float)]
        return exact, [(not math.isnan(v), v) for v in row if isinstance(v, float)]

    def alike(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=tolerance)
        return a == b

    pairs = list(zip(sorted(one, key=order), sorted(other, key=order)))
    return len(one) == len(other) and all(len(a) == len(b) and all(map(alike, a, b)) for a, b in pairs)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def demand(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Monthly demand and average fare by zone, from the trips themselves."""
    places = zones.select("locationid", F.col("zone").alias("pickup_zone"), F.col("borough").alias("pickup_borough"))
    by = trips.join(places, trips.pulocationid == places.locationid, "left").groupBy("year", "month", "pickup_zone", "pickup_borough")
    return by.agg(F.count("*").alias("trip_count"), F.avg("fare_amount").alias("avg_fare")).orderBy("year", "month", F.desc("trip_count"))


def expensive(trips: DataFrame, zones: DataFrame, above: float = 100) -> DataFrame:
    by = trips.filter(F.col("fare_amount") > above).join(zones, trips.pulocationid == zones.locationid).groupBy("year", "borough")
    return by.agg(F.count("*").alias("expensive_trips"))


def caching(trips: DataFrame, zones: DataFrame) -> list[Measured]:
    """Twice from disk, then twice from memory, the first of which fills it."""
    out = [measured(f"disk, run {n}", demand(trips, zones)) for n in (1, 2)]
    kept = [trips.persist(StorageLevel.MEMORY_AND_DISK), zones.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        return out + [measured(f"cache, {n}", demand(trips, zones)) for n in ("filled", "read")]
    finally:
        for df in kept:
            df.unpersist()


def pruning(trips: DataFrame, year: int, month: int) -> list[Measured]:
    """Counts a month by its times, then by its partition."""
    until = datetime(year + month // 12, month % 12 + 1, 1)
    by_time = trips.filter(in_period(F.col("tpep_pickup_datetime"), datetime(year, month, 1), until))
    by_part = trips.filter((F.col("year") == year) & (F.col("month") == month))
    return [measured(n, df.agg(F.count("*").alias("n"))) for n, df in (("times", by_time), ("partition", by_part))]


def broadcasting(trips: DataFrame, zones: DataFrame) -> list[Measured]:
    """Sort-merge, then the zones sent to all executors, if they are small."""
    spark = trips.sparkSession
    demand(trips, zones).collect()  # so that neither reads files that the system hasn't seen
    out = []
    for name, limit, side in (("sort-merge", "-1", zones), ("broadcast", "10485760", small(zones))):
        with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": limit, "spark.sql.adaptive.autoBroadcastJoinThreshold": limit}):
            out.append(measured(name, demand(trips, side)))
    return out


def adaptive(trips: DataFrame, zones: DataFrame) -> list[Measured]:
    out = []
    for state in ("false", "true"):
        with settings(trips.sparkSession, {"spark.sql.adaptive.enabled": state}):
            out.append(measured(f"adaptive {state}", expensive(trips, zones)))
    return out


def tuning(trips: DataFrame, zones: DataFrame, year: int, month: int) -> dict[str, list[Measured]]:
    """All four pairs; an error if a setting changes a result."""
    found = {"caching": caching(trips, zones), "pruning": pruning(trips, year, month), "broadcast": broadcasting(trips, zones), "adaptive": adaptive(trips, zones)}
    for name, runs in found.items():
        if not all(same_rows(runs[0].rows, r.rows) for r in runs):
            raise ValueError(f"{name}: results differ by setting")
    return found


def timing(spark: SparkSession, run: Callable[[], object], warm: int = 2, times: int = 5) -> dict:
    """Seconds of the first run without cached tables, and the median of some after warming up."""
    spark.catalog.clearCache()
    found = []
    for _ in range(max(1, warm) + times):
        began = time.perf_counter()
        run()
        found.append(round(time.perf_counter() - began, 4))
    return {"cold": found[0], "median": statistics.median(found[-times:]), "runs": found[-times:]}


# trials of a load


@contextmanager
def environment(values: dict[str, str]) -> Iterator[None]:
    before = dict(os.environ)
    os.environ.update(values)
    try:
        yield
    finally:
        for k in values:
            os.environ.pop(k)
            if k in before:
                os.environ[k] = before[k]


def tables_of(ws: Workspace, group: str) -> dict[str, Table]:
    found = {n: Table(ws.spark, f"{ws.root}/{group}/{n}") for n in Files(ws.spark, ws.root).names(group)}
    return {n: t for n, t in found.items() if t.exists()}


def versions_of(ws: Workspace) -> dict[tuple[str, str], int]:
    """Versions of the tables that a load writes to."""
    return {(g, n): t.latest_version() for g in GROUPS[:2] for n, t in tables_of(ws, g).items()}


def restored(ws: Workspace, versions: dict[tuple[str, str], int]) -> None:
    """Takes tables back to those versions; tables that have come since go."""
    for group in GROUPS[:2]:
        for name, t in tables_of(ws, group).items():
            if (group, name) not in versions:
                t.files.delete("")
            elif t.latest_version() != versions[group, name]:
                t.restore(versions[group, name])
    ws.spark.catalog.clearCache()


def one_update(ws: Workspace, label: str, raw: dict[str, DataFrame], values: dict[str, str]) -> dict:
    ws.ledger.start_run(label)
    with environment(values):
        began = time.perf_counter()
        done = load_updates(ws, raw)
        took = time.perf_counter() - began
    facts = ("wall_seconds", "validate_seconds", "write_seconds", "processed_records", "inserted_records", "rejected_records", "duplicates_skipped", "status")
    return {"total_seconds": round(took, 2), "datasets": {n: {k: d[k] for k in facts if k in d} for n, d in done.items() if "status" in d}}


def spread(seconds: Sequence[float]) -> dict:
    return {"median_seconds": round(statistics.median(seconds), 2), "min_seconds": min(seconds), "max_seconds": max(seconds), "runs_seconds": list(seconds)}


def overhead(base: float, without: float) -> dict:
    """What the base takes more than a run without a part, and the share of that run."""
    return {"seconds": round(base - without, 2), "pct_of_run_without": round(100 * (base - without) / without, 1) if without else None}


def overhead_trials(ws: Workspace, raw: dict[str, DataFrame], reps: int = 3) -> dict:
    """Loads a release under each configuration, taking the tables back after each; each repetition starts with another
    configuration, so that none is always first."""
    state, names = versions_of(ws), list(CONFIGS)
    trials: dict[str, list[dict]] = {n: [] for n in names}
    try:
        one_update(ws, "evaluation:warmup", raw, {})
        for rep in range(reps):
            shift = rep % len(names)
            for name in names[shift:] + names[:shift]:
                restored(ws, state)
                trials[name].append(one_update(ws, f"evaluation:{name}", raw, CONFIGS[name]))
    finally:
        restored(ws, state)
    total = {n: spread([t["total_seconds"] for t in runs]) for n, runs in trials.items()}
    by_dataset = {n: {d: spread([t["datasets"][d]["wall_seconds"] for t in runs]) for d in runs[0]["datasets"]} for n, runs in trials.items()}

    def compared(without: str) -> dict:
        out = {"total": overhead(total["baseline"]["median_seconds"], total[without]["median_seconds"])}
        return out | {d: overhead(x["median_seconds"], by_dataset[without][d]["median_seconds"]) for d, x in by_dataset["baseline"].items() if d in by_dataset[without]}

    checking = [sum(d.get("validate_seconds") or 0 for d in t["datasets"].values()) for t in trials["baseline"]]
    return {
        "configs": {n: total[n] | {"datasets": by_dataset[n]} for n in names}, "validation_overhead": compared("no_validation"), "monitoring_overhead": compared("no_monitoring"),
        "validate_seconds_reported": round(statistics.median(checking), 2), "trials": trials,
    }


def storage(ws: Workspace) -> dict:
    """Bytes and files of all tables by group, with totals; from logs and file lists."""
    out = {}
    for group in GROUPS:
        tables = {}
        for name, t in tables_of(ws, group).items():
            size, detail = t.storage(), t.detail()
            tables[name] = {"live_bytes": size["live"], "live_files": detail["files"], "disk_bytes": size["disk"] + size["log"], "log_bytes": size["log"], "version": detail["version"]}
        out[group] = tables | {"_total": {k: sum(x[k] for x in tables.values()) for k in ("live_bytes", "live_files", "disk_bytes", "log_bytes")}}
    return out


def initial_loads(ws: Workspace) -> dict[str, dict]:
    """What the first execution of each dataset took."""
    if not ws.ledger.runs.exists():
        return {}
    first = ws.ledger.runs.read().groupBy("dataset").agg(F.min_by(F.struct("execution_time_seconds", "processed_records"), F.struct("started_at", "execution_id")).alias("x"))
    return {r.dataset: r.x.asDict() for r in first.select("dataset", "x").collect()}  # a row for each dataset


def evaluate(ws: Workspace, raw: dict[str, DataFrame], reps: int = 3, trials: bool = True, least: int = products.MIN_MONTH_TRIPS) -> dict:
    """Trials, storage, the update itself, and refreshes: full before, incremental, without news, verified, full after."""
    out: dict = {"reps": reps, "initial_load": initial_loads(ws)}
    if trials:
        out["overhead_trials"] = overhead_trials(ws, raw, reps)
    out["storage_before_update"] = storage(ws)

    def refreshed(**how) -> dict:
        began = time.perf_counter()
        plans = refresh.refresh_affected(ws, least=least, **how)
        return {"seconds": round(time.perf_counter() - began, 2), "actions": {p.product: p.action for p in plans}}

    out["full_refresh_before_update"] = refreshed(force_full=True)
    out["update"] = one_update(ws, "incremental_update", raw, {})
    out["incremental_refresh"], out["noop_refresh"] = refreshed(), refreshed()
    window = products.window_of(ws.table(products.SOURCE).detail(), least)
    built = [p for p in products.PRODUCTS.values() if ws.product(p.name).exists()]  # the others lack a column of the source
    out["verification"] = products.verify(ws, built, window)
    out["full_refresh_after_update"] = refreshed(force_full=True)
    return out | {"storage_after_update": storage(ws)}
