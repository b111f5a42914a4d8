"""Run and check ledgers, and the operational queries over them."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelake.functions.expressions import safe_ratio
from tidelake.operators.relational import first_per
from tidelake.sources.table import Table

RUNS = (
    "run_id string, execution_id string, pipeline string, dataset string, source string, target_path string, status string, error_message string, started_at timestamp, finished_at timestamp, "
    "execution_time_seconds double, validate_seconds double, write_seconds double, schema_version int, schema_fingerprint string, schema_changes string, write_mode string, source_records long, "
    "out_of_scope_records long, processed_records long, rejected_records long, quarantined_records long, dropped_records long, warning_records long, final_clean_records long, inserted_records long, "
    "duplicates_skipped long, validation_failures int, target_version long"
)
CHECKS = (
    "run_id string, execution_id string, dataset string, recorded_at timestamp, rule_name string, category string, action string, status string, failed_records long, checked_records long, details string"
)


def fingerprint(schema: T.StructType) -> str:
    """The same for any order of the columns."""
    return hashlib.md5(",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema)).encode()).hexdigest()


def enabled() -> bool:
    return os.environ.get("PLATFORM_MONITORING", "on").lower() not in ("0", "off", "false", "no")


@dataclass
class Execution:
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    values: dict = field(default_factory=dict)
    checks: list[dict] = field(default_factory=list)

    def record(self, **values) -> None:
        self.values |= values


class Ledger:
    """Buffers executions and writes them as one commit for each ledger."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.runs, self.checks = spark, Table(spark, f"{root}/pipeline_runs"), Table(spark, f"{root}/validation_results")
        self.run_id, self.pipeline = uuid.uuid4().hex, "adhoc"
        self._runs: list[dict] = []
        self._checks: list[dict] = []

    def start_run(self, pipeline: str) -> str:
        self.run_id, self.pipeline = uuid.uuid4().hex, pipeline
        return self.run_id

    def schema_version(self, dataset: str, mark: str) -> int:
        """How many different schemas of the dataset came first, plus one."""
        known = [r["schema_fingerprint"] for r in sorted((r for r in self._runs if r["dataset"] == dataset), key=lambda r: r["started_at"])]
        if self.runs.exists():
            seen = self.runs.read().filter(F.col("dataset") == dataset).groupBy("schema_fingerprint").agg(F.min("started_at").alias("t")).orderBy("t").collect()
            known = [r["schema_fingerprint"] for r in seen] + known
        order = list(dict.fromkeys(x for x in known if x))
        return order.index(mark) + 1 if mark in order else len(order) + 1

    @contextmanager
    def track(self, dataset: str, df: DataFrame | None = None, source: str = "", target: str | None = None) -> Iterator[Execution]:
        """Records how the block ended; exceptions go on."""
        execution, began, clock = Execution(), datetime.now(timezone.utc), time.perf_counter()
        if df is not None and enabled():
            mark = fingerprint(T.StructType([f for f in df.schema if not f.name.startswith("_")]))
            execution.record(schema_fingerprint=mark, schema_version=self.schema_version(dataset, mark))
        status, error = "succeeded", None
        try:
            yield execution
            status = execution.values.get("status", status)
        except Exception as e:
            status, error = "failed", f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            if enabled():
                ids = {"run_id": self.run_id, "execution_id": execution.id, "dataset": dataset}
                now = datetime.now(timezone.utc)
                done = {"pipeline": self.pipeline, "source": source, "target_path": target, "status": status, "error_message": error, "started_at": began, "finished_at": now, "execution_time_seconds": round(time.perf_counter() - clock, 2)}
                self._runs.append(execution.values | ids | done)
                for c in execution.checks:
                    checked = None if c["category"] == "schema" and c["name"].startswith("schema:") else execution.values.get("processed_records")
                    self._checks.append(ids | {"recorded_at": now, "rule_name": c["name"], "category": c["category"], "action": c["action"], "status": c["status"], "failed_records": c["failed"], "checked_records": checked, "details": c["note"]})

    def flush(self) -> None:
        for table, rows, ddl in ((self.runs, self._runs, RUNS), (self.checks, self._checks, CHECKS)):
            if rows:
                schema = T.StructType.fromDDL(ddl)
                table.append(self.spark.createDataFrame([tuple(r.get(f.name) if not isinstance(r.get(f.name), (dict, list)) else json.dumps(r[f.name]) for f in schema) for r in rows], schema), files=1)
                rows.clear()


def _percent(part: Column, whole: Column) -> Column:
    return F.round(safe_ratio(100.0 * part, whole), 3)


def failing_datasets(runs: DataFrame) -> DataFrame:
    """Which dataset fails validation most often."""
    out = runs.groupBy("dataset").agg(
        F.count("*").alias("executions"), F.sum(F.when(F.col("validation_failures") > 0, 1).otherwise(0)).alias("executions_with_failures"), F.sum("validation_failures").alias("failed_checks"),
        F.sum("rejected_records").alias("rejected_records"), _percent(F.sum("rejected_records"), F.sum("processed_records")).alias("pct_records_rejected"),
    )
    return out.orderBy(F.desc("executions_with_failures"), F.desc("failed_checks"), F.desc("pct_records_rejected"))


def failing_rules(checks: DataFrame, most: int = 25) -> DataFrame:
    """Which rules fail most often; ties by name, so that the report is the same each time."""
    bad = checks.filter(F.col("status").isin("failed", "warning")).groupBy("dataset", "rule_name", "category", "action")
    out = bad.agg(F.count("*").alias("executions_failed"), F.sum(F.coalesce("failed_records", F.lit(0))).alias("failed_records"))
    return out.orderBy(F.desc("executions_failed"), F.desc("failed_records"), "dataset", "rule_name", "category", "action").limit(most)


def slowest_datasets(runs: DataFrame) -> DataFrame:
    """Which dataset takes longest."""
    s = F.col("execution_time_seconds")
    out = runs.filter("status = 'succeeded'").groupBy("dataset").agg(
        F.count("*").alias("executions"), F.round(F.avg(s), 2).alias("avg_seconds"), F.round(F.max(s), 2).alias("max_seconds"), F.round(F.sum(s), 2).alias("total_seconds"),
        F.round(F.avg("validate_seconds"), 2).alias("avg_validate_seconds"), F.round(F.avg("write_seconds"), 2).alias("avg_write_seconds"), F.round(safe_ratio(F.sum("processed_records"), F.sum(s))).alias("records_per_second"),
    )
    return out.orderBy(F.desc("avg_seconds"))


def rejections_per_execution(runs: DataFrame) -> DataFrame:
    names = ["started_at", "pipeline", "dataset", "status", "processed_records", "rejected_records", "quarantined_records", "dropped_records", "warning_records"]
    return runs.select(*names, _percent(F.col("rejected_records"), F.col("processed_records")).alias("pct_rejected"), "inserted_records").orderBy("started_at")


def processing_time_trend(runs: DataFrame, rows: int = 3) -> DataFrame:
    """How the time has changed over executions; throughput, as batches differ in size. Executions that started at the same
    moment follow their ids, then the other columns, so that only rows alike in all of them may change places."""
    s = F.col("execution_time_seconds")
    moments = [F.col(c).asc_nulls_last() for c in ("started_at", "execution_id", "execution_time_seconds", "processed_records", "pipeline")]
    order = Window.partitionBy("dataset").orderBy(*moments)
    out = runs.filter("status = 'succeeded'").select(
        "dataset", "started_at", "pipeline", "processed_records", "execution_time_seconds", F.round(s - F.lag(s).over(order), 2).alias("change_vs_previous"),
        F.round(F.avg(s).over(order.rowsBetween(1 - rows, 0)), 2).alias(f"moving_avg_{rows}"), F.round(safe_ratio(F.col("processed_records"), s)).alias("records_per_second"),
    )
    return out.orderBy("dataset", F.col("started_at").asc_nulls_last())


def schema_history(runs: DataFrame) -> DataFrame:
    """When each dataset's schema changed, and how."""
    by = runs.groupBy("dataset", "schema_version").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.count("*").alias("executions"), F.min_by("schema_changes", "started_at").alias("changes_when_introduced")
    )
    return by.orderBy("dataset", "schema_version")


def latest_status(runs: DataFrame) -> DataFrame:
    names = [
        "dataset", "started_at", "pipeline", "status", "schema_version", "processed_records", "inserted_records", "rejected_records", "validation_failures", "execution_time_seconds", "target_version", "error_message",
    ]
    return first_per(runs, ["dataset"], F.desc("started_at"), F.desc("execution_id")).select(*names).orderBy("dataset")


QUERIES = {
    "failing_datasets": (failing_datasets, "runs"), "failing_rules": (failing_rules, "checks"), "slowest_datasets": (slowest_datasets, "runs"), "rejections_per_execution": (rejections_per_execution, "runs"),
    "processing_time_trend": (processing_time_trend, "runs"), "schema_history": (schema_history, "runs"), "latest_status": (latest_status, "runs"),
}


def latest_results(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Checks that didn't pass in the latest execution of each dataset."""
    latest = first_per(runs, ["dataset"], F.desc("started_at"), F.desc("execution_id")).select("execution_id")
    names = ["dataset", "rule_name", "category", "action", "status", "failed_records", "checked_records", "details"]
    return checks.join(latest, "execution_id").filter(F.col("status") != "passed").select(*names).orderBy("dataset", "status", F.desc("failed_records"))


def category_totals(checks: DataFrame) -> DataFrame:
    """Checks with findings and records flagged, by category, of all executions."""
    by = checks.groupBy("dataset", "category").agg(
        F.sum(F.when(F.col("status").isin("failed", "warning"), 1).otherwise(0)).alias("checks_with_findings"), F.sum(F.coalesce("failed_records", F.lit(0))).alias("records_flagged")
    )
    return by.filter("checks_with_findings > 0").orderBy("dataset", F.desc("records_flagged"))
