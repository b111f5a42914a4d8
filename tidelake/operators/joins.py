"""Joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a side up to which it is sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcasting if the optimizer's own size estimate proves it small; else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= bytes_ else df


def lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], prefix: str = "", columns: Sequence[str] = ()) -> DataFrame:
    """Left join of a lookup with one row per key; its columns get ``prefix``, so that one lookup serves several roles."""
    if not columns:
        return fact
    keys = [F.col(d).alias(f"__{prefix}{d}") for d in on.values()]
    names = [f"__{prefix}{d}" for d in on.values()]
    # Of a repeated key, the least row by its columns: the same in every run.
    side = small(dim.select(*keys, *[F.col(c).alias(prefix + c) for c in columns]).groupBy(*names).agg(F.min(F.struct(*[prefix + c for c in columns])).alias("__row")).select(*names, "__row.*"))
    condition = [fact[f] == side[f"__{prefix}{d}"] for f, d in on.items()]
    return fact.join(side, condition, "left").drop(*[f"__{prefix}{d}" for d in on.values()])


def marked(df: DataFrame, keys: DataFrame, on: Sequence[str], mark: str) -> DataFrame:
    """``df`` with a column telling whether its key is among ``keys``; NULL keys never are."""
    side = keys.select(*[F.col(k).alias(f"__k_{k}") for k in on]).distinct().withColumn(f"__{mark}", F.lit(True))
    joined = df.join(small(side), [df[k] == side[f"__k_{k}"] for k in on], "left")
    return joined.withColumn(mark, F.coalesce(f"__{mark}", F.lit(False))).drop(f"__{mark}", *[f"__k_{k}" for k in on])


def missing_reference(df: DataFrame, column: str, reference: DataFrame, reference_column: str, mark: str) -> DataFrame:
    """``df`` with a column telling whether ``column`` is set but not found in the reference."""
    found = marked(df.withColumn("__fk", F.col(column)), reference.select(F.col(reference_column).alias("__fk")), ["__fk"], "__found")
    return found.withColumn(mark, F.col("__fk").isNotNull() & ~F.col("__found")).drop("__fk", "__found")


def not_loaded(source: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key ``target`` lacks."""
    return source.join(target.select(*on), list(on), "left_anti")


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of one with every row of the other: small lookup sides, as zones and hours of a window."""
    return left.crossJoin(small(right))


def zero_filled(cells: DataFrame, counts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return cells.join(counts, list(keys), "left").withColumn(column, F.coalesce(F.col(column), F.lit(0)).cast("long"))


def lagged(df: DataFrame, partition: str, ts: str, value: str, hours: Sequence[int]) -> DataFrame:
    """Value of the same partition so many hours before, by time rather than by row; NULL where there was no such row."""
    from pyspark.sql.window import Window

    out = df
    order = (F.unix_timestamp(F.col(ts).cast("timestamp")) / 3600).cast("long")
    for h in hours:
        frame = Window.partitionBy(partition).orderBy(order).rangeBetween(-h, -h)
        out = out.withColumn(f"{value}_lag_{h}h", F.max(value).over(frame))
    return out


def differences(a: DataFrame, b: DataFrame, grain: Sequence[str], measures: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of either side without a partner of equal grain (NULLs equal), or with a measure that differs by more."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in (*grain, *measures)], F.lit(True).alias("in_a"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in (*grain, *measures)], F.lit(True).alias("in_b"))
    joined = left.join(right, [left[f"a_{g}"].eqNullSafe(right[f"b_{g}"]) for g in grain], "full_outer")
    off: Column = F.col("in_a").isNull() | F.col("in_b").isNull()
    for m in measures:
        x, y = F.col(f"a_{m}").cast("double"), F.col(f"b_{m}").cast("double")
        off = off | ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    return joined.filter(off)


def enriched(fact: DataFrame, hour: str, context: DataFrame, context_hour: str, columns: Sequence[str]) -> DataFrame:
    """Hourly context by equality of the hour; the context has one row per hour, so no fact row multiplies."""
    return lookup(fact, context, {hour: context_hour}, columns=columns)
