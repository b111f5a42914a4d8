"""Windows, aggregates, sorting and set operations over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.expressions import safe_ratio


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def top_ranked(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Rows with the largest value of each key, ties kept."""
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).filter("__rank = 1").drop("__rank")


def ranked(df: DataFrame, keys: Sequence[str], by: str, name: str) -> DataFrame:
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(by))))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, safe_ratio(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*keys)).cast("double")))


def change(df: DataFrame, order: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Previous value, change and change in percent. Without keys all rows are in one window: for small aggregates."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(f"previous_{value}", before).withColumn("change", F.col(value) - F.col(f"previous_{value}")).withColumn(
        "change_percent", safe_ratio(100.0 * F.col("change"), F.col(f"previous_{value}"))
    )


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)))


def deduplicated(df: DataFrame, keys: Sequence[str], failures: Column, content: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``__occurrence``: 1 for the row of a key to keep, that with the fewest failures, then by content."""
    names = content or df.columns
    order = [failures, F.xxhash64(*names), *[F.col(c).cast("string") for c in names]]
    return df.withColumn("__occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n > 1").drop("__n")


def pivoted(df: DataFrame, keys: Sequence[str], names: str, values: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Average of ``values`` for each key and each column of ``wanted``, which says the names that the column stands for.

    The names are given, so that one aggregation does it and the schema is known beforehand.
    """
    if not wanted:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(names).isin(*of), F.col(values))).alias(c) for c, of in wanted.items()])


def eta_squared(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of the value's variance that lies between groups."""
    by = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = by.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.nullif("n", F.lit(0))).alias("b"))
    mean = F.col("s") * F.col("s") / F.nullif("n", F.lit(0))
    return total.select(safe_ratio(F.col("b") - mean, F.col("q") - mean).alias("eta_squared"))


def r_squared(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.agg(F.count(actual).alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("q"), F.sum((a - p) * (a - p)).alias("e"))
    return sums.select((1 - safe_ratio(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.nullif("n", F.lit(0)))).alias("r_squared"))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the mean of its group."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(name)).withColumnsRenamed({k: f"__{k}" for k in keys})
    return df.join(means, [df[k].eqNullSafe(means[f"__{k}"]) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null share, least and greatest value of each column, in one pass; a row for each column."""
    row = df.agg(*[F.struct(F.avg(F.col(c).isNull().cast("double")).alias("null_share"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("greatest")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["null_share"].alias("null_share"), F.col(c)["least"].alias("least"), F.col(c)["greatest"].alias("greatest")) for c in columns])).alias("x")).select("x.*")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stacked(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schema_only(df: DataFrame) -> DataFrame:
    return df.limit(0)
