"""Reading raw files by column name, describing sources, simulated releases."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.conform import conform_types
from tidelake.functions.names import normalized, quoted


def read(spark: SparkSession, path: str | list[str], kind: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows with normalised names. CSV is read as text, bound by its header and then given the declared types, with a
    report of values that don't fit; undeclared columns stay text. Parquet keeps its own types."""
    if kind == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    elif kind == "parquet":
        raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        raise ValueError(f"unknown kind of source: {kind}")
    named = raw.select(*[F.col(quoted(c)).alias(normalized(c)) for c in raw.columns])
    if kind == "parquet" or schema is None:
        return named
    types = {normalized(f.name): f.dataType for f in schema}
    return conform_types(named, {c: t for c, t in types.items() if c in named.columns})


def normalized_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(normalized(f.name), f.dataType, True) for f in schema])


def describe_source(df: DataFrame, most: int = 3) -> str:
    """Base names of the first few input files."""
    names = sorted({os.path.basename(p) for p in df.inputFiles()})
    return ", ".join(names[:most]) + (f" and {len(names) - most} more" if len(names) > most else "")


def shifted_release(df: DataFrame, ts_columns: list[str], months: int, value_columns: list[str], seed: int, duplicates: float = 0.0) -> DataFrame:
    """A simulated later release: times moved by months, values jittered by up to 5 percent, some rows delivered twice.

    All randomness is a hash of the row and the seed, so a release is the same whenever it is made.
    """
    noise = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), *df.columns), F.lit(1_000_000)) / 1_000_000.0)
    out = df
    for c in ts_columns:
        out = out.withColumn(c, (F.col(c) + F.make_ym_interval(F.lit(0), F.lit(months))).cast("timestamp_ntz"))
    moved = out.withColumns({c: F.col(c) * (0.95 + 0.1 * noise(i)) for i, c in enumerate(value_columns)})
    return moved if not duplicates else moved.unionAll(moved.filter(F.pmod(F.xxhash64(F.lit(seed), *moved.columns), F.lit(1000)) < int(1000 * duplicates)))


def scaled(column: str, least: float, greatest: float) -> Column:
    """Min-max index from 0 to 500."""
    return (500 * (F.col(column) - least) / (greatest - least if greatest != least else 1.0)).cast("int")
