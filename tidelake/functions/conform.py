"""Type conformance that loses nothing unnoticed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MALFORMED = "_malformed_values"
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def conformed(raw: Column, source: T.DataType, target: T.DataType) -> tuple[Column, Column]:
    """(value in the target type, whether a value was lost or changed). Casts that fail give NULL, never an error."""
    if source == target:
        return raw, F.lit(False)
    if isinstance(target, INTEGRAL) and isinstance(source, (T.StringType, T.FloatType, T.DoubleType, T.DecimalType)):
        number = raw.try_cast("double")
        direct = raw.try_cast(target) if isinstance(source, T.StringType) else F.lit(None).cast(target)
        value = F.coalesce(direct, number.try_cast(target))
        changed = direct.isNull() & value.isNotNull() & (number != value.cast("double"))
        lost = raw.isNotNull() & (value.isNull() | F.coalesce(changed, F.lit(False)))
        return F.when(~lost, value), lost
    value = raw.try_cast(target)
    if isinstance(source, INTEGRAL) and isinstance(target, INTEGRAL):
        return value, raw.isNotNull() & (value.isNull() | (value.cast("long") != raw.cast("long")))
    return value, raw.isNotNull() & value.isNull()


def conform_types(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """``df`` with the given types, and a column naming the values that didn't fit as ``column=raw``, joined by ``; ``.

    One projection; a value that doesn't fit becomes NULL. Columns not named pass through; an existing report is kept
    in front.
    """
    out, reports = [], []
    if MALFORMED in df.columns:
        reports.append(F.col(MALFORMED))
    for field in df.schema:
        if field.name == MALFORMED:
            continue
        raw = F.col("`" + field.name.replace("`", "``") + "`")
        if field.name not in types:
            out.append(raw)
            continue
        value, lost = conformed(raw, field.dataType, types[field.name])
        out.append(value.alias(field.name))
        if field.dataType != types[field.name]:
            reports.append(F.when(lost, F.concat(F.lit(f"{field.name}="), raw.cast("string"))))
    joined = F.concat_ws("; ", *reports) if reports else F.lit("")
    return df.select(*out, F.when(joined != "", joined).alias(MALFORMED))
