"""Keys, buckets, ratios and statistics as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*columns: str | Column, null_token: str | None = None) -> Column:
    """md5 of the joined columns. NULLs are skipped, unless ``null_token`` stands for them so that keys can't collide."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if null_token is not None:
        cols = [F.coalesce(c.cast("string"), F.lit(null_token)) for c in cols]
    return F.md5(F.concat_ws("||", *cols))


def category(code: Column, groups: dict[str, Sequence[int]], default: str = "Unknown") -> Column:
    """Name of the group that holds the code."""
    out = F
    for name, codes in groups.items():
        out = out.when(code.isin(*codes), F.lit(name))
    return out.otherwise(F.lit(default))


def band(value: Column, bounds: Sequence[tuple[float, str]], default: str) -> Column:
    """Name of the first bound that the value is below; NULL is of the default band."""
    out = F
    for bound, name in bounds:
        out = out.when(value < bound, F.lit(name))
    return out.otherwise(F.lit(default))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0))


#: Places of decimals that sums of doubles go through, and the size below which a value would lose digits in them.
PLACES, LEAST = 18, 1e-6


def exact_sum(value: Column, places: int | None = None) -> Column:
    """A sum of doubles that doesn't depend on the order in which tasks finish: through decimals of 18 places, or of
    ``places`` where values are known to have no more.

    Where a value doesn't fit them (NaN, infinite, too large, or too small to keep its digits), and where the sum doesn't, it
    is the plain sum of doubles. NULLs are left out; without values the sum is NULL.
    """
    number = value.cast("double")
    exact = value.try_cast(f"decimal(38,{PLACES if places is None else places})")
    unfit = value.isNotNull() & exact.isNull()
    if places is None:
        unfit = unfit | ((number != 0) & (F.abs(number) < LEAST))
    plain = F.sum(number)
    return F.when(F.coalesce(F.bool_or(unfit), F.lit(False)), plain).otherwise(F.coalesce(F.try_sum(exact).cast("double"), plain))


def exact_avg(value: Column, places: int | None = None) -> Column:
    return safe_ratio(exact_sum(value, places), F.count(value).cast("double"))


def sample_stddev(n: Column, total: Column, squares: Column) -> Column:
    """From count, sum and sum of squares, which add up over partitions; NULL for one row or none."""
    return F.when(n > 1, F.sqrt(F.greatest(squares - total * total / F.nullif(n, F.lit(0)), F.lit(0.0)) / F.nullif(n - 1, F.lit(0))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both; NULL where one of them is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return safe_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def month_predicate(months: Iterable[tuple[int, int]], year: str = "year", month: str = "month") -> str:
    """SQL predicate over partition columns; FALSE for no month."""
    by_year: dict[int, list[int]] = {}
    for y, m in sorted(set(months)):
        by_year.setdefault(y, []).append(m)
    return " OR ".join(f"({year} = {y} AND {month} IN ({', '.join(map(str, ms))}))" for y, ms in by_year.items()) or "FALSE"


def null_share(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double"))


def allowed_only(reasons: Column, allowed: Sequence[str]) -> Column:
    """Whether there are no reasons but allowed ones."""
    return F.size(F.array_except(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]))) == 0
