"""Record rules and their evaluation in one pass.

A rule marks violations by a column; NULL passes. Actions: quarantine keeps the row apart with its reasons, drop leaves
it out, warn only counts. A quarantined row isn't counted as dropped, a dropped one not as warned.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.conform import MALFORMED
from tidelake.functions.expressions import allowed_only
from tidelake.functions.names import quoted
from tidelake.operators.joins import marked, missing_reference
from tidelake.operators.relational import deduplicated
from tidelake.session import checkpointed

QUARANTINE, DROP, WARN = "quarantine", "drop", "warn"
DUPLICATE, INVALID, MISSING_REFERENCE, INCOMPLETE, SCHEMA = "duplicate", "invalid_value", "missing_reference", "incomplete", "schema"
REASONS = {QUARANTINE: "_quarantine_reasons", DROP: "_drop_reasons", WARN: "_warnings"}
TECHNICAL = (MALFORMED, *REASONS.values())


@dataclass
class Context:
    """What rules may look up: the table loaded so far, reference tables by name."""

    loaded: DataFrame | None = None
    references: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    action: str = field(default=QUARANTINE, kw_only=True)
    category = INVALID
    batch = False  # whether it needs the other rows

    @property
    def name(self) -> str:
        raise NotImplementedError

    def skip_reason(self, df: DataFrame, context: Context) -> str | None:
        """Why the rule can't be evaluated on this batch, if so."""
        try:
            df.select(self.violated())
        except AnalysisException as e:
            found = (e.getMessageParameters() or {}).get("objectName", "").strip("`")
            return f"column {found} is missing" if found else "not evaluable"
        return None

    def prepare(self, df: DataFrame, context: Context) -> DataFrame:
        return df

    def violated(self) -> Column:
        raise NotImplementedError

    @property
    def helper(self) -> str:
        return f"__{self.name}"


@dataclass(frozen=True)
class NotNull(Rule):
    column: str = ""
    category = INCOMPLETE
    name = property(lambda self: f"not_null({self.column})")

    def violated(self) -> Column:
        return F.col(quoted(self.column)).isNull()


@dataclass(frozen=True)
class Observed(NotNull):
    """A value that a join should have brought."""

    label: str = ""
    category = MISSING_REFERENCE
    name = property(lambda self: self.label)


def not_null(*columns: str, action: str = QUARANTINE) -> list[NotNull]:
    return [NotNull(c, action=action) for c in columns]


@dataclass(frozen=True)
class InRange(Rule):
    column: str = ""
    least: float | None = None
    most: float | None = None
    name = property(lambda self: f"in_range({self.column},{self._text(self.least)},{self._text(self.most)})")

    @staticmethod
    def _text(x: float | None) -> str:
        return "" if x is None else f"{x:g}"

    def violated(self) -> Column:
        c, out = F.col(quoted(self.column)), F.lit(False)
        if self.least is not None:
            out = out | (c < self.least)
        return out if self.most is None else out | (c > self.most)


@dataclass(frozen=True)
class Positive(Rule):
    column: str = ""
    name = property(lambda self: f"positive({self.column})")

    def violated(self) -> Column:
        return F.col(quoted(self.column)) <= 0


@dataclass(frozen=True)
class AllowedValues(Rule):
    column: str = ""
    values: tuple = ()
    name = property(lambda self: f"allowed_values({self.column})")

    def violated(self) -> Column:
        return ~F.col(quoted(self.column)).isin(*self.values)


@dataclass(frozen=True)
class Check(Rule):
    label: str = ""
    sql: str = ""
    name = property(lambda self: self.label)

    def violated(self) -> Column:
        return ~F.expr(self.sql)


@dataclass(frozen=True)
class WellFormed(Rule):
    category = SCHEMA
    name = property(lambda self: "well_formed")

    def violated(self) -> Column:
        return F.col(MALFORMED).isNotNull()


@dataclass(frozen=True)
class Unique(Rule):
    """All but one row of a key; the one with the fewest failed row rules is kept."""

    columns: tuple[str, ...] = ()
    category = DUPLICATE
    batch = True
    name = property(lambda self: f"unique({','.join(self.columns)})")

    def skip_reason(self, df: DataFrame, context: Context) -> str | None:
        gone = [c for c in self.columns if c not in df.columns]
        return f"column {gone[0]} is missing" if gone else None

    def prepare(self, df: DataFrame, context: Context) -> DataFrame:
        failures = sum((F.size(REASONS[a]) for a in (QUARANTINE, DROP)), F.lit(0)) if REASONS[QUARANTINE] in df.columns else F.lit(0)
        content = [c for c in df.columns if not c.startswith("_")]
        return deduplicated(df, self.columns, failures, content).withColumnRenamed("__occurrence", self.helper)

    def violated(self) -> Column:
        return F.col(quoted(self.helper)) > 1


@dataclass(frozen=True)
class NotAlreadyLoaded(Rule):
    columns: tuple[str, ...] = ()
    action: str = field(default=DROP, kw_only=True)
    category = DUPLICATE
    batch = True
    name = property(lambda self: f"not_already_loaded({','.join(self.columns)})")

    def skip_reason(self, df: DataFrame, context: Context) -> str | None:
        return "first load" if context.loaded is None else None

    def prepare(self, df: DataFrame, context: Context) -> DataFrame:
        return marked(df, context.loaded, self.columns, self.helper)

    def violated(self) -> Column:
        return F.col(quoted(self.helper))


@dataclass(frozen=True)
class ReferenceExists(Rule):
    column: str = ""
    reference: str = ""
    reference_column: str = ""
    category = MISSING_REFERENCE
    batch = True
    name = property(lambda self: f"reference_exists({self.column},{self.reference})")

    def skip_reason(self, df: DataFrame, context: Context) -> str | None:
        if self.reference not in context.references:
            return f"reference {self.reference} is missing"
        return None if self.column in df.columns else f"column {self.column} is missing"

    def prepare(self, df: DataFrame, context: Context) -> DataFrame:
        return missing_reference(df, self.column, context.references[self.reference], self.reference_column, self.helper)

    def violated(self) -> Column:
        return F.col(quoted(self.helper))


@dataclass
class Outcome:
    """Flagged rows, a result for each rule, counts of rows."""

    flagged: DataFrame
    checks: list[dict]
    total: int
    quarantined: int
    dropped: int
    warned: int

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in TECHNICAL])

    @property
    def valid(self) -> DataFrame:
        return self._plain(self.flagged.filter((F.size(REASONS[QUARANTINE]) == 0) & (F.size(REASONS[DROP]) == 0)))

    @property
    def rejected(self) -> DataFrame:
        """Quarantined rows with their reasons, those for dropping after those for quarantine."""
        rows = self.flagged.filter(F.size(REASONS[QUARANTINE]) > 0)
        return self._plain(rows.withColumn("_rejection_reasons", F.concat(REASONS[QUARANTINE], REASONS[DROP])))


def enabled() -> bool:
    return os.environ.get("PLATFORM_VALIDATION", "on").lower() not in ("0", "off", "false", "no")


def _reasons(rules: Sequence[Rule], action: str) -> Column:
    own = [F.when(r.violated(), F.lit(r.name)) for r in rules if r.action == action]
    return F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")


def flag(df: DataFrame, rules: Sequence[Rule], context: Context | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the three reason columns, and why rules were skipped. Row rules first, then those of the batch."""
    context = context or Context()
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"rules of the same name: {sorted({n for n in names if names.count(n) > 1})}")
    skipped = {r.name: why for r in rules if not r.batch and (why := r.skip_reason(df, context))}
    active = [r for r in rules if not r.batch and r.name not in skipped]
    out = df.withColumns({REASONS[a]: _reasons(active, a) for a in REASONS})
    batch = [r for r in rules if r.batch]
    for r in batch:
        if why := r.skip_reason(df, context):
            skipped[r.name] = why
    batch = [r for r in batch if r.name not in skipped]
    for r in batch:
        out = r.prepare(out, context)
    out = out.withColumns({REASONS[a]: F.concat(REASONS[a], _reasons(batch, a)) for a in REASONS})
    return out.drop(*[r.helper for r in batch]), skipped


def counts(flagged: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: numbers of rows by outcome, and of violations of each rule (``failed_<i>``), in one aggregate."""
    q, d, w = (F.size(REASONS[a]) > 0 for a in (QUARANTINE, DROP, WARN))
    return flagged.agg(
        F.count("*").alias("total"), F.count_if(q).alias("quarantined"), F.count_if(~q & d).alias("dropped"), F.count_if(~q & ~d & w).alias("warned"),
        *[F.count_if(F.array_contains(REASONS[r.action], r.name)).alias(f"failed_{i}") for i, r in enumerate(rules)],
    )


def validate(df: DataFrame, rules: Sequence[Rule], context: Context | None = None) -> Outcome:
    """Evaluates the rules. The flagged rows are checkpointed, so that they stay what they were when the tables they
    were compared with have taken them in."""
    rules = list(rules) if enabled() else []
    flagged, skipped = flag(df, rules, context)
    flagged = checkpointed(flagged)
    row = counts(flagged, rules).first()
    checks = []
    for i, r in enumerate(rules):
        failed = row[f"failed_{i}"]
        status = "skipped" if r.name in skipped else "passed" if not failed else "warning" if r.action == WARN else "info" if r.action == DROP else "failed"
        checks.append({"name": r.name, "category": r.category, "action": r.action, "status": status, "failed": failed, "note": skipped.get(r.name)})
    return Outcome(flagged, checks, row["total"], row["quarantined"], row["dropped"], row["warned"])


def reasons_counted(flagged: DataFrame, column: str) -> DataFrame:
    return flagged.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def trusted(quarantine: DataFrame, allowed: Sequence[str], key: str) -> DataFrame:
    """Quarantined rows that have no reason but allowed ones, one for each key."""
    return quarantine.filter(allowed_only(F.col("_rejection_reasons"), allowed)).dropDuplicates([key])


def empty_like(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """No rows, in the shape of the target, or of ``df``."""
    return df.sparkSession.createDataFrame([], schema) if schema is not None else df.limit(0)
