"""Which products need which months anew, decided from metadata alone."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from tidelake.plans.pipeline import Workspace
from tidelake.plans.products import MIN_MONTH_TRIPS, PRODUCTS, Month, Product, Registry, refresh, source_columns, window_of

SKIP, FULL, INCREMENTAL, BLOCKED = "skip", "full", "incremental", "blocked"


@dataclass(frozen=True)
class Plan:
    product: str
    action: str
    reason: str
    months: frozenset[Month] = frozenset()


def plan_product(
    product: Product, columns: dict[str, str], source_version: int, entry: dict | None, stored: set[Month] | None, window: set[Month], changed: set[Month] | None,
) -> Plan:
    """The first that fits decides. ``columns``: of the source now; ``stored``: months that the product holds, None if
    there is no table; ``changed``: months that changed since the entry's version, None if the log doesn't tell."""
    lost = [c for c in product.required if c not in columns]
    if lost:
        return Plan(product.name, BLOCKED, f"the source lost {', '.join(lost)}")
    if entry is None or stored is None:
        return Plan(product.name, FULL, "not built yet")
    if entry["schema_version"] != product.version:
        return Plan(product.name, FULL, f"version {entry['schema_version']} became {product.version}")
    before = json.loads(entry["source_columns"] or "{}")
    if not before:
        return Plan(product.name, FULL, "no schema on record")
    retyped = [c for c, t in before.items() if c in columns and columns[c] != t]
    if retyped:
        return Plan(product.name, FULL, f"type of {', '.join(retyped)} changed")
    if source_version <= entry["source_version"]:
        return Plan(product.name, SKIP, "up to date")
    if changed is None:
        return Plan(product.name, FULL, "history is gone")
    affected = (changed & (window | stored)) | (window - stored)
    if not affected:
        return Plan(product.name, SKIP, "no month of the window changed")
    return Plan(product.name, INCREMENTAL, f"{len(affected)} months", frozenset(affected))


def build_plan(ws: Workspace, names: Sequence[str] | None = None, least: int = MIN_MONTH_TRIPS) -> tuple[list[Plan], set[Month]]:
    source, registry = ws.table("integrated_taxi_trips"), Registry(ws)
    version, window, schema, plans = source.latest_version(), window_of(source.detail(), least), source.schema(), []
    for name in names or PRODUCTS:
        product, entry, target = PRODUCTS[name], registry.entry(name), ws.product(name)
        stored = {(int(y), int(m)) for y, m in target.detail()["partitions"]} if target.exists() else None
        changed = None
        if entry:
            found = source.changed_partitions(entry["source_version"], version)
            changed = None if found is None else {p for p in found if all(isinstance(x, int) for x in p)}
        plans.append(plan_product(product, source_columns(schema, product) | {f.name: f.dataType.simpleString() for f in schema}, version, entry, stored, window, changed))
    return plans, window


def execute_plan(ws: Workspace, plans: Sequence[Plan], window: set[Month]) -> list[dict]:
    """Products with the same months share one cached slice."""
    groups: dict[frozenset[Month] | None, list[Product]] = {}
    for p in plans:
        if p.action in (FULL, INCREMENTAL):
            groups.setdefault(None if p.action == FULL else p.months, []).append(PRODUCTS[p.product])
    out = []
    for months, products in groups.items():
        reasons = {p.product: p.reason for p in plans}
        out += refresh(ws, products, window, None if months is None else set(months), reason="; ".join(dict.fromkeys(reasons[p.name] for p in products)))
    return out


def refresh_affected(ws: Workspace, names: Sequence[str] | None = None, dry_run: bool = False, force_full: bool = False, least: int = MIN_MONTH_TRIPS) -> list[Plan]:
    plans, window = build_plan(ws, names, least)
    if force_full:
        plans = [p if p.action == BLOCKED else Plan(p.product, FULL, "asked for") for p in plans]
    if not dry_run:
        execute_plan(ws, plans, window)
    return plans
