"""Command line: python -m tidelake.cli --root DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from tidelake import session
from tidelake.functions.expressions import month_predicate
from tidelake.plans import evaluation, ledger, ml, products, refresh, rules
from tidelake.plans.pipeline import Workspace, load_updates
from tidelake.sources.readers import read
from tidelake.sources.table import pinned


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelake")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("update", help="load a release; NAME=KIND:PATH for each dataset")
    c.add_argument("sources", nargs="+")
    c.add_argument("--no-refresh", action="store_true")
    c = sub.add_parser("evaluate", help="load a release under several settings, then for good; refresh and measure")
    c.add_argument("sources", nargs="+")
    c.add_argument("--reps", type=int, default=3, help="trials for each setting")
    c.add_argument("--skip-trials", action="store_true")
    c.add_argument("--results", default="evaluation.json")
    c = sub.add_parser("tune", help="caching, pruning, broadcasting and adaptive execution, each with and without")
    c.add_argument("--month", required=True, help="YYYY-MM of the pruning pair")
    c.add_argument("--plans", action="store_true", help="print the plans, too")
    c = sub.add_parser("products")
    c.add_argument("--product", action="append")
    c.add_argument("--month", action="append", help="YYYY-MM")
    c.add_argument("--no-cache", action="store_true")
    c = sub.add_parser("refresh")
    c.add_argument("--product", action="append")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--full", action="store_true")
    c.add_argument("--verify", action="store_true")
    c = sub.add_parser("monitor")
    c.add_argument("--query", choices=sorted(ledger.QUERIES))
    c = sub.add_parser("validation")
    c.add_argument("--samples", type=int, default=0)
    c = sub.add_parser("dataset")
    c.add_argument("--start", type=datetime.fromisoformat)
    c.add_argument("--end", type=datetime.fromisoformat)
    c.add_argument("--source-version", type=int)
    c.add_argument("--manifest", help="where the facts about the dataset go")
    c = sub.add_parser("features")
    c.add_argument("--no-probe", action="store_true")
    sub.add_parser("train")
    return p


def release(ws: Workspace, sources: list[str]) -> dict:
    from tidelake.plans.contracts import contract

    raw = {}
    for item in sources:
        name, _, rest = item.partition("=")
        kind, _, path = rest.partition(":")
        raw[name] = read(ws.spark, path, kind, contract(name).declared)
    return raw


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    ws = Workspace(session.session(), args.root)
    chosen = [products.PRODUCTS[n] for n in (getattr(args, "product", None) or products.PRODUCTS)]
    if args.command == "update":
        print(json.dumps(load_updates(ws, release(ws, args.sources)), default=str, indent=2))
        if not args.no_refresh:
            print(*refresh.refresh_affected(ws), sep="\n")
    elif args.command == "evaluate":
        found = evaluation.evaluate(ws, release(ws, args.sources), args.reps, not args.skip_trials)
        ml.manifest(args.results, **found)
        print(json.dumps(found, default=str, indent=2))
    elif args.command == "tune":
        year, month = map(int, args.month.split("-"))
        for name, runs in evaluation.tuning(ws.table("trip_data").read(), ws.table("taxi_zones").read(), year, month).items():
            for r in runs:
                print(name, r.setting, r.seconds, sep="\t")
                if args.plans:
                    print(r.plan)
    elif args.command == "products":
        window = products.window_of(ws.table("integrated_taxi_trips").detail())
        months = {tuple(map(int, m.split("-"))) for m in args.month} if args.month else None
        print(*products.refresh(ws, chosen, window, months, not args.no_cache), sep="\n")
    elif args.command == "refresh":
        print(*refresh.refresh_affected(ws, args.product, args.dry_run, args.full), sep="\n")
        if args.verify:
            print(products.verify(ws, chosen, products.window_of(ws.table("integrated_taxi_trips").detail())))
    elif args.command == "monitor":
        for name in [args.query] if args.query else ledger.QUERIES:
            query, which = ledger.QUERIES[name]
            print(name)
            query(getattr(ws.ledger, which).read()).show(50, False)
    elif args.command == "validation":
        ledger.latest_results(ws.ledger.runs.read(), ws.ledger.checks.read()).show(200, False)
        ledger.category_totals(ws.ledger.checks.read()).show(200, False)
        for name in ("weather", "air_quality", "taxi_zones", "trip_data", "integrated_taxi_trips"):
            if ws.quarantine(name).exists():
                rows = ws.quarantine(name).read()
                rules.reasons_counted(rows, "_rejection_reasons").show(200, False)
                if args.samples:
                    rows.show(args.samples, False)
    elif args.command == "dataset":
        config = ml.DatasetConfig(start=args.start, end=args.end)
        main_table, others = ws.table("integrated_taxi_trips"), {"taxi_zones": ws.table("taxi_zones")}
        if config.trusted_reasons and ws.quarantine("trip_data").exists():
            others["quarantine/trip_data"] = ws.quarantine("trip_data")
        versions, notes = pinned(main_table, others, args.source_version)
        months = sorted(products.window_of(main_table.detail(versions["main"])))
        trips = main_table.read(versions["main"]).filter(month_predicate(months))
        start, end = ml.resolve_window(trips, config, months)
        more = None
        if "quarantine/trip_data" in others:
            more = ml.quarantined_pickups(others["quarantine/trip_data"].read(versions["quarantine/trip_data"]).filter(month_predicate(months)), config.trusted_reasons)
        built = ml.build_dataset(trips, others["taxi_zones"].read(versions["taxi_zones"]), start, end, config, more)
        target = ws.product("training_dataset")
        target.overwrite(built, ["split"]) if target.exists() else target.create(built, ["split"])
        stored = target.read()
        splits = [r.asDict() for r in ml.split_summary(stored, config.target, [*config.hourly, *config.lag_columns]).collect()]  # three rows
        facts = {"dataset": config.name, "version": target.latest_version(), "sources": versions, "notes": notes, "window": [start, end], "splits": splits, "signal": ml.signal(stored, config), "columns": ml.column_dictionary(stored, {}), "config": config}
        ml.manifest(args.manifest or f"{config.name}.json", **facts)
        print(json.dumps(splits, default=str, indent=2))
    else:
        data, config = ws.product("training_dataset").read(), ml.FeatureConfig()
        if args.command == "train":
            print(json.dumps(ml.train_model(data, config, f"{args.root}/models/gbt")[1], indent=2))
        else:
            model, plan = ml.fit_features(data, config)
            ready = model.transform(data)
            target = ws.product("features")
            rows = ready.select("pickup_hour", "pulocationid", config.target, "features", "split")
            target.overwrite(rows, ["split"]) if target.exists() else target.create(rows, ["split"])
            model.write().overwrite().save(f"{args.root}/models/features")
            print(plan)
            if not args.no_probe:
                print(json.dumps(ml.importance_probe(ready, config.target), indent=2))


if __name__ == "__main__":
    main()
