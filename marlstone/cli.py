"""Command line: plan, apply, validate, rollback, check-vision. Exit codes 0, 2 (errors), 3 (incomplete)."""

from __future__ import annotations

import argparse
import json
import sys

from .functions.scalars import endpoint_class
from .plans import plan as P
from .sources.corpus import document_hashes, vision_config


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in (("plan", ("root", "out")), ("apply", ("root", "plan", "target")), ("validate", ("root", "plan")), ("rollback", ("journal",)), ("check-vision", ())):
        sub = commands.add_parser(name)
        sub.add_argument("--json", action="store_true")
        for a in args:
            sub.add_argument(a)
    got = parser.parse_args(argv)
    if got.command == "check-vision":
        config = vision_config()
        print(json.dumps({"configured": bool(config["api_key"]), "endpoint": endpoint_class(config["base_url"]), "model": config["model"]}))
        return 0 if config["api_key"] else 2
    if got.command == "rollback":
        left = P.rollback(got.journal)
        print(json.dumps(left) if got.json else "\n".join(left) or "rolled back")
        return 3 if left else 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    try:
        if got.command == "plan":
            plan, _, summary = P.create_plan(spark, got.root)
            P.save_plan(plan, summary, got.out, document_hashes(spark, got.root))
            counts = summary.first().asDict()
            print(json.dumps(counts) if got.json else "\n".join(f"{k}: {v}" for k, v in counts.items()))
            return 0
        errors = P.validate_plan(spark, got.root, got.plan) if got.command == "validate" else []
        if got.command == "apply":
            print(P.apply_plan(spark, got.root, got.plan, got.target))
    except ValueError as e:
        errors = str(e).split("; ")
    print(json.dumps(errors) if got.json else "\n".join(errors), file=sys.stderr if errors else sys.stdout)
    return 2 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
