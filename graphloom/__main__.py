"""``python -m graphloom index ROOT FOLDER`` and questions to a folder; answers are JSON envelopes."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .api import SymbolGraph


def envelope(tool: str, **payload) -> str:
    return json.dumps({"schemaVersion": 1, "tool": tool, **payload}, default=str)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="tool", required=True)
    add = lambda name, *args: [(s := sub.add_parser(name)).add_argument("folder"), *(s.add_argument(a, nargs="+" if a == "changed" else None) for a in args)]
    i = sub.add_parser("index")
    i.add_argument("root")
    i.add_argument("folder")
    for name in ("callers", "callees", "usages", "impact"):
        add(name, "symbol")
    add("search", "text")
    add("context", "question")
    add("explain", "source", "target", "kind")
    add("affected", "changed")
    add("diff", "other")
    for name in ("dead-code", "cycles", "duplicates", "files", "status"):
        add(name)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.tool == "index":
        print(envelope("index", **SymbolGraph.index(spark, a.root, a.folder).status()))
        return 0
    g = SymbolGraph.open(spark, a.folder)
    calls = {
        "callers": lambda: g.callers(a.symbol),
        "callees": lambda: g.callees(a.symbol),
        "usages": lambda: g.usages(a.symbol),
        "impact": lambda: g.impact(a.symbol),
        "search": lambda: g.search(a.text),
        "context": lambda: g.context(a.question),
        "explain": lambda: g.explain(a.source, a.target, a.kind),
        "affected": lambda: g.affected(a.changed),
        "dead-code": g.dead_code,
        "cycles": g.cycles,
        "duplicates": g.duplicates,
        "files": g.list_files,
        "status": g.status,
        "diff": lambda: g.diff(SymbolGraph.open(spark, a.other)),
    }
    out = calls[a.tool]()
    rows = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
    payload = {"results": rows(out)} if isinstance(out, DataFrame) else {k: rows(v) if isinstance(v, DataFrame) else v for k, v in out.items()}
    print(envelope(a.tool, **payload))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
