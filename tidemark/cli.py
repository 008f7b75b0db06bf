"""Command line: list and run queries, snapshots, quality gates and backtests.

Exit code 1 is a failed gate, 2 a wrong configuration.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import backtest as BT, plans
from .operators import corpus, graph, market
from .session import session
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and show or write it")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out")
    snap = sub.add_parser("snapshot", help="the graph as of a day")
    snap.add_argument("folder")
    snap.add_argument("asof")
    snap.add_argument("--window", type=int, default=90)
    snap.add_argument("--half-life", type=float)
    snap.add_argument("--undirected", action="store_true")
    snap.add_argument("--top", type=int, default=20)
    gate = sub.add_parser("validate", help="quality checks of the corpus")
    gate.add_argument("folder")
    back = sub.add_parser("backtest", help="a walk-forward backtest")
    back.add_argument("folder")
    back.add_argument("model", help="a shipped model, module:function or file.py:function")
    back.add_argument("--every", default="quarter")
    back.add_argument("--days", type=int, default=250)
    back.add_argument("--max-weight", type=float, default=0.25)
    back.add_argument("--cost", type=float, default=0.001)
    back.add_argument("--coverage", type=float, default=0.2)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    if a.command == "run" and a.name not in plans.QUERIES:
        print(f"no query {a.name}", file=sys.stderr)
        return 2
    spark = session(a.master)
    if a.command == "run":
        df = plans.QUERIES[a.name](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(50, False)
    elif a.command == "snapshot":
        edges = graph.snapshot(tables.graph_events(spark, a.folder), a.asof, a.window, a.half_life, not a.undirected)
        edges.orderBy(F.abs("w_decay").desc(), "src", "dst").show(a.top, False)
    elif a.command == "validate":
        raw = tables.raw_news(spark, a.folder)
        checks = corpus.checks(corpus.documents(raw), corpus.document_mentions(raw)).collect()  # a row a check
        for c in checks:
            print(f"{'ok  ' if c.ok else 'FAIL'} {c.check}: {c.detail}")
        return 0 if all(c.ok for c in checks) else 1
    elif a.command == "backtest":
        px = tables.prices(spark, a.folder)
        cal = market.trading_calendar(px)
        returns = market.flagged_returns(px, cal).select("ticker", "date", "cal_i", "ret")
        at = BT.dates_of(cal, a.every)
        w = BT.target_weights(returns, at, BT.load_model(a.model), a.days, a.coverage, high=a.max_weight)
        daily, _ = BT.hold(returns, w, at, a.cost)
        market.performance(daily.select(F.lit(a.model).alias("ticker"), "date", F.col("net").alias("ret"))).show(1, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
