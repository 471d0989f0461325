"""python -m lobspark DATA_ROOT (--date D | --start A --end B) [--target ret_15s] [--features F ...] [--no-cache] [--store DIR]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.evaluate import decay_table, report
from .plans.factory import Factory, available, run_day, run_range
from .sources.market import MarketData
from .sources.store import FeatureStore


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lobspark", description=__doc__)
    p.add_argument("root")
    p.add_argument("--date")
    p.add_argument("--start", default="00000000")
    p.add_argument("--end", default="99999999")
    p.add_argument("--target", default="ret_15s")
    p.add_argument("--features", nargs="*", default=None)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--store", default=None)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lobspark").config("spark.sql.requireAllClusterKeysForCoPartition", "false").getOrCreate()
    store = FeatureStore(spark, args.store or f"{args.root.rstrip('/')}/features")
    factory = Factory(MarketData(spark, args.root), None if args.no_cache else store)
    names = args.features or available()
    if args.date:
        got = run_day(factory, args.date, names)
        print(f"{args.date}: {got['rows']} rows, {got['stocks']} stocks, {len(names)} features")
        return
    for fold, summary in run_range(factory, args.start, args.end, args.target, names).items():
        print(f"fold {fold}\n{decay_table(report(summary))}")


if __name__ == "__main__":
    main()
