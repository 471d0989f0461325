"""Plans: features, labels, training and evaluation over a data root or given tables."""

from __future__ import annotations

import hashlib
import inspect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import book, evaluate, labels, limits, model, moments, ofi, orders, pca, registry, trades  # noqa: F401  registers all features
from ..operators.registry import FEATURES, Feature
from ..sources import scratch
from ..sources.market import MarketData
from ..sources.store import FeatureStore

for _name in pca.OUTPUTS:
    FEATURES.setdefault(_name, Feature(_name, lambda: None, (), pca.INPUTS, "section"))


def available() -> list[str]:
    return registry.available()


def compute(grid: DataFrame, names: list[str] | None = None, trade_rows: DataFrame | None = None, order_rows: DataFrame | None = None, days: list[str] | None = None, aggregates: dict[str, DataFrame] | None = None) -> DataFrame:
    """grid with the named features (all by default), batched by window.

    grid: snapshots with secs, mid_price. Work keyed by stock comes first, then what is keyed by cross-section. days: all
    trading days, if they are known. aggregates: those of trades or orders by bucket, where they have been made already.
    """
    names = list(names or available())
    for n in names:
        if n not in FEATURES:
            raise KeyError(f"unknown feature {n}")
    section = [n for n in names if FEATURES[n].source == "section"]
    plain = [n for n in names if n not in section]
    extra = [x for x in pca.INPUTS if section and x not in plain]
    sources = {f.source for level in registry.closure(plain) for f in level}
    df, base = grid, grid.columns
    for source, rows, kind in (("trades", trade_rows, trades), ("orders", order_rows, orders)):
        if source in sources:
            made = (aggregates or {}).get(source)
            if rows is None and made is None:
                raise KeyError(f"{source} are needed")
            df = trades.join_grid(df, made if made is not None else kind.aggregate(rows, grid, days))
    df = registry.apply(df, [*plain, *extra])
    if section:
        df = pca.add_pca(df)
    return df.select(*base, *names)


@dataclass
class Factory:
    """Features over a data root, with an optional store.

    Aggregates of trades and orders are made once for the dates asked for and written; all later calls and actions of the session
    read them instead of the tick files, also when executors are lost. forget() removes them.
    """

    data: MarketData
    store: FeatureStore | None = None
    made: dict[tuple, DataFrame] = field(default_factory=dict)

    def grid(self, names: list[str], dates: list[str]) -> DataFrame:
        needed = {c for level in registry.closure(names) for f in level for c in f.requires}
        aggregates = {*trades.AMOUNTS, *trades.COUNTS, *trades.OTHERS, "mid_price", "secs"} | {c for c in needed if c.endswith("_cnt") or c.startswith(("new_", "cancel_", "large_", "depth_", "avg_"))}
        df = self.data.snapshots(sorted(needed - aggregates - {"SecurityID", "date", "timestamp"}))
        return labels.add_labels(df.where(df["date"].isin(dates)))

    def compute(self, dates: list[str], names: list[str] | None = None) -> DataFrame:
        """Labels and features of the dates. Stored features are joined, the others computed and stored."""
        names = list(names or available())
        stored = self.store.held() if self.store else set()
        held = [n for n in names if self.store and all((n, d) in stored for d in dates)]
        rest = [n for n in names if n not in held]
        df = grid = self.grid([n for n in names if FEATURES[n].source != "section"] + (list(pca.INPUTS) if set(names) & set(pca.OUTPUTS) else []), dates)
        if rest:
            sources = {f.source for level in registry.closure([n for n in rest if FEATURES[n].source != "section"]) for f in level}
            df = compute(df, rest, aggregates={s: self.aggregated(s, dates) for s in ("trades", "orders") if s in sources})
            if self.store:  # written once, and read back by whoever asks for the result
                self.store.write(df, *rest)
                df, held = grid, names
        return self.store.join(df, *held).select(*grid.columns, *names) if held else df

    def aggregated(self, source: str, dates: list[str]) -> DataFrame:
        """The aggregates of trades or orders of the dates by bucket, written by the first call that needs them.

        Those of a superset of the dates serve as well. They are made anew when the code that makes them changes.
        """
        kind = {"trades": trades, "orders": orders}[source]
        version = hashlib.sha256(inspect.getsource(kind).encode()).hexdigest()[:12]
        for (name, held, made), df in self.made.items():
            if name == source and made == version and held.issuperset(dates):
                return df.where(F.col("date").isin(dates)) if held != set(dates) else df
        days = self._with_previous(dates)
        rows = getattr(self.data, source)()
        book = self.data.snapshots(["BidPrice1", "AskPrice1"])
        book = book.where(F.col("date").isin(dates)).select("SecurityID", "date", "timestamp", "secs", "BidPrice1", "AskPrice1")
        found = kind.aggregate(rows.where(F.col("date").isin(days)), book.withColumn("mid_price", labels.mid_price()), days)
        out = scratch.written(found.where(F.col("date").isin(dates)), source)
        self.made[source, frozenset(dates), version] = out
        return out

    def forget(self) -> None:
        """Removes the written aggregates; nothing lazy may read them any more."""
        for df in self.made.values():
            scratch.drop(df)
        self.made.clear()

    def _with_previous(self, dates: list[str]) -> list[str]:
        """The dates and the trading day before the first, which large-trade thresholds need."""
        all_dates = self.data.dates()
        first = all_dates.index(min(dates)) if min(dates) in all_dates else 0
        return sorted({*dates, *all_dates[max(0, first - 1) : first]})


def run_day(factory: Factory, date: str, names: list[str] | None = None) -> dict:
    """One day's frame with labels and features, and its counts."""
    df = factory.compute([date], names)
    counts = df.agg(F.count("*").alias("rows"), F.count_distinct("SecurityID").alias("stocks")).first()
    return {"df": df, "features": list(names or available()), "rows": counts["rows"], "stocks": counts["stocks"]}


def run_range(factory: Factory, start: str, end: str, target: str = "ret_15s", names: list[str] | None = None, folds: int = 1, **options: object) -> dict:
    """Walk-forward training and the rank correlations of all horizons on the test dates. options: those of AlphaModel."""
    names = list(names or available())
    dates = factory.data.dates(start, end)
    parts = model.walk_forward(dates, folds)
    if not parts:
        raise SystemExit(f"{len(dates)} dates are too few for a fold")
    df = model.add_stock_id(factory.compute(dates, names))
    predicted = model.fit_walk_forward(df, model.AlphaModel(names, target, **options), parts)
    horizons = [c for c in df.columns if c.startswith("ret_")]
    return {k: evaluate.by_horizon(p, "prediction", horizons) for k, p in predicted.items()}
