"""Features by name. A feature is a Column over base columns and other features; all of one depth become one select."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[], Column]
    requires: tuple[str, ...]  # columns of the snapshot grid
    needs: tuple[str, ...] = ()  # other features and helpers
    source: str = "grid"  # grid; trades or orders: aggregates joined to the grid; section: cross-sections
    helper: bool = False
    section: bool = False  # built on a window over a cross-section


FEATURES: dict[str, Feature] = {}


def feature(name: str, requires: Iterable[str] = (), needs: Iterable[str] = (), source: str = "grid", helper: bool = False, section: bool = False) -> Callable:
    """Registers a Column builder under a name; user-defined features use it too."""

    def register(build: Callable[[], Column]) -> Callable[[], Column]:
        if name in FEATURES:
            raise ValueError(f"{name} is registered already")
        FEATURES[name] = Feature(name, build, tuple(requires), tuple(needs), source, helper, section)
        return build

    return register


def available() -> list[str]:
    return sorted(n for n, f in FEATURES.items() if not f.helper)


def closure(names: Iterable[str]) -> list[list[Feature]]:
    """What the named features are built from, by depth; each is computed once however many features use it."""
    depth: dict[str, int] = {}

    def visit(name: str) -> int:
        if name not in FEATURES:
            raise KeyError(f"unknown feature {name}")
        if name not in depth:
            depth[name] = 1 + max((visit(n) for n in FEATURES[name].needs), default=-1)
        return depth[name]

    for n in names:
        visit(n)
    levels: list[list[Feature]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for n, d in depth.items():
        levels[d].append(FEATURES[n])
    return levels


def required_columns(names: Iterable[str]) -> set[str]:
    return {c for level in closure(names) for f in level for c in f.requires}


def by_stage(levels: list[list[Feature]]) -> list[list[Feature]]:
    """Levels with all that needs a cross-section last, so that data keyed by stock isn't dealt out again in between."""
    late: set[str] = set()
    for level in levels:
        late |= {f.name for f in level if f.section or late.intersection(f.needs)}
    parts = [[[f for f in level if (f.name in late) == is_late] for level in levels] for is_late in (False, True)]
    return [level for part in parts for level in part if level]


def apply(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with the named grid, trade and order features; helpers don't stay."""
    names = list(names)
    levels = closure(names)
    missing = sorted(required_columns(names) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    base = df.columns
    for level in by_stage(levels):
        df = df.withColumns({f.name: f.build() for f in level if f.name not in base})
    return df.select(*base, *[n for n in names if n not in base])
