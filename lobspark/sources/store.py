"""Feature store: wide rows (date, timestamp, SecurityID, one column a feature) by universe, set of features and date.

A set is what was written together; its columns carry the hash of the feature's code, so that a changed formula doesn't read what
doesn't belong to it, and the universe is part of the path. Reading prunes to the columns and dates asked for and joins on
the keys alone. Where several sets hold a feature's day, the latest one counts.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import FEATURES, closure

KEYS = ["date", "timestamp", "SecurityID"]
#: Parts of a day, by stock.
PARTS = 8


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str, universe: str = "all") -> None:
        self.spark, self.root, self.universe = spark, root.rstrip("/"), universe

    def version(self, name: str) -> str:
        code = [name]
        if name in FEATURES:
            for f in sorted((f for level in closure([name]) for f in level), key=lambda f: f.name):
                code += [f.name, inspect.getsource(f.build)]
        return hashlib.sha256("\n".join(code).encode()).hexdigest()[:12]

    def _column(self, name: str) -> str:
        return f"{name}@{self.version(name)}"

    def _places(self) -> dict[tuple[str, str], str]:
        """The folder of the set that holds (feature, date) in today's version, from one listing and a footer a set."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/universe={self.universe}/set=*/date=*")
        found = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
        days = sorted((f.getModificationTime(), f.getPath().getParent().toString(), f.getPath().getName().split("=", 1)[1]) for f in found)
        names = {folder: [c.split("@") for c in self.spark.read.parquet(folder).columns if "@" in c] for folder in {d[1] for d in days}}
        today = {n: self.version(n) for n in {n for held in names.values() for n, _ in held}}
        return {(n, date): folder for _, folder, date in days for n, version in names[folder] if version == today[n]}

    def held(self) -> set[tuple[str, str]]:
        """(feature, date) of all that is stored in today's versions."""
        return set(self._places())

    def exists(self, name: str, date: str | None = None) -> bool:
        return any(n == name and date in (None, d) for n, d in self._places())

    def write(self, df: DataFrame, *names: str) -> None:
        """Stores the named features of the dates that df has, in one job; these dates' older values don't count any more."""
        columns = sorted(self._column(n) for n in names)
        own = hashlib.sha256("\n".join(columns).encode()).hexdigest()[:12]
        rows = df.select(*KEYS, *[F.col(n).cast("double").alias(self._column(n)) for n in names])
        rows = rows.repartition("date", F.pmod(F.xxhash64("SecurityID"), F.lit(PARTS)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("date").parquet(f"{self.root}/universe={self.universe}/set={own}")

    def _sets(self, names: tuple[str, ...]) -> list[tuple[DataFrame, dict[str, list[str]]]]:
        """For each set that is needed its rows, and the dates for which each feature comes from it."""
        need: dict[str, dict[str, list[str]]] = {}
        for (n, date), folder in self._places().items():
            if n in names:
                need.setdefault(folder, {}).setdefault(n, []).append(date)
        out = []
        for folder, wanted in sorted(need.items()):
            rows = self.spark.read.parquet(folder).withColumn("date", F.col("date").cast("string"))
            rows = rows.where(F.col("date").isin(sorted({d for dates in wanted.values() for d in dates})))
            every = {d for dates in wanted.values() for d in dates}
            value = lambda n: F.col(f"`{self._column(n)}`") if set(wanted[n]) == every else F.when(F.col("date").isin(wanted[n]), F.col(f"`{self._column(n)}`"))  # noqa: B023, E731
            out.append((rows.select(*KEYS, *[value(n).alias(n) for n in wanted]), wanted))
        return out

    def read(self, name: str) -> DataFrame:
        """(date, timestamp, SecurityID, value) of a feature where it isn't null."""
        parts = [rows.where(F.col("date").isin(wanted[name])).select(*KEYS, F.col(name).alias("value")) for rows, wanted in self._sets((name,))]
        if not parts:
            raise FileNotFoundError(f"{self.root}: {name}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("value IS NOT NULL")

    def join(self, df: DataFrame, *names: str) -> DataFrame:
        """df with the stored features, by date, timestamp and stock: one join for each set; what isn't stored is null."""
        out, found = df.drop(*names), {n: [] for n in names}
        for k, (rows, wanted) in enumerate(self._sets(names)):
            out = out.join(rows.withColumnsRenamed({n: f"__{k}_{n}" for n in wanted}), KEYS, "left")
            for n in wanted:
                found[n].append(F.col(f"__{k}_{n}"))
        columns = [F.coalesce(*found[n]).alias(n) if found[n] else F.lit(None).cast("double").alias(n) for n in names]
        return out.select(*[c for c in df.columns if c not in names], *columns)
