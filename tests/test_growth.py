"""What a step costs must grow no faster than its input: copies of rows, scans, exchanges, entries of a state."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from lobspark.functions import curves
from lobspark.operators import boosting, evaluate, overlap, sketches
from lobspark.plans import catalog
from lobspark.sources import adapters, layout
from lobspark.streaming import asof

SMALL = "/root/testdata/sf0.001"


def nodes(df, name):
    """Operators of the plan before it runs, by the beginning of their name."""
    text = df._jdf.queryExecution().sparkPlan().toString() if name == "Window" else df._jdf.queryExecution().executedPlan().toString()
    return sum(line.lstrip(" :+-*()0123456789").startswith(name) for line in text.split("== Initial Plan ==")[-1].splitlines())


def test_spans_are_copied_for_levels_that_the_other_side_has(spark, monkeypatch):
    """One quote over the midday break among short ones: rows aren't copied to all levels between."""
    left = spark.range(400).selectExpr("'a' as k", "id as x", "id * 20D as b", "id * 20D + 1 as e")
    right = spark.range(400).selectExpr("'a' as k", "id as y", "id * 20D as b2", "id * 20D + if(id = 200, 5400, 1) as e2")
    seen, real = [], overlap._parted
    monkeypatch.setattr(overlap, "_parted", lambda a, b, *rest: seen.append((a.count(), b.count())) or real(a, b, *rest))
    got = overlap.overlapping(left, right, ["k"], (F.col("b"), F.col("e")), (F.col("b2"), F.col("e2")), 2.0, 50).count()
    assert got == 400 + 199 and max(seen[0]) < 3 * 400


def test_a_call_adds_one_entry_to_a_state():
    class Rows(list):
        def get(self):
            return iter(self)

        def put(self, rows):
            self[:] = rows

        def appendList(self, rows):  # noqa: N802
            self.extend(rows)

        def exists(self):
            return False

        def update(self, _):
            pass

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Rows()

        getValueState = getListState  # noqa: N815

        def registerTimer(self, _):  # noqa: N802
            pass

    class Values:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    p = asof._AsOf([StructField("bid", DoubleType()), StructField("no", LongType())], ["no"], ["bid"])
    p.init(Handle())
    at = pd.Timestamp("2024-01-02 09:30")
    frame = pd.DataFrame({"SecurityID": [str(k % 7) for k in range(600)], "date": "d", "ts": at, "stream_side": [k % 2 for k in range(600)], "bid": 1.0, "no": range(600)})
    list(p.handleInputRows((0,), iter([frame]), Values()))
    assert len(p.book) == len(p.waiting) == 1
    assert len(p._frame(p.book)) == 300 and sorted(p._frame(p.waiting)["no"]) == list(range(1, 600, 2))


def test_a_view_is_dealt_out_once_and_by_its_size(spark):
    assert adapters.parts(spark, SMALL, rows=100, least=1) == 60 and adapters.parts(spark, SMALL, rows=10**6, least=3) == 3
    assert nodes(catalog.QUERIES["order_flow"](spark, SMALL), "Exchange") == 1
    assert nodes(catalog.QUERIES["as_of_book"](spark, SMALL), "Exchange") == 2  # one a side


def test_files_of_a_market_come_from_one_pass(spark):
    df = layout.snapshots(adapters.snapshots(spark, SMALL), "sh")
    assert nodes(df, "Window") == 1


def test_levels_go_to_the_curves_as_arrays(spark):
    """Four columns and not forty; arrays with nulls, also of a part of a batch, are read as the columns are."""
    seen = curves.depth_curves(adapters.snapshots(spark, SMALL))._jdf.queryExecution().analyzed().toString()
    assert seen.count("array(cast(") == 4
    rows = [[None if (i + k) % 7 == 0 else float(i * k) for k in range(10)] for i in range(6)]
    wide = pa.RecordBatch.from_pydict({f"BidPrice{k + 1}": pa.array([r[k] for r in rows], pa.float64()) for k in range(10)})
    lists = pa.RecordBatch.from_pydict({"BidPrice": pa.array(rows, pa.list_(pa.float64()))})
    for start, n in ((0, 6), (2, 3), (6, 0)):
        np.testing.assert_array_equal(curves._matrix(lists.slice(start, n), "BidPrice"), curves._matrix(wide.slice(start, n), "BidPrice"))


def test_drifting_files_come_from_one_pass(spark, monkeypatch):
    """Lines are dealt out and sorted for one write; those of the markets' days read its files, and no other."""
    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k))
    out = catalog.QUERIES["read_drifting"](spark, SMALL)
    assert len(plans) == 5 and ["lineitem" in p for p in plans] == ["Exchange" in p for p in plans] == [True] + 4 * [False]
    assert out.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() - adapters.snapshots(spark, SMALL).where("secs >= 54000").count()


def test_timed_lines_give_the_same_snapshots(spark):
    whole, made = adapters.snapshots(spark, SMALL), adapters.snapshots_of(adapters.timed(spark, SMALL))
    assert made.schema == whole.schema and made.exceptAll(whole).count() == whole.exceptAll(made).count() == 0


def test_large_methods_are_made_small(spark):
    adapters.snapshots(spark, SMALL)
    assert int(spark.conf.get(adapters.SMALL_METHODS[0])) <= 8000


def test_a_side_of_a_section_is_ranked_in_one_window(spark):
    df = spark.range(60).selectExpr("'d' as date", "cast(id % 2 as int) as timestamp", "if(id % 3 = 0, -0D, cast(id % 7 as double)) as x", "cast(id % 5 as double) as y")
    out = evaluate.rank_ic(df, "x", "y", parts=3)
    assert nodes(out, "Window") == 2 and out._jdf.queryExecution().executedPlan().toString().count(", 3)") == 1
    want = {t: part["x"].abs().rank().corr(part["y"].rank()) for t, part in df.toPandas().groupby("timestamp")}
    assert {r["timestamp"]: round(r["rank_ic"], 9) for r in out.collect()} == {t: round(c, 9) for t, c in want.items()}


def test_tasks_for_sections_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SECTION_ROWS", 500)
    for name, parts in (("rank_ic", 12), ("ic_daily", 12), ("ic_by_horizon", 60), ("ic_cube", 60)):
        assert f", {parts})" in catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString(), name


def test_sketches_sort_no_rows(spark):
    """200 days in one file are more than Spark sums up side by side."""
    rows = spark.range(2000).selectExpr("cast(id % 2 as string) as SecurityID", "cast(id % 200 as string) as date", "cast(id as double) as x", "id").coalesce(1)
    made = sketches.daily(rows, F.col("x"), F.col("id"), 40)
    assert nodes(made, "Exchange") == 1 and made.count() == 200
    assert nodes(catalog.QUERIES["sketch_thresholds"](spark, SMALL), "Expand") == 0


def test_trades_are_sorted_once_and_days_cost_no_pass(spark):
    """One pass each for the stream's trades and book and for thresholds; the mean of a bucket needs no other sort."""
    out = catalog.QUERIES["trade_aggregates"](spark, SMALL)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 3 and nodes(out, "Filter (__side") == 1
    under = [line.lstrip(" :+-") for line in text[text.index("windowspecdefinition(SecurityID") :].splitlines()]
    assert not any(x.startswith("Sort") for x in under[: next(k for k, x in enumerate(under) if x.startswith("Filter (__side"))])


def test_predictions_run_the_features_once(spark, monkeypatch):
    """Training, validation and predictions read files; the view of lineitem isn't in the plan of what they read."""
    seen, real = [], catalog.model.AlphaModel.fit
    monkeypatch.setattr(catalog.model.AlphaModel, "fit", lambda self, *parts: seen.extend(parts) or real(self, *parts))
    out = catalog.QUERIES["walk_forward_predictions"](spark, SMALL)
    for df in [*seen, out]:
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString() and nodes(df, "FileScan") == 1


def test_packed_bins_are_read_in_place():
    rows = np.arange(30, dtype=np.uint16).reshape(10, 3)
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    for part in (column, column.slice(4, 3), column.slice(10)):
        assert boosting.unpacked(part, 3).tolist() == rows[part.offset : part.offset + len(part)].tolist()
    assert boosting.unpacked(column, 3).base is not None


def test_sections_of_components_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SECTION_ROWS", 500)
    out = catalog.QUERIES["flow_pca"](spark, SMALL)
    assert "timestamp, 12)" in re.sub(r"#\d+", "", out._jdf.queryExecution().executedPlan().toString()) and nodes(out, "Exchange") == 2
