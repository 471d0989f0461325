"""As-of join of two streams: each trade gets the latest book row of its stock and day at or before it, as in functions.windows.as_of.

Both streams are one. Stocks' days are dealt out to parts by hash; a part's state is the book rows that a trade may still ask for
and the trades that wait, as Arrow tables, and a call works on all rows of a part at once. A trade is answered when the watermark has passed its time, with the next rows of its part or by a timer: no earlier book row can
come any more. Then all book rows but
the latest of a stock's day before the watermark are dropped, so the state is what the delay spans, however long the stream
runs. Rows may come in any order within the delay; what comes later than the watermark is left out, as everywhere in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..functions.windows import STOCK

KEY = [StructField("SecurityID", StringType()), StructField("date", StringType())]
#: What the state needs of a stream to be able to use timers. Fixed value of Spark.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a table that one part of the stocks has, about, when a query deals them out.
PART_ROWS = 200_000


class _AsOf(StatefulProcessor):
    """The state of a key are its rows as Arrow tables, a table a call; a key may hold many stocks, in columns of the rows."""

    def __init__(self, fields: list[StructField], event: list[str], carry: list[str]) -> None:
        self.fields, self.event, self.carry = fields, event, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = to_arrow_schema(StructType([*KEY, *self.fields, StructField("us_", LongType()), StructField("turn_", LongType())]))
        packed = StructType([StructField("rows", BinaryType())])
        self.book = handle.getListState("book", packed)
        self.waiting = handle.getListState("waiting", packed)
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def _frame(self, state) -> pd.DataFrame:
        tables = [pa.ipc.open_stream(r[0]).read_all() for r in state.get()]
        return pa.concat_tables(tables or [self.schema.empty_table()]).to_pandas(integer_object_nulls=True)

    def _packed(self, rows: pd.DataFrame) -> list[tuple]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as out:
            out.write_table(pa.table([pa.array(rows[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema))
        return [(sink.getvalue().to_pybytes(),)]

    def _kept(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(self._packed(rows))
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if "SecurityID" not in new:
            new["SecurityID"], new["date"] = key
        seen = self.count.get()[0] if self.count.exists() else 0
        self.count.update((seen + len(new),))
        new["us_"] = new["ts"].astype("datetime64[us]").astype("int64")
        new["turn_"] = range(seen, seen + len(new))
        for state, side in ((self.book, 0), (self.waiting, 1)):
            part = new[new["stream_side"] == side]
            if len(part):
                state.appendList(self._packed(part))
        mark = timerValues.getCurrentWatermarkInMs()
        events = new.loc[new["stream_side"] == 1, "us_"]
        last = int(events.max()) // 1000 + 1 if len(events) else 0
        if last > mark:
            self.handle.registerTimer(last)  # for stocks that get no more rows; others are answered with their next rows
        return self._answers(mark * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._answers(timerValues.getCurrentWatermarkInMs() * 1000)

    def _answers(self, mark: int) -> Iterator[pd.DataFrame]:
        """Trades before the watermark with their books; what nobody can ask for any more is dropped."""
        waiting = self._frame(self.waiting)
        due = waiting["us_"].astype("int64") < mark
        if not due.any():
            return iter(())
        stock, order = list(STOCK), ["us_", "turn_"]
        book = self._frame(self.book).astype(dict.fromkeys(order, "int64")).sort_values(order)
        events = waiting[due].astype(dict.fromkeys(order, "int64")).sort_values(order)
        found = pd.merge_asof(events[[*stock, *order, *self.event]], book[[*stock, "us_", *self.carry]].rename(columns={c: f"at_{c}" for c in self.carry}), on="us_", by=stock)
        out = pd.DataFrame({"SecurityID": found["SecurityID"], "date": found["date"], "ts": pd.to_datetime(found["us_"], unit="us")})
        for c in (*self.event, *(f"at_{c}" for c in self.carry)):
            out[c] = found[c] if c in self.event else found[c].astype(float)
        self._kept(self.waiting, waiting[~due])
        before = book["us_"] < mark  # of a stock's day the latest of them may still be asked for
        self._kept(self.book, book[~before | ~book[before].duplicated(stock, keep="last").reindex(book.index, fill_value=True)])
        return iter((out,))

    def close(self) -> None:
        pass


def stream_as_of(events: DataFrame, book: DataFrame, carry: list[str], keep: list[str], delay: str = "1 minute", parts: int = 64) -> DataFrame:
    """(SecurityID, date, ts, keep..., at_carry...) of streams with SecurityID, date and ts (timestamp).

    carry are number columns of the book, keep number or string columns of the events. Of book rows at one time the one that came
    last counts. Stocks' days are dealt out to parts, each with one state: the parts should grow with the rows of a batch. Needs
    the session's state store to be RocksDB (STATE_STORE).
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    fields = [*(StructField(c, DoubleType()) for c in carry), *(StructField(c, kinds[c]) for c in keep)]
    part = lambda df, side, own: df.withWatermark("ts", delay).select(F.pmod(F.xxhash64(*STOCK), F.lit(parts)).alias("stream_part"), *STOCK, "ts", F.lit(side).alias("stream_side"), *[(F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    both = part(book, 0, carry).unionByName(part(events, 1, keep))
    out = StructType([*KEY, StructField("ts", TimestampType()), *(StructField(c, kinds[c]) for c in keep), *(StructField(f"at_{c}", DoubleType()) for c in carry)])
    return both.groupBy("stream_part").transformWithStateInPandas(_AsOf(fields, keep, carry), out, "append", "eventtime")


def closing(spark, schema: StructType, ts: str, key: dict[str, object]) -> DataFrame:
    """A row of a stream's schema with this time and key, all else null: once both streams have it, all earlier rows are answered."""
    values = [key.get(f.name) for f in schema.fields]
    return spark.createDataFrame([values], StructType([StructField(f.name, f.dataType) for f in schema.fields])).withColumn("ts", F.lit(ts).cast("timestamp"))
