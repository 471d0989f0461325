import datetime as dt

import pandas as pd
import pytest

from lobspark.streaming.buckets import stream_ema, trade_buckets

DAY = dt.datetime(2024, 1, 2, 9, 30)


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def run(df, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def test_buckets_close_behind_the_watermark(spark, tmp_path):
    schema = "SecurityID string, ts timestamp, TradPrice double, TradVolume double, TradeMoney double, TradeBSFlag string"
    at = lambda s: DAY + dt.timedelta(seconds=s)
    written(spark, tmp_path, "a", [("1", at(1), 10.0, 5.0, 50.0, "B"), ("1", at(3), 10.0, 5.0, 50.0, "S"), ("1", at(3.5), 11.0, 1.0, 11.0, "B"), ("1", at(60), 9.0, 1.0, 9.0, "S")], schema)
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/*")
    got = run(trade_buckets(src), "buckets", spark).sort_values("bucket_end")
    assert got["bucket_end"].tolist() == [pd.Timestamp(at(3)), pd.Timestamp(at(6))]  # the last one is still open
    assert got["trade_buy_amt"].tolist() == [50.0, 11.0] and got["trade_sell_amt"].tolist() == [50.0, 0.0]
    assert got["trade_vwap"].tolist() == [10.0, 11.0]


def test_moving_average_keeps_its_state_between_batches(spark, tmp_path):
    schema = "SecurityID string, bucket_end timestamp, x double"
    rows = [("1", DAY + dt.timedelta(seconds=3 * k), float(k % 5)) for k in range(12)]
    for k in range(3):
        written(spark, tmp_path, f"b{k}", rows[4 * k : 4 * k + 4], schema)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/*")
    got = run(stream_ema(src, "x"), "averages", spark).sort_values("bucket_end")
    want = pd.Series([r[2] for r in rows]).ewm(alpha=2 / 21, adjust=False).mean()
    assert got["ema"].tolist() == pytest.approx(want.tolist())
