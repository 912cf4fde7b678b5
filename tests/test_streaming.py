from __future__ import annotations

import datetime as dt

from quartzvol.streaming import closes


def test_stream_equals_batch_and_late_ticks_go(spark, tmp_path):
    schema = "series_id string, ts timestamp, price double"
    tick = lambda day, hour, price: ("s", dt.datetime(2024, 1, day, hour), price)
    parts = [[tick(1, 9, 1.0), tick(1, 17, 2.0)], [tick(5, 9, 5.0)], [tick(1, 10, 99.0), tick(9, 9, 6.0)], [tick(12, 1, 0.0)]]
    source = f"{tmp_path}/in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = closes.daily_bars(spark.readStream.schema(schema).parquet(source), "1 day")
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    bars = {r["d"].day: (r["open"], r["high"], r["low"], r["close"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert bars[1] == (1.0, 2.0, 1.0, 2.0, 2) and bars[5] == (5.0, 5.0, 5.0, 5.0, 1)
