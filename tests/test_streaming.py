from __future__ import annotations

from sparkloom.streaming.moments import windowed_moments

SF = "/root/testdata/sf0.001"


def test_stream_and_table_agree(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.write.parquet(f"{tmp_path}/events")
    want = {r.start: (r.n, round(r.mean_value, 9), round(r.sd_value, 9)) for r in windowed_moments(table, "ts", ["value"]).collect()}
    stream = windowed_moments(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events"), "ts", ["value"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("moments").start()
    try:
        query.processAllAvailable()
        got = {r.start: (r.n, round(r.mean_value, 9), round(r.sd_value, 9)) for r in spark.table("moments").collect()}
    finally:
        query.stop()
    assert got == want
