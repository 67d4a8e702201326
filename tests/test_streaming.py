from pyspark.sql import functions as F

from tidelane.streaming import flows

SCHEMA = "pkt_no long, ts_us long, src_ip string, src_port long, dst_ip string, dst_port long, protocol int, wirelen long"


def stream(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (tmp_path / "in" / "_SUCCESS").unlink(missing_ok=True)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("ts_us"))


def run(df, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = df.sparkSession.table("out").collect()
    query.stop()
    return rows


def packet(no, at, up=True, protocol=17):
    ends = ("10.0.0.1", 5, "10.0.0.2", 6) if up else ("10.0.0.2", 6, "10.0.0.1", 5)
    return (no, int(at * 1e6), *ends, protocol, 100)


LATER = (99, int(5000 * 1e6), "10.0.0.8", 1, "10.0.0.9", 2, 17, 1)


def test_session_flows(spark, tmp_path):
    rows = run(flows.session_flows(stream(spark, tmp_path, [[packet(0, 1000), packet(1, 1010, False)], [packet(2, 1200)], [LATER], [LATER]])), tmp_path)
    assert sorted((r.packets, r.bytes) for r in rows) == [(1, 100), (2, 200)]


def test_aged_flows(spark, tmp_path):
    rows = run(flows.aged_flows(stream(spark, tmp_path, [[packet(0, 1000), packet(1, 1010, False)], [packet(2, 1200)], [LATER], [LATER]])), tmp_path)
    assert sorted((r.packets, r.up_packets, r.closed_by) for r in rows) == [(1, 1, "idle"), (2, 1, "idle")]


def test_windowed_rates(spark, tmp_path):
    rows = run(flows.windowed_rates(stream(spark, tmp_path, [[packet(0, 1000), packet(1, 1010)], [LATER], [LATER]])), tmp_path)
    assert sum(r.packets for r in rows) == 2
