import io
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.streaming import Ring, continuous_sma, feed_stream, poll_arrow, ring_snapshot, stateful_ema


def batch(spark, start, n):
    return spark.range(start, start + n).select(F.col("id").alias("ts"), (F.col("id") * 0.5).alias("price"))


def test_newest_rows_are_kept(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema, max_rows=9)
    assert ring.try_snapshot() == (False, None) and ring.num_rows() == 0 and ring.snapshot().count() == 0
    for i in range(12):
        ring.append(batch(spark, i + 1, 1), "ts")
    assert sorted(r["ts"] for r in ring.snapshot().collect()) == list(range(4, 13))
    assert ring.committed_rows() == 12 and ring.num_rows() == 9
    assert sorted(r["ts"] for r in ring_snapshot(batch(spark, 1, 12), "ts", 9).collect()) == list(range(4, 13))


def test_old_snapshots_stay_whole(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema)
    sizes = []
    for i in range(4):
        ring.append(batch(spark, 500 * i, 500), "ts")
        ok, rows = ring.try_snapshot()
        sizes.append(rows.count())
        assert ok
    assert sizes == [500, 1000, 1500, 2000]


def test_writers_exclude_each_other(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema, max_rows=250)
    threads = [threading.Thread(target=lambda: [ring.append(batch(spark, 0, 100), "ts") for _ in range(2)]) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ring.committed_rows() == 800 and ring.snapshot().count() == 250


def test_continuous_query(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema, max_rows=100)
    ring.append(batch(spark, 0, 10), "ts")
    assert continuous_sma(ring, "price", 20) is None
    ring.append(batch(spark, 10, 30), "ts")
    last = continuous_sma(ring, "price", 20).orderBy(F.desc("ts")).first()
    assert last["sma"] == pytest.approx(sum(i * 0.5 for i in range(20, 40)) / 20)


def test_feed_takes_each_file_once(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    schema = pa.schema([("ts", pa.int64()), ("price", pa.float64())])

    def put(name, start):
        with pa.OSFile(str(feed / name), "wb") as f, pa.ipc.new_file(f, schema) as w:
            w.write_batch(pa.record_batch({"ts": list(range(start, start + 50)), "price": [1.0] * 50}, schema=schema))

    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema, max_rows=80)
    seen = []
    put("a.arrow", 0)
    for name, start in ((None, 0), ("Z.arrow", 50)):  # sorts before the first
        if name:
            put(name, start)
        q = poll_arrow(spark, str(feed), ring, str(tmp_path / "cp"), None, seen.append)
        assert q.awaitTermination(60)
    assert ring.committed_rows() == 100 and ring.num_rows() == 80 and seen == [50, 100]
    assert ring.snapshot().agg(F.min("ts")).first()[0] == 20


def test_stream_of_batches(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema, max_rows=25)
    rows = batch(spark, 0, 40).orderBy("ts").toArrow().combine_chunks()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows, max_chunksize=10)
        w.write_table(rows.slice(0, 0))
    seen = []
    assert feed_stream(io.BytesIO(sink.getvalue()), ring, seen.append) == 40 and seen == [10, 20, 30, 40]
    assert sorted(r["ts"] for r in ring.snapshot().collect()) == rows["ts"].to_pylist()[15:]


def test_batch_is_added_once(spark, tmp_path):
    ring = Ring(spark, str(tmp_path / "r"), batch(spark, 0, 1).schema)
    ring.append(batch(spark, 0, 10), "ts", batch_id=0)
    ring.append(batch(spark, 0, 10), "ts", batch_id=0)
    assert ring.committed_rows() == 10


def test_ema_goes_on_across_batches(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(k, t, float(k * 10 + t % 3)) for t in range(30) for k in range(4)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == i], "k long, t long, x double").coalesce(1).write.parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema("k long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = stateful_ema(stream, "k", "t", "x", 5).writeStream.format("memory").queryName("emas").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    got = {(r["key"], r["t"]): r["ema"] for r in spark.table("emas").collect()}
    for k in range(4):
        e = None
        for t in range(30):
            x = float(k * 10 + t % 3)
            e = x if e is None else x / 3 + e * 2 / 3
            assert got[k, t] == pytest.approx(e)
