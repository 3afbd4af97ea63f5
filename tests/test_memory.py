"""Remembered facts as keyed state: after each trigger the stream's facts are the batch query's."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tripleloom.streaming import memory

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def facts(df):
    return sorted((r["subject"], r["predicate"], r["object"], r["at"], r["expires"] or dt.datetime.max, r["session"]) for r in df.collect())


def test_sessions_expiry_and_forgetting(spark):
    rows = [("a", "p", "x", at(0), None, "assert"), ("a", "p", "y", at(10), 3600, "assert"), ("a", "p", "x", at(60), 60, "assert"), ("a", "p", "z", at(61), None, "assert"), ("a", "p", "z", at(61), None, "forget"), ("b", "p", "x", at(5), None, "forget"), (None, "p", "x", at(5), None, "assert"), ("c", "p", "x", None, None, "assert")]
    e = spark.createDataFrame(rows, memory.EVENTS)
    assert facts(memory.live(e, at(60))) == [("a", "p", "x", at(60), at(61), 2), ("a", "p", "y", at(10), at(70), 1)]
    assert facts(memory.live(e, at(61))) == [("a", "p", "y", at(10), at(70), 1)] and facts(memory.live(e, at(70))) == []


def test_the_stream_equals_the_batch_after_each_trigger(spark, tmp_path):
    rng = np.random.default_rng(6)
    events = []
    for k in range(400):
        events.append((f"s{rng.integers(0, 6)}", "p", f"o{rng.integers(0, 5)}", at(int(k * 3 + rng.integers(0, 5))), [None, 600, 7200][rng.integers(0, 3)], "forget" if rng.random() < 0.15 else "assert"))
    # one place in time a subject: equal times of one fact would be one event
    events = list({(e[0], e[3]): e for e in events}.values())
    source, log = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    stream = memory.changes(spark.readStream.schema(memory.EVENTS).parquet(str(source)))
    seen, watermark, checked = [], None, 0
    for k in range(0, len(events), 90):
        some = events[k : k + 90]
        if watermark is not None:
            some = [e for e in some if e[3] > watermark]
        seen += some
        spark.createDataFrame(some, memory.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        q = stream.writeStream.format("parquet").option("path", str(log)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        watermark = max(e[3] for e in seen) - dt.timedelta(minutes=10)
        got = memory.live_of(spark.read.schema(memory.CHANGES).parquet(str(log)))  # in the order of time, whatever order they came in
        want = memory.live(spark.createDataFrame(seen, memory.EVENTS), watermark)
        assert facts(got.where(F.col("expires").isNull() | (F.col("expires") > F.lit(watermark)))) == facts(want)
        checked += len(facts(want))
    changes = {r["change"] for r in spark.read.parquet(str(log)).select("change").distinct().collect()}
    assert changes == {"assert", "forget", "expire"} and checked > 20
