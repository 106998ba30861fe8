"""Stacks of a stream are those of the batch parser, however the log is cut, over restarts too."""

import random
import time

import pytest

from quern.plans import exceptions
from quern.sources import artifacts
from quern.streaming.stacks import exceptions_of_stream
from tests.test_engine import stack

PROVIDER, NO_DATA = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
LOG = (
    "".join(stack(k) for k in range(5)) + "Caused by: app.LateException: x\n\tat app.A.b(A.java:1)\n\n\tat app.A.c(A.java:2)\n\nnot a frame\n\tat app.A.lost(A.java:3)\n2024-05-01 11:00:00,000 one\ntwo\nthree\napp.BError: far stamp\n\tat app.B.c(Native Method)\n"
    + "app.NoFramesError: none\n\nSuppressed: app.SException\n\tat app.S.x(S.java:1)\n" + "".join(stack(k, 9) for k in range(3)) + "app.LastException\n\tat app.L.m(L.java:8)\n"
)


@pytest.fixture()
def rocks(spark):
    before, no_data = spark.conf.get(PROVIDER), spark.conf.get(NO_DATA)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)
    spark.conf.set(NO_DATA, no_data)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1])
def test_any_cut_and_a_restart(spark, rocks, tmp_path, seed):
    rng = random.Random(seed)
    spark.conf.set(NO_DATA, "false")  # availableNow would wait for the timers
    files = artifacts.from_texts(spark, [("s", "a.log", LOG), ("s", "b.log", LOG[700:]), ("t", "a.log", LOG[: len(LOG) // 2])])
    lines = artifacts.lines_of(files).select("snapshot_id", "file", "line_no", "text")
    wanted = rows_of(exceptions.parse(artifacts.lines_of(files)))
    rows = sorted(lines.collect(), key=lambda r: r.line_no)
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def add(k):
        rng.shuffle(parts[k])
        again = parts[k - 1][:3] if k else []  # delivered twice
        spark.createDataFrame([*parts[k], *again], lines.schema).coalesce(1).write.mode("append").parquet(source)

    def started(idle, trigger):
        stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
        return exceptions_of_stream(stream, idle).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    for k in range(len(parts)):
        add(k)
        if k % 2:  # each query takes up the state that the one before it left
            started(3600, {"availableNow": True}).awaitTermination(120)
    open_yet = set(wanted) - set(rows_of(spark.read.parquet(sink)))
    assert 0 < len(open_yet) <= 3  # at most one of each file
    # a timer was set for an hour; the next line ends a stack as well
    ends = [(r.snapshot_id, r.file, r.last + 1, "done") for r in lines.groupBy("snapshot_id", "file").agg({"line_no": "max"}).withColumnRenamed("max(line_no)", "last").collect()]
    spark.createDataFrame(ends, lines.schema).coalesce(1).write.mode("append").parquet(source)
    started(3600, {"availableNow": True}).awaitTermination(120)
    assert rows_of(spark.read.parquet(sink)) == wanted


def test_an_idle_log_is_closed_by_its_timer(spark, rocks, tmp_path):
    files = artifacts.from_texts(spark, [("s", "a.log", LOG)])
    wanted = rows_of(exceptions.parse(artifacts.lines_of(files)))
    lines = artifacts.lines_of(files).select("snapshot_id", "file", "line_no", "text")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = exceptions_of_stream(stream, 1.0).writeStream.format("memory").queryName("idle_stacks").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and rows_of(spark.table("idle_stacks")) != wanted:
            time.sleep(1)
        assert rows_of(spark.table("idle_stacks")) == wanted
    finally:
        query.stop()
