"""Running values and parsers range by range against windows over whole files, under random cuts."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.ranges import beside, running
from quern.plans import exceptions, gc, threads
from quern.sources import artifacts
from tests.test_engine import DEADLOCK, QUIET, gc_log, stack


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("length", [3, 7, 40, 10_000])
def test_running_values(spark, length):
    rng = random.Random(length)
    rows = [(k, p, rng.choice([None, 1, 2]), rng.choice([None, None, "a", "b"])) for k in ("x", "y") for p in range(1, 120) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, p int, n int, s string").repartition(3)
    w = Window.partitionBy("k").orderBy("p")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wanted = df.select("*", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("total"), F.last("s", True).over(w).alias("now"), F.last("s", True).over(before).alias("was"))
    for cut in (length, None):
        got = running(df, ["k"], "p", {"total": F.coalesce("n", F.lit(0))}, {"now": F.col("s")}, {"was": F.col("s")}, cut)
        assert rows_of(got.select(wanted.columns)) == rows_of(wanted)
    dense = spark.range(1, 100).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") * 7 % 13).alias("v"))
    by = Window.partitionBy("k").orderBy("p")
    wanted = dense.select("*", F.lead("v", 1).over(by).alias("next"), F.lag("v", 3).over(by).alias("third"))
    assert rows_of(beside(dense, ["k"], "p", {"next": ("v", 1), "third": ("v", -3)}, length)) == rows_of(wanted)
    with pytest.raises(ValueError):
        beside(dense, ["k"], "p", {"third": ("v", -3)}, 2)


OLD = "".join(f"{k * 1.5:.3f}: [GC (Allocation Failure) [PSYoungGen: 100K->{k}K(200K)] 300K->{200 + k}K(400K), 0.0{k:02d} secs] [Times: user=0.01 sys=0.00, real=0.01 secs]\n" for k in range(1, 30))


@pytest.mark.parametrize("length", [4, 11, 37])
def test_parsers_under_any_cut(spark, length):
    log = "".join(stack(k) for k in range(12)) + "Caused by: app.LateException: x\n\tat app.A.b(A.java:1)\n\n\tat app.A.c(A.java:2)\n"
    files = artifacts.from_texts(spark, [("s", "a.jstack", DEADLOCK + QUIET), ("s", "gc.log", gc_log([(10 + k, 250, 120 + k, 90) for k in range(25)])), ("s", "old-gc.log", OLD), ("s", "app.log", log), ("t", "app.log", log[300:])])
    lines = artifacts.lines_of(files).repartition(3)
    of = lambda name: lines.where(F.col("file").endswith(name))
    for parse, given in ((threads.parse, of("jstack")), (gc.parse, of("gc.log")), (lambda x, n: (exceptions.parse(x, n),), of("app.log"))):
        for whole, cut in zip(parse(given, None), parse(given, length), strict=True):
            assert whole.columns == cut.columns
            found = rows_of(whole)
            assert found and found == rows_of(cut)


def test_a_line_of_a_megabyte(spark):
    """Heads are found in time that follows the line's length, whatever it repeats."""
    import time

    texts = ["ERROR " * 170_000, "a." * 500_000 + "XError", "WARN " + " " * 500_000 + "x.YException: late", "$" * 500_000, "ERROR " + "a$b." * 200_000 + "Fault extra"]
    lines = spark.createDataFrame([("s", "app.log", "app.log", 2 * k + 1 + j, t) for k, text in enumerate(texts) for j, t in enumerate((text, "\tat app.A.b(A.java:1)"))], "snapshot_id string, file string, ord string, line_no int, text string")
    exceptions.parse(lines.limit(0)).collect()
    began = time.time()
    got = exceptions.parse(lines).select(F.get("chain", 0)["cls"].alias("cls"), "start_line").collect()
    assert {(r.cls[-12:], r.start_line) for r in got} == {("a.a.a.XError"[-12:], 3), ("x.YException", 5)}
    assert time.time() - began < 20


@pytest.mark.parametrize(
    "line,found",
    [
        ("2024 ERROR [x] app.Foo - java.io.IOException: gone", ("java.io.IOException", "gone")), ("WARN: a.BError", ("a.BError", "")), ("ERROR -a.BException: ", ("a.BException", "")), ("ERROR x- a.BException", ("a.BException", "")),
        ("ERRORS a.BException", None), ("ERROR a.Exception", None), ("ERROR a.BException thrown", None), ("ERROR x-a.BException", None), ("ERROR a.1BException b.CFault: m: n", ("b.CFault", "m: n")), ("SEVERE ERROR a$1.B$cThrowable:x", ("a$1.B$cThrowable", "x")),
    ],
)
def test_heads_after_a_level(spark, line, found):
    lines = spark.createDataFrame([("s", "f", "f", 1, line), ("s", "f", "f", 2, "\tat a.B.c(D.java:1)")], "snapshot_id string, file string, ord string, line_no int, text string")
    got = exceptions.parse(lines).select(F.get("chain", 0).alias("c")).collect()
    assert [(r.c.cls, r.c.message or "") for r in got] == ([found] if found else [])
