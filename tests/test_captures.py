"""Thread dumps that are large: lines are parsed once, no snapshot's threads are held by one task, columns that aren't read aren't made."""

from quern.artifact_queries import LIMITS, growing_tables
from quern.plans import threads
from quern.rules import tda
from quern.sources.workspace import Workspace

SF = "/root/testdata/sf0.001"
READ = ["name", "nid", "cpu_ms", "elapsed_s", "start_line", "end_line"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_parsed_before_the_rule_reads_them(spark):
    t = growing_tables(spark, SF, READ)
    for df in (t.threads, t.dumps, tda.hot_threads(t, LIMITS)):
        assert "Generate" not in plan(df) and "Scan parquet" in plan(df)
    # windows keep the first few of a snapshot, each task cuts its rows before they are sent; none sums up all threads of one
    told = plan(tda.hot_threads(t, LIMITS))
    windows = [line for line in told.split("\n") if "Window [" in line]
    assert len(windows) == 1 and "row_number()" in windows[0] and told.count("WindowGroupLimit") == 2


def test_written_and_narrowed_threads_are_the_same(spark):
    text = '''2024-05-01 10:00:01
Full thread dump X (1):

"a" #1 prio=5 os_prio=0 cpu=1.50ms elapsed=2.00s tid=0x1 nid=0x2 runnable  [0x01]
   java.lang.Thread.State: RUNNABLE
\tat app.A.run(A.java:3)
\t- locked <0xA> (a app.L)

"b" #2 daemon prio=5 nid=0x3 waiting on condition
   java.lang.Thread.State: WAITING (parking)
  Found one Java-level deadlock:
"a":
found another java-level Deadlock:
Found 2 deadlocks.
"VM Thread" os_prio=0 cpu=3.00ms elapsed=4.00s tid=0x3 nid=0x5 runnable
Full thread dump Y:
"c" #3 prio=5 nid=0x6 runnable
2024/05/01T10:00:02 and more
"d" #4 prio=5 nid=0x7 runnable'''
    rows = [("s", f, f, n + 1, line) for f in ("x", "y") for n, line in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "snapshot_id string, file string, ord string, line_no int, text string")
    dumps, found = threads.parse(lines)
    few_dumps, few = threads.parse(lines, space=Workspace(spark), columns=READ)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(few_dumps) == rows(dumps) and rows(few.select("file", "dump_ord", *READ)) == rows(found.select("file", "dump_ord", *READ))
    first = [r for r in dumps.where("file = 'x'").orderBy("dump_ord").collect()]
    assert [(r.vm, r.vm_reported_deadlock, r.vm_deadlock_count, r.n_threads) for r in first] == [("X (1)", True, 2, 3), ("Y", False, 0, 1), (None, False, 0, 1)]
