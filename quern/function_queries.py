"""Queries that apply the scalar functions, sources and correlation steps themselves, with what each must give as SQL.

Cases with a fixed outcome stand in a table of cases; nations number them, so every case occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .artifact_queries import LIMITS, desk_tables, gc_tables, only, thrown_tables
from .functions import exprs as X
from .operators import graph
from .plans import correlate
from .plans.engine import Analysis
from .queries import finding_rows, query, table, _FINDINGS
from .report import collapsed, percent
from .rules import RULES
from .sources import artifacts


def cases(spark, d, given: list) -> DataFrame:
    """n_nationkey and the case of each nation, as column x."""
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(g) for g in given]), (key % len(given) + 1).cast("int")).alias("x"))


def literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def wanted(columns: str, rows: list[tuple]) -> str:
    """SQL of the outcomes by nation; each row begins with the case itself."""
    values = ", ".join("(" + ", ".join([str(k), *map(literal, row)]) + ")" for k, row in enumerate(rows))
    return f"SELECT n_nationkey, {columns} FROM nation JOIN (VALUES {values}) c(k, x, {columns}) ON k = n_nationkey % {len(rows)}"


_CLASS_CASES = [
    ("[[Lapp.Row;", "app.Row", False, True, False, False, True), ("[B", "B", True, False, False, False, True), ("java.lang.String", "java.lang.String", False, False, True, False, False),
    ("org.springframework.Bean", "org.springframework.Bean", False, False, False, True, False), ("io.netty.Buffer", "io.netty.Buffer", False, False, False, True, False), ("com.acme.Cart", "com.acme.Cart", False, False, False, False, True),
    ("[Ljava.util.Map;", "java.util.Map", False, True, True, False, False), ("SUN.misc.Unsafe", "SUN.misc.Unsafe", False, False, True, False, False), ("Large;", "Large;", False, False, False, False, True),
]


@query("fn_class_names", wanted("base, primitive, objects, jdk, framework, business", _CLASS_CASES))
def fn_class_names(spark, d):
    x = F.col("x")
    base = X.base_class(x)
    return cases(spark, d, [c[0] for c in _CLASS_CASES]).select("n_nationkey", base.alias("base"), X.is_primitive_array(x).alias("primitive"), X.is_object_array(x).alias("objects"), X.is_jdk(base).alias("jdk"), X.is_framework(base).alias("framework"), X.is_business(base).alias("business"))


@query("fn_frames", "SELECT c_custkey, 'app.C' || c_nationkey || '#m' AS id, 'at app.C' || c_nationkey || '.m' || CASE WHEN c_custkey % 3 = 0 THEN ' (Native Method)' WHEN c_custkey % 3 = 1 THEN ' (Source File Unknown)' ELSE '(C.java' || CASE WHEN c_custkey % 2 = 0 THEN ':' || c_custkey ELSE '' END || ')' END AS display, 'C' || c_nationkey AS simple FROM customer")
def fn_frames(spark, d):
    key = F.col("c_custkey")
    cls = F.concat(F.lit("app.C"), F.col("c_nationkey").cast("string"))
    file, line = F.when(key % 3 == 2, F.lit("C.java")), F.when(key % 2 == 0, key)
    return table(spark, d, "customer").select("c_custkey", X.frame_id(cls, F.lit("m")).alias("id"), X.frame_display(cls, F.lit("m"), file, line, key % 3 == 0).alias("display"), X.simple_name(cls).alias("simple"))


_FRAME_CASES = [
    ("\tat java.base@17.0.9/java.lang.Thread.run(Thread.java:840)", "java.lang.Thread", "run", "Thread.java", 840, False), ("\tat app.Db.get(java.base@17/Db.java:7) ~[app.jar:1]", "app.Db", "get", "Db.java", 7, False),
    ("\tat app.N.call(Native Method)", "app.N", "call", None, None, True), ("\tat app.U.call(Unknown Source)", "app.U", "call", None, None, False), ("\tat main(Main.java)", "<unknown>", "main", "Main.java", None, False),
]


@query("parse_frames", wanted("cls, method, file, line, native", _FRAME_CASES))
def parse_frames(spark, d):
    from .plans.exceptions import frame

    f = frame(F.col("x"), F.lit(1))
    return cases(spark, d, [c[0] for c in _FRAME_CASES]).select("n_nationkey", f["cls"].alias("cls"), f["method"].alias("method"), f["src_file"].alias("file"), f["src_line"].alias("line"), f["native"].alias("native"))


_NAME_CASES = [
    ("VM Thread", True, False), ("GC Thread#7", True, False), ("g1 conc#2", True, False), ("C2 CompilerThread0", True, False), ("ZGC Main Thread", True, False), ("pool-3-finalizer", True, False), ("Task12", True, False), (" Finalizer", True, False),
    ("worker-VM Thread", False, False), ("http-nio-8080-exec", False, True), ("pool-N-thread", False, True), ("kafka-coordinator", False, True), ("qtp1234", False, True), ("my-batch", False, False), ("dubbo-x", False, True),
]


@query("fn_thread_names", wanted("internal, server", _NAME_CASES))
def fn_thread_names(spark, d):
    return cases(spark, d, [c[0] for c in _NAME_CASES]).select("n_nationkey", X.jvm_internal_name(F.col("x")).alias("internal"), X.server_pool(F.col("x")).alias("server"))


@query("fn_gc_noise", """WITH e AS (SELECT event_id, event_id % 100000 AS at_ms, (['FULL', 'CYCLE', 'YOUNG'])[event_id % 3 + 1] AS kind, (['ZGC', 'SHENANDOAH', 'G1', 'CMS'])[event_id % 4 + 1] AS collector, (['Heap Inspection Initiated GC', 'Collect For Dumping', 'Metadata GC Threshold', 'Ergonomics', NULL])[event_id % 5 + 1] AS cause FROM events)
    SELECT event_id, kind = 'FULL' OR kind = 'CYCLE' AND collector IN ('ZGC', 'SHENANDOAH') AS major, event_id % 5 < 2 AS tool, event_id % 5 < 2 OR event_id % 5 = 2 AND at_ms <= 60000 AS noise, CASE WHEN collector = 'ZGC' THEN 'whole-heap concurrent cycles' ELSE 'Full GC collections' END AS noun, CASE WHEN collector = 'ZGC' THEN 'cycle' ELSE 'Full GC' END AS label FROM e""")
def fn_gc_noise(spark, d):
    n = F.col("event_id")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    kind, collector, cause = of(["FULL", "CYCLE", "YOUNG"]), of(["ZGC", "SHENANDOAH", "G1", "CMS"]), of(["Heap Inspection Initiated GC", "Collect For Dumping", "Metadata GC Threshold", "Ergonomics", None])
    return table(spark, d, "events").select("event_id", X.is_major(kind, collector).alias("major"), X.tool_induced(cause).alias("tool"), X.not_heap_pressure(cause, n % 100000, 60.0).alias("noise"), X.major_noun(collector).alias("noun"), X.major_label(collector).alias("label"))


_FATAL_CASES = [("java.lang.OutOfMemoryError", True), ("java.lang.StackOverflowError", True), ("java.lang.NoClassDefFoundError", True), ("app.LinkageTrouble", True), ("app.CrashError", True), ("app.ErrorException", False), ("app.ExceptionError", False), ("java.io.IOException", False)]


@query("fn_fatal", wanted("fatal", _FATAL_CASES))
def fn_fatal(spark, d):
    return cases(spark, d, [c[0] for c in _FATAL_CASES]).select("n_nationkey", X.fatal_error(F.col("x")).alias("fatal"))


_MASK_CASES = [("9 threads in app/dump1.log wait", "9 threads in <file> wait"), ("seen in a.jstack, b.txt", "seen in <file>, <file>"), ("a.logs is no file", "a.logs is no file"), ("no file", "no file")]


@query("fn_mask_files", wanted("masked", _MASK_CASES))
def fn_mask_files(spark, d):
    return cases(spark, d, [c[0] for c in _MASK_CASES]).select("n_nationkey", X.mask_files(F.col("x")).alias("masked"))


@query("fn_units", """SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) * 97 AS bytes, printf('%.0fM', CAST(floor(o_totalprice * 100) AS BIGINT) * 97 / 1048576.0::DOUBLE + 1e-9) AS mb, CAST(floor(o_totalprice * 100) AS BIGINT) * 97 // 1048576 AS whole_mb, round(CAST(floor(o_totalprice * 100) AS BIGINT) * 97 / 1048576.0::DOUBLE, 6) AS as_mb,
    printf('%.1f MB', CAST(floor(o_totalprice * 100) AS BIGINT) * 97 / 1048576.0::DOUBLE + 1e-9) AS human, printf('%.2f GB', CAST(floor(o_totalprice * 100) AS BIGINT) * 97 * 1024 / 1073741824.0::DOUBLE + 1e-9) AS large FROM orders WHERE o_totalprice BETWEEN 20000 AND 100000""")
def fn_units(spark, d):
    size = (F.floor(F.col("o_totalprice") * 100) * 97).cast("long")
    # sizes from over a MiB to under a GiB; a thousandfold of them from a GiB on
    o = table(spark, d, "orders").where("o_totalprice between 20000 and 100000").select("o_orderkey", size.alias("bytes"))
    b = F.col("bytes")
    return o.select("o_orderkey", "bytes", X.mebibytes(b).alias("mb"), X.old_after_mb(b).alias("whole_mb"), F.round(X.as_mb(b), 6).alias("as_mb"), X.human_bytes(b).alias("human"), F.when(b * 1024 >= 1 << 30, X.human_bytes(b * 1024)).otherwise(F.format_string("%.2f GB", b * 1024 / 1073741824.0)).alias("large"))


@query("fn_report_text", "SELECT doc_id, left(trim(regexp_replace(replace(left(text, 400), '|', '\\|'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 160) AS cell, printf('%.1f%%', (doc_id % 1000) / 10.0::DOUBLE + 1e-9) AS pct FROM documents WHERE regexp_full_match(left(text, 400), '[\\x00-\\x7f]*')")
def fn_report_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.left("text", F.lit(400)).alias("t")).where(F.col("t").rlike("^[\\x00-\\x7f]*$") | F.col("t").rlike("\\A[\\x00-\\x7f]*\\z"))
    return docs.select("doc_id", collapsed(F.col("t")).alias("cell"), percent((F.col("doc_id") % 1000) / 1000.0).alias("pct"))


_ESCAPES = [("\x1b[31mred\x1b[0m", "red"), ("\x1b]0;title\x07text", "text"), ("bell\x07", "bell"), ("a\x1bMb", "ab"), ("plain [0m", "plain [0m"), ("\x1b[1;32;40mok\x1b[K done", "ok done")]


@query("src_escapes", wanted("clean", _ESCAPES).replace("\x1b", "' || chr(27) || '").replace("\x07", "' || chr(7) || '"))
def src_escapes(spark, d):
    return cases(spark, d, [c[0] for c in _ESCAPES]).select("n_nationkey", X.strip_escapes(F.col("x")).alias("clean"))


_BYTES = [("EFBBBF6162", "ab"), ("C3A92062", "é b"), ("D6D0CEC4", "中文"), ("636166E9", "café"), ("", "")]


@query("src_decode", wanted("text", _BYTES))
def src_decode(spark, d):
    return cases(spark, d, [c[0] for c in _BYTES]).select("n_nationkey", artifacts.decode(F.unhex("x")).alias("text"))


_FILES = [
    ("a.txt", '2024-05-01 10:00:01\nFull thread dump X:\n\n"main" #1 prio=5\n', "THREAD_DUMP"), ("b.txt", '"a" #1 prio=5 tid=0x1\n   java.lang.Thread.State: RUNNABLE\n"b" daemon prio=5 tid=0x2\n', "THREAD_DUMP"), ("c.txt", "[0.1s][info][gc] GC(0) Pause\n[0.2s][info][gc] GC(1) Pause\n", "GC_LOG"),
    ("d.txt", " 1: 2 3 a.B\n 2: 2 3 a.C\n 3: 1 1 a.D\n", "HEAP_HISTO"), ("e.bin", "at a.B\njava.lang.IllegalStateException: x\n", "APP_LOG"), ("my-gc.bin", "nothing\n", "GC_LOG"), ("x.jstack", "nothing\n", "THREAD_DUMP"), ("z-histo", "", "HEAP_HISTO"), ("app.out", "nothing", "APP_LOG"), ("q.bin", "nothing", "UNKNOWN"),
]


@query("src_sniff", wanted("name, kind", [(b, a, c) for a, b, c in _FILES]))
def src_sniff(spark, d):
    of = lambda k: F.element_at(F.array(*[F.lit(f[k]) for f in _FILES]), (F.col("n_nationkey") % len(_FILES) + 1).cast("int"))
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("snapshot_id"), of(0).alias("file"), of(0).alias("ord"), of(1).alias("content"))
    return artifacts.sniff(artifacts.lines_of(files)).select(F.col("snapshot_id").cast("int").alias("n_nationkey"), F.col("file").alias("name"), "kind")


def kind_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("snapshot_id"), F.concat(F.lit("f"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("file"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("ord"), F.element_at(F.array(*map(F.lit, ["GC_LOG", "HEAP_HISTO", "APP_LOG", "THREAD_DUMP"])), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("kind"))


_KINDS = "WITH c AS (SELECT c_mktsegment AS snapshot_id, 'f' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS file, (['GC_LOG', 'HEAP_HISTO', 'APP_LOG', 'THREAD_DUMP'])[c_nationkey % 4 + 1] AS kind FROM customer)"


@query("src_kept", _KINDS + " SELECT snapshot_id, kind, count(*) AS n, min(file) AS first FROM c WHERE kind IN ('APP_LOG', 'THREAD_DUMP') GROUP BY 1, 2 UNION ALL SELECT snapshot_id, kind, 1, min(file) FROM c WHERE kind IN ('GC_LOG', 'HEAP_HISTO') GROUP BY 1, 2")
def src_kept(spark, d):
    kept, _ = artifacts.first_of_kind(kind_rows(spark, d))
    return kept.groupBy("snapshot_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first"))


@query("src_skipped", _KINDS + " SELECT snapshot_id, kind, min(file) AS kept, count(*) - 1 AS n_dropped, string_agg(file, ',' ORDER BY file) AS all_files FROM c WHERE kind IN ('GC_LOG', 'HEAP_HISTO') GROUP BY 1, 2 HAVING count(*) > 1")
def src_skipped(spark, d):
    _, skipped = artifacts.first_of_kind(kind_rows(spark, d))
    return skipped.select("snapshot_id", "kind", "kept", F.size("dropped").cast("long").alias("n_dropped"), F.concat_ws(",", "kept", F.array_join("dropped", ",")).alias("all_files"))


@query("fn_locks", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_nationkey WHEN c_custkey % 3 = 0 THEN 'r' ELSE 'p' END AS wanted, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS monitors, CASE WHEN c_custkey % 5 = 0 THEN 'o,h,g' ELSE 'o,h' END AS held FROM customer""")
def fn_locks(spark, d):
    key = F.col("c_custkey")
    lock = lambda kind, addr: F.struct(F.lit(kind).alias("kind"), addr.alias("addr"))
    given = F.array_compact(F.array(
        lock("HELD", F.lit("h")), F.when(key % 2 == 0, lock("WAITING_TO_LOCK", F.lit("early"))), F.when(key % 2 == 0, lock("WAITING_TO_LOCK", F.concat(F.lit("w"), F.col("c_nationkey").cast("string")))), F.when(key % 3 == 0, lock("RE_LOCK_AFTER_WAIT", F.lit("r"))),
        lock("PARKING", F.lit("p")), lock("WAITING_ON", F.lit("on")), F.when(key % 5 == 0, lock("HELD", F.lit("g"))), lock("OWNABLE_HELD", F.lit("o")),
    ))
    c = table(spark, d, "customer").withColumn("locks", given)
    locks = F.col("locks")
    return c.select("c_custkey", X.waiting_monitor(locks)["addr"].alias("wanted"), F.size(X.held_monitors(locks)).alias("monitors"), F.array_join(F.transform(X.held_synchronizers(locks), lambda x: x["addr"]), ",").alias("held"))


@query("fn_idle", """SELECT c_custkey, c_nationkey % 5 IN (0, 1) AND c_custkey % 4 IN (2, 3) AS idle, c_nationkey % 5 = 3 AND c_custkey % 4 = 3 AS sleeping, c_nationkey % 5 = 2 AND c_custkey % 4 = 0 AS socket, 0 AS worker FROM customer""")
def fn_idle(spark, d):
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    frame = lambda cls, method: F.array(F.struct(F.lit(cls).alias("cls"), F.lit(method).alias("method")))
    stack = F.element_at(F.array(frame("java.lang.Object", "wait"), frame("java.util.concurrent.ThreadPoolExecutor", "getTask"), frame("sun.nio.ch.Net", "poll"), frame("java.lang.Thread", "sleep"), frame("app.Main", "run")), (nation % 5 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ["RUNNABLE", "BLOCKED", "WAITING", "TIMED_WAITING"])), (key % 4 + 1).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", stack.alias("stack"), state.alias("state"))
    s, t = F.col("state"), F.col("stack")
    return c.select("c_custkey", X.idle_worker(s, t, F.lit("")).alias("idle"), X.sleeping(s, t).alias("sleeping"), X.socket_blocked(s, t).alias("socket"), X.vm_worker(t, F.array().cast("array<string>")).cast("int").alias("worker"))


@query("fn_chain", "SELECT e AS event_id, outer_cls AS outermost, root, start_line FROM (WITH RECURSIVE x AS (SELECT 1) SELECT event_id AS e, CASE event_type WHEN 'error' THEN 'app.CrashError' ELSE 'app.' || upper(left(event_type, 1)) || substr(event_type, 2) || 'Exception' END AS outer_cls, CASE WHEN event_id % 2 = 0 THEN 'SQLException' ELSE CASE event_type WHEN 'error' THEN 'CrashError' ELSE upper(left(event_type, 1)) || substr(event_type, 2) || 'Exception' END END AS root, 7 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) + 2 AS start_line FROM events)")
def fn_chain(spark, d):
    x, chain = thrown_tables(spark, d).exceptions, F.col("chain")
    return x.select(F.regexp_extract(X.outermost(chain)["message"], "(\\d+)", 1).cast("long").alias("event_id"), X.outermost(chain)["cls"].alias("outermost"), X.simple_name(X.root_cause(chain)["cls"]).alias("root"), "start_line")


# --- correlation ---------------------------------------------------------------------------------------------------


@query("co_status", """WITH s AS (SELECT DISTINCT 's' || (doc_id % 13) AS snapshot_id FROM labels), f AS (SELECT 's' || (doc_id % 13) AS snapshot_id, (['GCA001','GCA003','EXC001','TDA004','GCA002','HIS001','GCA006'])[doc_id % 7 + 1] AS rule_id, count(*) AS n FROM labels GROUP BY 1, 2),
    r AS (SELECT * FROM (VALUES ('TDA'), ('GCA'), ('HIS'), ('EXC')) a(a), range(1, 8) g(g) WHERE (a = 'TDA' AND g <= 6) OR a = 'GCA' OR g <= 3), w AS (SELECT snapshot_id, a || '00' || g AS rule_id, a FROM s, r)
    SELECT snapshot_id, rule_id, CASE WHEN rule_id = 'GCA007' THEN 'error' WHEN n = 1 THEN '1 finding' WHEN n > 1 THEN n || ' findings' WHEN a = 'HIS' THEN 'not-applicable' WHEN rule_id = 'TDA003' THEN 'declined: one capture' ELSE 'clean' END AS status FROM w LEFT JOIN f USING (snapshot_id, rule_id)""")
def co_status(spark, d):
    found = finding_rows(spark, d)
    snapshots = found.select("snapshot_id").distinct()
    present = snapshots.withColumn("kind", F.explode(F.array(*map(F.lit, ["GC_LOG", "THREAD_DUMP", "APP_LOG"]))))
    declined = snapshots.withColumns({"rule_id": F.lit("TDA003"), "why": F.lit("one capture")})
    return correlate.rule_status(snapshots, present, found, declined, RULES, ["GCA007"])


@query("co_gate", _FINDINGS + " SELECT snapshot_id, bool_or(rank <= 1) AS failed FROM f GROUP BY 1")
def co_gate(spark, d):
    found = finding_rows(spark, d).where("snapshot_id is not null")
    return Analysis(None, None, None, found, None, None, None, LIMITS).gate("HIGH")


@query("co_timeline", """WITH r0 AS (SELECT event_id, event_type, value, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), e AS (SELECT 'u' || user_id AS snapshot_id, k + 2 AS line_no, k * 2500 * (1 + user_id % 40) + event_id % 1000 AS at_ms, round(value * 8, 3) AS ms, event_type IN ('signup', 'purchase') AS is_full, event_type FROM r0)
    SELECT snapshot_id, line_no, round(at_ms / 1000.0::DOUBLE, 3) AS sort_key, CASE WHEN is_full THEN 'Full GC' WHEN event_type = 'view' THEN 'YOUNG pause' WHEN event_type = 'click' THEN 'MIXED pause' ELSE 'ALLOCATION_STALL pause' END AS what FROM e WHERE is_full OR ms > 200""")
def co_timeline(spark, d):
    t = gc_tables(spark, d)
    t.dumps = desk_tables(spark, d).dumps.limit(0)
    t.exceptions = thrown_tables(spark, d).exceptions.limit(0)
    made = correlate.timeline(t, LIMITS)
    return made.select("snapshot_id", "line_no", F.round("sort_key", 3).alias("sort_key"), F.regexp_extract("label", "^(Full GC|\\w+ pause)", 1).alias("what"))


@query("co_timeline_exceptions", """WITH t AS (SELECT 'u' || user_id AS snapshot_id, event_id AS e, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, CASE event_type WHEN 'error' THEN 'app.CrashError' ELSE 'app.' || upper(left(event_type, 1)) || substr(event_type, 2) || 'Exception' END AS cls FROM events),
    p AS (SELECT snapshot_id, CASE WHEN e % 2 = 0 THEN 'java.sql.SQLException' ELSE cls END AS root, CASE WHEN e % 2 = 0 THEN '' ELSE cls END || e % 4 AS print, count(*) AS n, min(7 * k + 2) AS line_no FROM t GROUP BY 1, 2, 3)
    SELECT snapshot_id, 'First exception: ' || cls AS label, 2 AS line_no, true AS major FROM t WHERE k = 0 UNION ALL SELECT snapshot_id, n || ' × ' || root, line_no, n >= 20 FROM p WHERE n >= 5""")
def co_timeline_exceptions(spark, d):
    t = thrown_tables(spark, d)
    other = gc_tables(spark, d)
    t.gc_logs, t.gc_events, t.dumps = other.gc_logs.limit(0), other.gc_events.limit(0), desk_tables(spark, d).dumps.limit(0)
    return correlate.timeline(t, LIMITS).select("snapshot_id", "label", "line_no", "major")


@query("co_quotes", "WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\r|\\n)+$', ''), '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\r|\\n)+$', ''), '\\r\\n|\\r|\\n'), 1) AS n FROM documents) SELECT doc_id, CASE WHEN length(rtrim(line, ' ')) > 200 THEN left(line, 199) || '…' ELSE rtrim(line, ' ') END AS quote FROM l WHERE n = 1 AND doc_id % 2 = 0 AND NOT contains(line, chr(27))")
def co_quotes(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.lit("s").alias("snapshot_id"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").cast("string").alias("ord"), F.col("text").alias("content"))
    lines = artifacts.lines_of(files)
    span = F.struct(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("quote"), F.lit("first").alias("note"))
    found = docs.where("doc_id % 2 = 0 and text is not null and not contains(substring_index(text, '\\n', 1), char(27))").select(F.lit("s").alias("snapshot_id"), F.lit("R").alias("rule_id"), F.col("doc_id").cast("string").alias("summary"), F.lit(None).cast("string").alias("variant"), F.array(span).alias("evidence"))
    return correlate.quoted(found, lines).select(F.col("summary").cast("long").alias("doc_id"), F.get("evidence", 0)["quote"].alias("quote"))


@query("co_single_axis", "SELECT 'n' || n_nationkey AS snapshot_id, NOT (n_nationkey % 3 = 0 AND n_nationkey % 2 = 0) AS single_axis FROM nation")
def co_single_axis(spark, d):
    key = F.col("n_nationkey")
    n = table(spark, d, "nation").withColumn("snapshot_id", F.concat(F.lit("n"), key.cast("string")))
    up = n.where(key % 3 == 0).select("snapshot_id", F.lit(1.0).alias("uptime_sec"), F.lit(None).cast("long").alias("epoch_ms"))
    wall = n.select("snapshot_id", F.lit(None).cast("double").alias("uptime_sec"), F.lit(5).cast("long").alias("epoch_ms"))
    logs = n.select("snapshot_id", F.when(key % 2 == 1, 3).cast("long").alias("boot_epoch_ms"))
    return correlate.single_axis(up.unionByName(wall), logs)


@query("components_ring", "SELECT c_custkey AS node, 0 AS component, (SELECT count(*) FROM customer) AS size FROM customer")
def components_ring(spark, d):
    """All customers in one ring: as long a path as there are nodes."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("src"))
    return graph.strong_components(c.withColumn("dst", (F.col("src") + 1) % c.count()))


_BRANCHED = "WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) AS dst FROM supplier UNION SELECT s_suppkey, s_nationkey % (SELECT count(*) FROM supplier) FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query("components_branched", _BRANCHED + ", p AS (SELECT DISTINCT x.src AS node, x.dst AS other FROM r x JOIN r y ON x.dst = y.src AND y.dst = x.src) SELECT n.src AS node, least(n.src, coalesce(min(p.other), n.src)) AS component, greatest(1, count(p.other)) AS size FROM (SELECT src FROM e UNION SELECT dst FROM e) n LEFT JOIN p ON n.src = p.node GROUP BY n.src")
def components_branched(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_nationkey").cast("long").alias("v"))
    n = s.count()
    edges = s.select(F.col("k").alias("src"), ((F.col("k") * 3 + 1) % n).alias("dst")).unionByName(s.where("k % 2 = 0").select(F.col("k").alias("src"), (F.col("v") % n).alias("dst")))
    return graph.strong_components(edges)
