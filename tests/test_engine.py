"""Artifacts in, findings out: a positive and a negative case for the rules, parsers on texts of our own."""

import pytest
from pyspark.sql import functions as F

from quern.config import Thresholds
from quern.operators import graph, series
from quern.plans import exceptions, gc, histograms, threads
from quern.plans.engine import Engine
from quern.rules import RULES
from quern.sources import artifacts

HEADER = "2024-05-01 10:00:0{n}\nFull thread dump OpenJDK 64-Bit Server VM (17.0.9+9 mixed mode):\n\n"


def blocked(name, k, wants, holds=None):
    held = f"\t- locked <{holds}> (a java.lang.Object)\n" if holds else ""
    return (
        f'"{name}" #{k} prio=5 os_prio=0 cpu=10.00ms elapsed=50.00s tid=0x00{k} nid=0x{k:x} waiting for monitor entry  [0x01]\n   java.lang.Thread.State: BLOCKED (on object monitor)\n'
        f"\tat app.Ledger.post(Ledger.java:42)\n\t- waiting to lock <{wants}> (a java.lang.Object)\n{held}\tat app.Main.run(Main.java:7)\n\n"
    )


def idle(name, k):
    return (
        f'"{name}" #{k} prio=5 os_prio=0 cpu=1.00ms elapsed=50.00s tid=0x00{k} nid=0x{k:x} waiting on condition  [0x01]\n   java.lang.Thread.State: WAITING (parking)\n'
        "\tat jdk.internal.misc.Unsafe.park(java.base@17/Native Method)\n\t- parking to wait for  <0xaa> (a java.util.Q)\n\tat java.util.concurrent.LinkedBlockingQueue.take(java.base@17/LinkedBlockingQueue.java:435)\n\n"
    )


DEADLOCK = (
    HEADER.format(n=1) + blocked("writer", 11, "0x0a", "0x0b") + blocked("reader", 12, "0x0b", "0x0a") + "".join(blocked(f"fetch-{k}", 20 + k, "0x0c") for k in range(6))
    + "Found one Java-level deadlock:\n" + blocked("writer", 11, "0x0a", "0x0b") + "Found 1 deadlock.\n"
)
QUIET = HEADER.format(n=1) + "".join(idle(f"pool-1-thread-{k}", k) for k in range(1, 7))


def gc_log(full):
    rows = [f"[{at:.3f}s][info][gc] GC({k}) Pause Full (Allocation Failure) {b}M->{a}M(256M) {ms}.000ms" for k, (at, b, a, ms) in enumerate(full)]
    return "[0.005s][info][gc] Using G1\n" + "\n".join(rows) + "\n"


def stack(k, minute=0):
    return (
        f"2024-05-01 10:{minute:02d}:{k % 60:02d},123 ERROR [main] app.Web - failed\njava.lang.IllegalStateException: no {k}\n\tat app.Web.call(Web.java:5)\n\tat java.lang.Thread.run(Thread.java:9)\n"
        f"Caused by: java.sql.SQLException: gone\n\tat app.Db.get(Db.java:77)\n\t... 2 more\n2024-05-01 10:{minute:02d}:{k % 60:02d},200 INFO done\n"
    )


HISTO = " num     #instances         #bytes  class name (module)\n-------\n   1:       2000000      200000000  [B (java.base@17)\n   2:          9000         480000  app.Row\nTotal       2009000      200480000\n"


def analyzed(spark, texts, only, **thresholds):
    """Analysis by some of the rules: each is a plan of its own to compile."""
    return Engine([r for r in RULES if r.id in only.split()]).analyze(artifacts.from_texts(spark, texts), Thresholds().override(**thresholds))


def fired(analysis):
    return {(r.snapshot_id, r.rule_id) for r in analysis.findings.select("snapshot_id", "rule_id").collect()}


@pytest.fixture(scope="module")
def many(spark):
    return analyzed(
        spark,
        [
            ("dead", "a.jstack", DEADLOCK), ("quiet", "a.jstack", QUIET), ("storm", "gc.log", gc_log([(10, 250, 120, 90), (20, 250, 122, 95), (28, 250, 125, 88)])),
            ("calm", "gc.log", gc_log([(10, 250, 120, 90), (600, 250, 121, 95)])), ("climb", "gc.log", gc_log([(10, 200, 100, 90), (40, 230, 140, 95), (70, 240, 190, 99)])),
            ("flat", "gc.log", gc_log([(10, 200, 40, 90), (60, 200, 41, 88), (120, 200, 40, 92)])), ("errors", "app.log", "".join(stack(k) for k in range(12))), ("heap", "heap.histo", HISTO),
        ],
        "TDA001 TDA002 TDA003 GCA001 GCA003 EXC001 HIS001",
    )


def test_rules_fire_where_they_should(many):
    found = fired(many)
    wanted = {("dead", "TDA001"), ("dead", "TDA002"), ("storm", "GCA001"), ("climb", "GCA003"), ("errors", "EXC001"), ("heap", "HIS001")}
    assert wanted <= found
    assert not {r for s, r in found if s == "quiet"}
    assert ("calm", "GCA001") not in found and ("flat", "GCA003") not in found


def test_deadlock_evidence_and_confidence(many):
    row = many.findings.where("snapshot_id = 'dead' and rule_id = 'TDA001'").first()
    assert row.severity == "CRITICAL" and row.confidence == 0.99
    assert row.evidence[0].file == "a.jstack" and row.evidence[0].quote.startswith('"writer"')


def test_hypotheses_and_status(many):
    best = {r.snapshot_id: r.hypothesis for r in many.hypotheses.where("place = 1").collect()}
    assert best["dead"] == "H-DEADLOCK" and best["climb"] == "H-HEAP-LEAK" and best["errors"] == "H-ERROR-DRIVER"
    status = {(r.snapshot_id, r.rule_id): r.status for r in many.status.collect()}
    assert status["quiet", "TDA001"] == "clean" and status["quiet", "GCA001"] == "not-applicable"
    assert status["quiet", "TDA003"].startswith("declined")
    assert status["dead", "TDA001"] == "1 finding"


def test_timeline(many):
    labels = [r.label for r in many.timeline.where("snapshot_id = 'storm'").orderBy("sort_key").collect()]
    assert labels == ["Full GC 90 ms, heap after 120M", "Full GC 95 ms, heap after 122M", "Full GC 88 ms, heap after 125M"]


def lines(spark, text, name="f"):
    return artifacts.lines_of(artifacts.from_texts(spark, [("s", name, text)]))


def test_thread_parser_keeps_report_out(spark):
    dumps, rows = threads.parse(lines(spark, DEADLOCK))
    d = dumps.collect()
    assert len(d) == 1 and d[0].vm_reported_deadlock and d[0].vm_deadlock_count == 1
    by_name = {r.name: r for r in rows.collect()}
    assert len(by_name) == 8 and rows.count() == 8
    w = by_name["writer"]
    assert w.state == "BLOCKED" and w.cpu_ms == 10.0 and w.nid == "0xb" and [k.kind for k in w.locks] == ["WAITING_TO_LOCK", "HELD"]
    assert w.stack[0].cls == "app.Ledger" and w.stack[0].src_line == 42


def test_two_captures(spark):
    dumps, rows = threads.parse(lines(spark, HEADER.format(n=1) + idle("a", 1) + HEADER.format(n=5) + idle("a", 1)))
    assert dumps.count() == 2 and rows.count() == 2


def test_traditional_gc(spark):
    text = (
        "2024-01-01T00:00:05.000+0000: 5.000: [Full GC (Ergonomics) [PSYoungGen: 1024K->0K(2048K)] [ParOldGen: 30720K->20480K(40960K)] 31744K->20480K(43008K), [Metaspace: 3072K->3072K(4096K)], 12.345678 secs] [Times: user=1.0]\n"
        "2024-01-01T00:00:09.000+0000: 9.000: [GC (Allocation Failure) [PSYoungGen: 2048K->512K(2048K)] 22528K->20992K(43008K), 0.010 secs] [Times: user=0.1]\n"
    )
    logs, events = gc.parse(lines(spark, text))
    assert logs.first().collector == "PARALLEL" and not logs.first().unified
    a, b = events.orderBy("seq").collect()
    assert (a.kind, a.cause, round(a.pause_ms, 3), a.old_after, a.metaspace_after) == ("FULL", "Ergonomics", 12345.678, 20 * 2**20, 3 * 2**20)
    assert (b.kind, b.heap_after, b.at_ms) == ("YOUNG", 20992 * 1024, 9000)


def test_histogram_without_total(spark):
    h, rows = histograms.parse(lines(spark, HISTO.replace("Total       2009000      200480000\n", "")))
    assert h.first().total_bytes == 200480000 and h.first().note and rows.first().class_name == "[B"


def test_exception_chain(spark):
    rows = exceptions.parse(lines(spark, stack(1) + "plain java.lang.Exception in text\n" + stack(2))).orderBy("occ").collect()
    assert [len(r.chain) for r in rows] == [2, 2]
    assert rows[0].chain[1].cls == "java.sql.SQLException" and rows[0].chain[1].frames[0].method == "get" and rows[0].epoch_ms == 1714557601123


def test_empty_and_garbage(spark):
    a = analyzed(spark, [("s", "x.txt", ""), ("s", "y.bin", "\x00\x01 nothing here\n\n\n")], "TDA001 GCA001 HIS001 EXC001")
    assert a.findings.count() == 0 and a.timeline.count() == 0


def test_thresholds_take_effect(spark):
    assert ("s", "HIS001") not in fired(analyzed(spark, [("s", "heap.histo", HISTO)], "HIS001", **{"histo-top-min-leader-mb": 500}))


def test_pointer_doubling_against_walk(spark):
    import random

    rng = random.Random(3)
    edges = [(0, k, rng.randrange(40)) for k in range(40)]
    to = {a: b for _, a, b in edges}
    on = set()
    for k in to:
        path, x = [], k
        for _ in range(41):
            x = to[x]
            path.append(x)
        if k in path:
            on.add(k)
    found = graph.functional_cycles(spark.createDataFrame(edges, "dump int, src long, dst long"), ["dump"]).collect()
    assert {r.node for r in found} == on


def test_densest_window_against_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(1, rng.randrange(200), k) for k in range(60)]
    best = max(sum(1 for _, b, _ in rows if a <= b <= a + 20) for _, a, _ in rows)
    got = series.densest_window(spark.createDataFrame(rows, "k int, at long, seq long"), ["k"], "at", "seq", 20).first()
    assert got.n == best


def test_first_of_kind(spark):
    kinds = spark.createDataFrame([("s", "a", "1", "GC_LOG"), ("s", "b", "2", "GC_LOG"), ("s", "c", "3", "APP_LOG")], "snapshot_id string, file string, ord string, kind string")
    kept, skipped = artifacts.first_of_kind(kinds)
    assert {r.file for r in kept.collect()} == {"a", "c"} and skipped.first().dropped == ["b"]


def test_scan_decodes_and_strips(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("﻿\x1b[31mred\x1b[0m é\r\nb\n\n".encode())
    (tmp_path / "l.log").write_bytes("caf\xe9\n".encode("latin-1"))
    (tmp_path / "x.zip").write_bytes(b"PK")
    files, large = artifacts.scan(spark, str(tmp_path))
    got = {(r.file, r.line_no): r.text for r in artifacts.lines_of(files).collect()}
    assert got == {("a.log", 1): "red é", ("a.log", 2): "b", ("l.log", 1): "café"} and large.count() == 0


def test_severity_gate(many):
    assert {r.snapshot_id for r in many.gate("CRITICAL").where(F.col("failed")).collect()} >= {"dead"}


@pytest.mark.parametrize("rule", ["TDA004", "TDA005", "EXC002", "EXC003", "GCA002", "GCA006"])
def test_single_rules(spark, rule):
    slow = gc_log([(10 * k, 250, 120, 900) for k in range(1, 13)])
    texts = [("dead", "a.jstack", DEADLOCK), ("errors", "app.log", "".join(stack(k) for k in range(12))), ("slow", "gc.log", slow), ("quiet", "a.jstack", QUIET)]
    found = fired(analyzed(spark, texts, rule))
    where = {"T": "dead", "E": "errors", "G": "slow"}[rule[0]]
    assert found == {(where, rule)}
