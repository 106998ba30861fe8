"""Rules over thread dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Thresholds
from ..functions import exprs as X
from ..functions.fixed import SERVER_POOL_BAR
from ..operators.graph import functional_cycles, wait_edges
from ..operators.series import top_k
from .base import Rule, Tables, findings, first_few, ordered, span, with_evidence

DUMP = ["snapshot_id", "file", "dump", "dump_ord"]


def deadlocks(t: Tables, c: Thresholds) -> DataFrame:
    """Cycles of the wait-for graph; a capture whose report names a deadlock without one gives a weaker finding."""
    edges = wait_edges(t.threads, DUMP)
    cycles = functional_cycles(edges, DUMP)
    named = t.threads.select(*DUMP, F.col("start_line").alias("node"), "name")
    told = t.dumps.select(*DUMP, "vm_reported_deadlock", "vm_deadlock_count")
    each = cycles.join(named, [*DUMP, "node"]).join(edges.select(*DUMP, F.col("src").alias("node"), F.col("dst").alias("owner"), "monitor", "monitor_class", "wait_line", "hold_line"), [*DUMP, "node"])
    ring = each.groupBy(*DUMP, "cycle").agg(F.max("length").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "name"))), lambda x: x["name"]), " -> ").alias("names"))
    # of each thread where it waits, then where the one it waits for took the lock
    by_owner = each.join(named.select(*DUMP, F.col("node").alias("owner"), F.col("name").alias("owner_name")), [*DUMP, "owner"])
    waits = span("file", "node", "wait_line", F.concat(F.lit("waits for "), F.coalesce("monitor_class", F.lit("a lock")), F.lit(" "), F.col("monitor")))
    holds = span("file", "hold_line", note=F.concat(F.col("monitor"), F.lit(" was taken here by "), F.col("owner_name")))
    both = by_owner.select(*DUMP, "cycle", "node", F.posexplode(F.array(waits, holds)).alias("side", "e"))
    ring = with_evidence(ring, first_few(both, [*DUMP, "cycle"], [F.col("node"), F.col("side")], F.col("e"), c.max_evidence), [*DUMP, "cycle"])
    rows = ring.join(told, DUMP)
    graph = findings(
        rows, "TDA001", "Deadlock", "THREAD_DUMP", F.lit("CRITICAL"), F.when(F.col("vm_reported_deadlock"), 0.99).otherwise(0.92), F.format_string("%d threads wait in a ring: %s", "length", "names"),
        F.col("evidence"), {"threads": F.col("length"), "reported": F.col("vm_reported_deadlock")}, ["Take the locks in one order.", "Restart to restore service; the threads won't return."], "cycle",
    )
    only = told.where("vm_reported_deadlock").join(ring.select(*DUMP).distinct(), DUMP, "left_anti")
    report = findings(
        only, "TDA001", "Deadlock", "THREAD_DUMP", F.lit("CRITICAL"), F.lit(0.8), F.lit("the capture reports a deadlock that its threads don't show"), F.array(span("file", F.lit(1))),
        {"reported": F.lit(True)}, ["Read the report at the end of the capture."], "reported",
    )
    return graph.unionByName(report)


def contention(t: Tables, c: Thresholds) -> DataFrame:
    """Monitors with many waiters, the three worst of a capture; the holder is the first that has it."""
    locks = t.threads.select(*DUMP, "name", "start_line", F.explode("locks").alias("lock"))
    waiting = locks.where("lock.kind = 'WAITING_TO_LOCK'").groupBy(*DUMP, F.col("lock.addr").alias("monitor")).agg(
        F.count(F.lit(1)).alias("waiters"), F.max("lock.cls").alias("cls"), F.min("start_line").alias("first"),
        F.slice(ordered(F.col("start_line"), span("file", "start_line", F.col("lock.line_no"), F.concat(F.lit("waiter "), F.col("name")))), 1, c.max_evidence - 1).alias("waiting"),
    ).where(F.col("waiters") >= max(2, c.lock_waiters))
    worst = top_k(waiting, DUMP, [F.desc("waiters"), F.col("first")], 3)
    held = locks.where("lock.kind = 'HELD'").groupBy(*DUMP, F.col("lock.addr").alias("monitor")).agg(F.min_by(F.struct("name", F.col("lock.line_no").alias("line")), "start_line").alias("holder"))
    rows = worst.join(held, [*DUMP, "monitor"], "left")
    holder = F.when(F.col("holder").isNotNull(), F.array(span("file", F.col("holder.line"), note=F.concat(F.lit("holder "), F.col("holder.name"))))).otherwise(F.array().cast("array<struct<file:string,start_line:int,end_line:int,quote:string,note:string>>"))
    return findings(
        rows, "TDA002", "Lock contention", "THREAD_DUMP", F.when(F.col("waiters") >= 10, "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.95), 0.55 + 0.04 * F.col("waiters")),
        F.format_string("%d threads wait for %s held by %s", "waiters", F.coalesce("cls", "monitor"), F.coalesce("holder.name", F.lit("nobody visible"))), F.concat(holder, F.col("waiting")),
        {"waiters": F.col("waiters"), "monitor": F.col("monitor")}, ["Shorten what runs under this lock or split it."],
    )


def families(t: Tables) -> DataFrame:
    """Threads with their family; VM workers (no stack, no locks) have none."""
    own = t.threads.where(~X.vm_worker(F.col("stack"), F.col("locks")))
    return own.withColumn("family", X.name_family(F.col("name")))


def oversized(t: Tables, c: Thresholds, most: int | None = None) -> DataFrame:
    """Families that are too large; most: only so many of a capture, the largest first."""
    own, of = families(t).where(~X.jvm_internal_name(F.col("name"))), [*DUMP, "family"]
    counted = own.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"))
    bar = F.when(X.server_pool(F.col("family")), SERVER_POOL_BAR).otherwise(c.thread_leak_threshold)
    rows = counted.withColumn("bar", bar).where("n >= bar")
    if most is not None:
        rows = top_k(rows, DUMP, [F.desc("n"), F.col("first")], most)
    rows = with_evidence(rows, first_few(own, of, [F.col("start_line")], span("file", "start_line", note="name"), c.max_evidence), of)
    return findings(
        rows, "TDA003", "Thread leak", "THREAD_DUMP", F.lit("HIGH"), F.least(F.lit(0.9), 0.6 + (F.col("n") - F.col("bar")) / 200.0), F.format_string("%d threads named like %s", "n", "family"),
        F.col("evidence"), {"family": F.col("family"), "threads": F.col("n")}, ["Find who starts these threads and never ends them."], "oversized",
    )


def growing(t: Tables, c: Thresholds) -> DataFrame:
    """Families that never shrink over captures and end large. Captures without the family are skipped."""
    counted = families(t).where(~X.jvm_internal_name(F.col("name"))).groupBy("snapshot_id", "family", "dump_ord").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "start_line")).alias("at"))
    w = Window.partitionBy("snapshot_id", "family").orderBy("dump_ord")
    grown = counted.withColumn("fell", F.coalesce(F.col("n") < F.lag("n").over(w), F.lit(False))).groupBy("snapshot_id", "family").agg(
        F.count(F.lit(1)).alias("captures"), F.bool_or("fell").alias("fell"), F.min_by("n", "dump_ord").alias("first"), F.max_by("n", "dump_ord").alias("last"),
        ordered(F.col("dump_ord"), span(F.col("at.file"), F.col("at.start_line"), note=F.format_string("%d threads", "n"))).alias("evidence"),
    )
    bar = F.when(X.server_pool(F.col("family")), SERVER_POOL_BAR).otherwise(min(c.thread_leak_threshold, SERVER_POOL_BAR))
    rows = grown.withColumn("ratio", F.col("last") / F.col("first")).where((F.col("captures") >= 2) & ~F.col("fell") & (F.col("last") >= bar) & (F.col("ratio") >= c.thread_leak_growth))
    return findings(
        rows, "TDA003", "Thread leak", "THREAD_DUMP", F.lit("HIGH"), F.least(F.lit(0.95), 0.75 + 0.05 * F.col("ratio")), F.format_string("%s grew from %d to %d threads", "family", "first", "last"),
        F.slice("evidence", 1, c.max_evidence), {"family": F.col("family"), "first": F.col("first"), "last": F.col("last")}, ["Bound the pool or end its threads."], "growing",
    )


def one_capture(t: Tables, c: Thresholds) -> DataFrame:
    single = t.dumps.groupBy("snapshot_id").count().where("count < 2")
    return single.select("snapshot_id", F.lit("one capture shows no growth; take a second one").alias("why"))


def stuck_crowds(t: Tables, c: Thresholds) -> DataFrame:
    """Many threads stopped with the same top frames, and many that read from a socket."""
    state, stack, locks = F.col("state"), F.col("stack"), F.col("locks")
    quiet = X.vm_worker(stack, locks) | X.jvm_internal_name(F.col("name")) | X.idle_worker(state, stack, F.col("wait_status")) | X.sleeping(state, stack)
    stopped = t.threads.where(state.isin("BLOCKED", "WAITING", "TIMED_WAITING") & ~quiet & (F.size(stack) > 0)).withColumn("print", X.stack_fingerprint(state, stack, 5))
    crowds = stopped.groupBy(*DUMP, "print").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(state == "BLOCKED").alias("blocked"), F.min("start_line").alias("first"), F.min_by(F.get(stack, 0), "start_line").alias("top"),
    )
    whole = span("file", "start_line", "end_line", F.col("name"))
    rows = top_k(crowds.where(F.col("n") >= c.stack_cluster), DUMP, [F.desc("n"), F.col("first")], 2)
    rows = with_evidence(rows, first_few(stopped, [*DUMP, "print"], [F.col("start_line")], whole, c.max_evidence), [*DUMP, "print"])
    crowd = findings(
        rows, "TDA004", "Threads at one place", "THREAD_DUMP", F.when((F.col("blocked") >= F.col("n") / 2) & (F.col("blocked") >= c.stack_cluster), "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.9), 0.5 + 0.03 * F.col("n")),
        F.format_string("%d threads stand at %s", "n", X.frame_id(F.col("top.cls"), F.col("top.method"))), F.col("evidence"), {"threads": F.col("n"), "blocked": F.col("blocked"), "variant": F.lit("stack-cluster")}, ["Look at what this frame waits for."], "stack-cluster",
    )
    waiting = t.threads.where(X.socket_blocked(state, stack)).withColumn("where", X.frame_id(F.get(stack, 0)["cls"], F.get(stack, 0)["method"]))
    by_frame = waiting.groupBy(*DUMP, "where").agg(F.count(F.lit(1)).alias("k"), F.min("start_line").alias("first_line_no"))
    top = by_frame.groupBy(*DUMP).agg(F.max_by("where", F.struct("k", -F.col("first_line_no"))).alias("place"))
    total = waiting.groupBy(*DUMP).agg(F.count(F.lit(1)).alias("n"))
    io = total.join(top, DUMP).where(F.col("n") >= max(3, c.stack_cluster - 2))
    io = with_evidence(io, first_few(waiting, DUMP, [F.col("start_line")], whole, c.max_evidence), DUMP)
    network = findings(
        io, "TDA004", "Threads at one place", "THREAD_DUMP", F.lit("MEDIUM"), F.lit(0.72), F.format_string("%d threads read from the network, most at %s", "n", "place"), F.col("evidence"),
        {"threads": F.col("n"), "variant": F.lit("socket-io")}, ["Set timeouts and look at the dependency."], "socket-io",
    )
    return crowd.unionByName(network)


def starved_pools(t: Tables, c: Thresholds) -> DataFrame:
    """Pools almost all of whose threads are busy at one frame."""
    state, stack = F.col("state"), F.col("stack")
    busy = ~X.idle_worker(state, stack, F.col("wait_status")) & F.coalesce(state != "TERMINATED", F.lit(True)) & ~X.sleeping(state, stack)
    own = X.first_business_frame(stack)
    place = F.coalesce(X.frame_id(own["cls"], own["method"]), X.frame_id(F.get(stack, 0)["cls"], F.get(stack, 0)["method"]))
    members = families(t).where(~X.jvm_internal_name(F.col("name"))).withColumn("busy", busy).withColumn("place", F.when(F.col("busy"), place))
    pools = members.groupBy(*DUMP, "family").agg(F.count(F.lit(1)).alias("n"), F.count_if("busy").alias("working"))
    pools = pools.where((F.col("n") >= c.pool_starve_min_size) & (F.col("n") <= c.pool_max_size) & (F.col("working") >= 4) & (F.col("working") / F.col("n") >= 0.8))
    same = members.where("place is not null").groupBy(*DUMP, "family", "place").agg(
        F.count(F.lit(1)).alias("k"), F.min("start_line").alias("first"), F.slice(ordered(F.col("start_line"), span("file", "start_line", "end_line", F.col("name"))), 1, c.max_evidence).alias("evidence")
    )
    rows = top_k(same, [*DUMP, "family"], [F.desc("k"), F.col("first")], 1).join(pools, [*DUMP, "family"]).withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= c.pool_starve_same_frame)
    return findings(
        rows, "TDA005", "Starved pool", "THREAD_DUMP", F.lit("HIGH"), F.least(F.lit(0.93), 0.7 + 0.2 * F.col("share")), F.format_string("%d of %d threads of %s are at %s", "k", "n", "family", "place"), F.col("evidence"),
        {"family": F.col("family"), "busy": F.col("working"), "size": F.col("n")}, ["Bound the slow call or give it a pool of its own."],
    )


def hot_threads(t: Tables, c: Thresholds) -> DataFrame:
    """Cores a thread used between the first and last capture, or over its life if there is one capture."""
    timed = t.threads.where("cpu_ms is not null and elapsed_s is not null and elapsed_s > 0").withColumn("who", F.coalesce("nid", "name"))
    ends = t.dumps.groupBy("snapshot_id").agg(F.min("dump_ord").alias("lo"), F.max("dump_ord").alias("hi"))
    marked = timed.join(ends, "snapshot_id")
    last_of = lambda frame: frame.groupBy("snapshot_id", "who").agg(F.max_by(F.struct("name", "file", "start_line", "end_line", "cpu_ms", "elapsed_s"), "start_line").alias("x"))
    one = last_of(marked.where("dump_ord = lo and lo < hi")).withColumnRenamed("x", "a")
    two = last_of(marked.where("dump_ord = hi and lo < hi")).withColumnRenamed("x", "b")
    delta = two.join(one, ["snapshot_id", "who"]).withColumn("wall", F.col("b.elapsed_s") - F.col("a.elapsed_s")).withColumn("cpu", F.col("b.cpu_ms") - F.col("a.cpu_ms")).where("wall > 0 and cpu >= 0")
    delta = delta.select("snapshot_id", "b.name", "b.file", "b.start_line", "b.end_line", (F.col("cpu") / (F.col("wall") * 1000)).alias("cores"), "cpu", F.lit("delta").alias("variant_of"))
    single = marked.where(F.col("lo") == F.col("hi")).where(F.col("elapsed_s") >= c.cpu_min_elapsed_sec)
    average = single.select("snapshot_id", "name", "file", "start_line", "end_line", (F.col("cpu_ms") / (F.col("elapsed_s") * 1000)).alias("cores"), F.col("cpu_ms").alias("cpu"), F.lit("average").alias("variant_of"))
    all_of = delta.unionByName(average).where(~X.jvm_internal_name(F.col("name")))
    # the few rows that are told meet the sums; a window over all rows of a snapshot would hold them in one task
    total = all_of.groupBy("snapshot_id").agg(F.sum("cpu").alias("total"))
    rows = top_k(all_of.where(F.col("cores") >= c.cpu_min_cores), ["snapshot_id"], [F.desc("cores"), F.col("start_line")], c.cpu_hot_top_n)
    rows = rows.join(total, "snapshot_id").withColumn("vm_share", F.col("cpu") / F.col("total"))
    return findings(
        rows, "TDA006", "Hot thread", "THREAD_DUMP", F.when(F.col("cores") >= 0.95, "HIGH").otherwise("MEDIUM"), F.when(F.col("variant_of") == "delta", 0.85).otherwise(0.6), F.format_string("%s used %.2f cores", "name", "cores"),
        F.array(span("file", "start_line", "end_line")), {"cores": F.round("cores", 3), "vmShare": F.round("vm_share", 3), "basis": F.col("variant_of")}, ["Take a few stacks of this thread."],
    )


def leaks(t: Tables, c: Thresholds) -> DataFrame:
    # a report names the two largest families of a capture
    return oversized(t, c, 2).unionByName(growing(t, c))


RULES = [
    Rule("TDA001", "Deadlock", "THREAD_DUMP", "Sees monitors and owned synchronisers, not semaphores.", deadlocks),
    Rule("TDA002", "Lock contention", "THREAD_DUMP", "A moment's picture.", contention),
    Rule("TDA003", "Thread leak", "THREAD_DUMP", "One capture shows size, not growth.", leaks, one_capture),
    Rule("TDA004", "Threads at one place", "THREAD_DUMP", "Idle workers are left out by their frames.", stuck_crowds),
    Rule("TDA005", "Starved pool", "THREAD_DUMP", "Pools over the plausible size are left to TDA003.", starved_pools),
    Rule("TDA006", "Hot thread", "THREAD_DUMP", "Needs captures with cpu and elapsed times.", hot_threads),
]
