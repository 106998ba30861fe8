"""Wait-for graphs: edges from lock tables, cycles by pointer doubling, components of general graphs."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import held_synchronizers, waiting_monitor
from ..sources.workspace import Workspace, checkpointed

#: Strong components of a graph of at most so many edges are found in one task; a larger one is made smaller first.
AT_ONCE = 1 << 16


def wait_edges(threads: DataFrame, within: list[str]) -> DataFrame:
    """(within, src, dst, monitor, monitor_class, wait_line, hold_line): who waits for whom. src and dst are start lines.

    The owner of a monitor is the last that lists it as held, hold_line where it first does; a thread doesn't wait for itself.
    """
    held = threads.select(*within, F.col("start_line").alias("dst"), F.posexplode(held_synchronizers(F.col("locks"))).alias("nth", "lock"))
    owners = held.groupBy(*within, F.col("lock.addr").alias("monitor")).agg(F.max("dst").alias("dst"), F.max_by("lock.line_no", F.struct("dst", -F.col("nth"))).alias("hold_line"))
    wanted = waiting_monitor(F.col("locks"))
    waiters = threads.select(*within, F.col("start_line").alias("src"), wanted["addr"].alias("monitor"), wanted["cls"].alias("monitor_class"), wanted["line_no"].alias("wait_line"))
    return waiters.where("monitor is not null").join(owners, [*within, "monitor"]).where("src <> dst")


def contended(edges: DataFrame, within: list[str], least: int = 2) -> DataFrame:
    """Monitors with a visible owner and at least so many waiters."""
    return edges.groupBy(*within, "monitor").agg(F.count(F.lit(1)).alias("waiters"), F.max("dst").alias("owner")).where(F.col("waiters") >= least)


def functional_cycles(edges: DataFrame, within: list[str], most_nodes: int | None = None) -> DataFrame:
    """(within, node, cycle, length) of every node on a cycle of a graph with at most one edge out of each.

    Pointers are doubled: after k rounds each node knows the node 2**k steps on, and the smallest node
    on the way. A node is on a cycle just if something points at it after at least as many steps as
    there are nodes. Rounds follow the logarithm of the largest graph; lineage is cut by checkpoint.
    """
    checkpointed(edges.sparkSession)
    if most_nodes is None:
        most_nodes = edges.groupBy(*within).count().agg(F.max("count")).first()[0] or 0
    step = edges.select(*within, F.col("src").alias("node"), F.col("dst").alias("to"), F.least("src", "dst").alias("low")).checkpoint()
    for _ in range(max(1, math.ceil(math.log2(most_nodes + 1)))):
        ahead = step.select(*within, F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        step = step.join(ahead, [*within, "to"]).select(*within, "node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"))
        step = step.checkpoint()  # each round reads the one before twice
    reached = step.select(*within, F.col("to").alias("node")).distinct()
    on = step.join(reached, [*within, "node"]).select(*within, "node", F.col("low").alias("cycle"))
    sizes = on.groupBy(*within, "cycle").agg(F.count(F.lit(1)).alias("length"))
    return on.join(sizes, [*within, "cycle"]).select(*within, "node", "cycle", "length")


def strong_components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component, size) of the strongly connected components of a graph (src, dst); component is the smallest member.

    Nodes are those of the edges. A graph with at most one edge out of each node has its cycles by
    pointer doubling, in rounds that follow the logarithm of its size. Any other is made smaller until one
    task may hold its edges: nodes without a way in or out go, trees of nodes with one way in (or out) are
    folded into their roots by pointer doubling, and what neither makes smaller is coloured. A round of
    colouring follows one edge, so a large graph without such nodes takes as many as its longest
    shortest path is long, without a limit.
    """
    checkpointed(edges.sparkSession)
    space, names = Workspace(edges.sparkSession), itertools.count()
    keep = lambda df: space.written(df, f"graph-{next(names)}")  # noqa: E731  unlike checkpoints, files carry no constraints from round to round
    left = keep(edges.select("src", "dst").distinct())
    nodes = keep(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    if left.groupBy("src").count().where("count > 1").isEmpty():
        return _of_cycles(nodes, left)
    kind = nodes.schema["node"].dataType.simpleString()
    left = keep(left.where("src <> dst").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")))
    back = []  # what each step has to add to the components of what it left, the first step first
    while (n := left.count()) > at_once:
        left = _trimmed(left, n, keep)
        for frm, to in (("src", "dst"), ("dst", "src")):
            left, unfold = _folded(left, frm, to, keep)
            back.append(unfold)
        if left.count() > 0.9 * n:
            done, left = _coloured(left, keep)
            back.append(lambda found, done=done: found.unionByName(done))
    found = keep(left.coalesce(1).mapInArrow(_of_few, f"node {kind}, label {kind}"))
    for step in reversed(back):
        found = keep(step(found))
    named = found.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    found = found.join(named, "label").select("node", "component", "size")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))


def _of_few(batches):
    """(node, label) of all components of two nodes or more of a graph that a task may hold: Tarjan's algorithm, without recursion."""
    ways, names, kind = {}, {}, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ways.setdefault(u, []).append(v)
    at, low, open_, trail = {}, {}, set(), []
    for start in ways:
        if start in at:
            continue
        path = [(start, iter(ways[start]))]
        at[start] = low[start] = len(at)
        trail.append(start)
        open_.add(start)
        while path:
            u, rest = path[-1]
            for v in rest:
                if v not in at:
                    at[v] = low[v] = len(at)
                    trail.append(v)
                    open_.add(v)
                    path.append((v, iter(ways.get(v, ()))))
                    break
                if v in open_:
                    low[u] = min(low[u], at[v])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[u])
                if low[u] == at[u]:
                    members = [trail.pop()]
                    while members[-1] != u:
                        members.append(trail.pop())
                    open_.difference_update(members)
                    if len(members) > 1:
                        names.update(dict.fromkeys(members, u))
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(list(names), kind), pa.array(list(names.values()), kind)], names=["node", "label"])


def _trimmed(left: DataFrame, n: int, keep) -> DataFrame:
    """Edges whose start has a way in and whose end has a way out, as long as rounds drop a tenth of them."""
    while True:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = keep(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        n, before = left.count(), n
        if n > 0.9 * before or n == 0:
            return left


def _folded(left: DataFrame, frm: str, to: str, keep):
    """(edges, unfold): nodes with one edge in are folded into the root of their tree; unfold adds those that belong to components.

    In names of frm and to "in" is along to. A folded node belongs to its root's component just if a way
    leads back to the root: if it or one below it has an edge to a node of that component. Trees without a
    root hang from a ring, which is a component by itself, and what hangs there belongs to none.
    """
    only = keep(left.groupBy(F.col(to).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(frm).alias("up")).where("n = 1").select("node", "up"))
    jumps, turns = [only], math.ceil(math.log2(only.count() + 1)) + 1
    inside = lambda step: step.join(only.select(F.col("node").alias("up")), "up", "left_semi")
    while not inside(jumps[-1]).isEmpty() and len(jumps) <= turns:
        ahead = jumps[-1].select(F.col("node").alias("up"), F.col("up").alias("up2"))
        jumps.append(keep(jumps[-1].join(ahead, "up", "left").select("node", F.coalesce("up2", "up").alias("up"))))
    ringed = keep(inside(jumps[-1]).select("node", "up"))
    rings = None
    if not ringed.isEmpty():
        circling = ringed.select("node").join(only, "node").select(F.lit(0).alias("g"), F.col("node").alias("src"), F.col("up").alias("dst"))
        rings = keep(functional_cycles(circling, ["g"]).select("node", F.col("cycle").alias("label")))
    rooted = keep(jumps[-1].join(ringed.select("node"), "node", "left_anti").withColumnRenamed("up", "root"))
    # edges of trees end at a folded node; what comes from a ring never comes back
    others = left.join(only.select(F.col("node").alias(to)), to, "left_anti").join(ringed.select(F.col("node").alias(frm)), frm, "left_anti")
    others = keep(others.join(rooted.select(F.col("node").alias(frm), "root"), frm, "left").select(frm, to, "root"))
    moved = keep(others.select(F.coalesce("root", frm).alias(frm), to).where(f"{frm} <> {to}").distinct())

    def unfold(found: DataFrame) -> DataFrame:
        label = lambda node, name: found.select(F.col("node").alias(node), F.col("label").alias(name))
        ends = others.where("root is not null").join(label(to, "l"), to, "left").join(label("root", "r"), "root", "left")
        within = keep(ends.where(F.coalesce("l", to) == F.coalesce("r", "root")).select(F.col(frm).alias("node")).distinct())
        for jump in jumps:
            above = within.join(jump, "node").select(F.col("up").alias("node")).join(only, "node", "left_semi")
            within = keep(within.union(above).distinct())
        joined = keep(within.join(rooted, "node").join(label("root", "r"), "root", "left").select("node", "root", F.coalesce("r", "root").alias("label")))
        roots = joined.select(F.col("root").alias("node"), "label").distinct().join(found, "node", "left_anti")
        all_of = found.unionByName(joined.select("node", "label")).unionByName(roots)
        return all_of if rings is None else all_of.unionByName(rings)

    return moved, unfold


def _coloured(left: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(found, rest): each node takes the largest node that reaches it; those that reach back to their colour's root within the colour are a component.

    Edges between colours are in no component.
    """
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    colour = _spread(nodes.withColumn("colour", F.col("node")), left, "src", "dst", keep)
    inner = keep(
        left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src")
        .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        .where("cs = cd")
        .select("src", "dst")
    )
    seeds = colour.withColumn("mark", (F.col("node") == F.col("colour")).cast("int"))
    back = _spread(seeds.select("node", F.col("mark").alias("colour")), inner, "dst", "src", keep)
    found = keep(back.where("colour = 1").select("node").join(colour, "node").select("node", F.col("colour").alias("label")))
    rest = inner
    for end in ("src", "dst"):
        rest = rest.join(found.select(F.col("node").alias(end)), end, "left_anti")
    return found, keep(rest.select("src", "dst"))


def _of_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # every node gets a way on: those without one stay where they are
    on = nodes.join(edges.withColumnRenamed("src", "node"), "node", "left").select(F.lit(0).alias("g"), F.col("node").alias("src"), F.coalesce("dst", "node").alias("dst"))
    found = functional_cycles(on, ["g"]).select("node", F.col("cycle").alias("component"), F.col("length").alias("size"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))


def _spread(start: DataFrame, edges: DataFrame, frm: str, to: str, keep) -> DataFrame:
    """Each node takes the largest colour that reaches it along edges."""
    now = keep(start)
    while True:
        sent = edges.join(now.withColumnRenamed("node", frm), frm).groupBy(F.col(to).alias("node")).agg(F.max("colour").alias("new"))
        moved = keep(now.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("next"), "colour"))
        now = moved.select("node", F.col("next").alias("colour"))
        if moved.where("next <> colour").isEmpty():
            return now
