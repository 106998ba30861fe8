"""The sweep over starts and ends against counting, ties and hot keys included; bounded evidence in its plan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators.series import densest_window
from quern.rules.base import first_few


@pytest.mark.parametrize("range_span", [None, 40, 5000])
def test_densest_window(spark, range_span):
    rng = random.Random(4)
    rows = [(k, rng.choice([-7, 0, 3, rng.randrange(-50, 900)]), n) for k in range(4) for n in range(80)] + [(9, None, 0), (9, 5, 1), (10, None, 1)]
    got = {r.k: (r.start_ms, r.n) for r in densest_window(spark.createDataFrame(rows, "k int, at long, seq int"), ["k"], "at", "seq", 30, range_span).collect()}
    wanted = {}
    for k in range(10):
        at = sorted(a for j, a, _ in rows if j == k and a is not None)
        if at:
            n, first = max((sum(a <= b <= a + 30 for b in at), -a) for a in at)
            wanted[k] = (-first, n)
    assert got == wanted


def test_one_hot_key(spark):
    """A million rows of one key, all within one window's reach of thousands of others."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 1_000_003).alias("at"), F.col("id").alias("seq"))
    began = time.time()
    assert densest_window(df, ["k"], "at", "seq", 300_000, 100_000).first().n in (300_000, 300_001)
    assert time.time() - began < 60


def test_evidence_is_cut_before_it_is_gathered(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("o"), F.col("id").cast("string").alias("e")).repartition(4)
    shown = first_few(df, ["k"], [F.col("o")], F.col("e"), 6)
    assert {r.k: r.evidence for r in shown.collect()} == {k: [str(9999 - (9999 - k) % 3 - 3 * j) for j in range(6)] for k in range(3)}
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") >= 0 and plan.count("WindowGroupLimit") == 2  # one before the shuffle, one after


def test_quotes_filter_lines_before_the_shuffle(spark):
    """Few places are sent to the readers of lines; many are joined by place; the quotes are the same."""
    from quern.plans.correlate import quoted
    from quern.rules.base import EVIDENCE, FINDING

    lines = spark.range(1, 500).select(F.lit("s").alias("snapshot_id"), F.lit("a.log").alias("file"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    found = spark.range(3).select(
        F.lit("s").alias("snapshot_id"), F.lit("R1").alias("rule_id"), F.lit("t").alias("title"), F.lit("LOW").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("APP_LOG").alias("artifact"), F.lit(None).cast("string").alias("variant"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("summary"),
        F.array().cast("array<string>").alias("recommendations"), F.array(*[F.struct(F.lit("a.log").alias("file"), (F.col("id") * 7 + k).cast("int").alias("start_line"), F.lit(9).alias("end_line"), F.lit(None).cast("string").alias("quote"), F.lit("n").alias("note")) for k in (3, 600)]).cast(f"array<{EVIDENCE}>").alias("evidence"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metrics"), F.lit(0).alias("first_line"),
    )
    assert [f.split()[0] for f in FINDING.split(", ")][0] == "snapshot_id"
    few, many = quoted(found, lines), quoted(found, lines, few=0)
    rows = lambda df: sorted((r.summary, [(e.start_line, e.quote) for e in r.evidence]) for r in df.collect())
    assert rows(few) == rows(many) == [(f"n{k}", [(7 * k + 3, f"line {7 * k + 3}"), (7 * k + 600, None)]) for k in range(3)]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftSemi" not in many._jdf.queryExecution().optimizedPlan().toString()
