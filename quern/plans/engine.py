"""The whole analysis over any number of snapshots: tables written once, then a plan a rule."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Thresholds
from ..rules import FINDING, RULES, Rule, Tables
from ..operators.ranges import LENGTH
from ..sources import artifacts
from ..sources.ranged import read_lines
from ..sources.workspace import Workspace
from . import correlate, exceptions, gc, histograms, threads


@dataclass
class Analysis:
    tables: Tables
    kinds: DataFrame
    skipped: DataFrame
    findings: DataFrame
    hypotheses: DataFrame
    timeline: DataFrame
    status: DataFrame
    thresholds: Thresholds
    errors: dict[str, str] = field(default_factory=dict)

    def gate(self, severity: str) -> DataFrame:
        """(snapshot_id, failed): whether some finding is at least that severe."""
        from ..functions.fixed import SEVERITIES

        bad = F.count_if(correlate.rank_of("severity") <= SEVERITIES.index(severity)) > 0
        return self.findings.groupBy("snapshot_id").agg(bad.alias("failed"))


def tables_of(lines: DataFrame, kept: DataFrame, range_rows: int | None = None) -> Tables:
    """Parse each artifact by its kind. range_rows: lines that a task numbers, where some file has more of them."""
    of = lambda kind: lines.join(kept.where(F.col("kind") == kind).select("snapshot_id", "file"), ["snapshot_id", "file"], "left_semi")
    dumps, thread_rows = threads.parse(of(artifacts.THREAD_DUMP), range_rows)
    logs, events = gc.parse(of(artifacts.GC_LOG), range_rows)
    histos, rows = histograms.parse(of(artifacts.HEAP_HISTO))
    return Tables(lines, dumps, thread_rows, logs, events, histos, rows, exceptions.parse(of(artifacts.APP_LOG), range_rows))


#: Tables that each kind of artifact is parsed into.
TABLES_OF = {
    artifacts.THREAD_DUMP: ["dumps", "threads"],
    artifacts.GC_LOG: ["gc_logs", "gc_events"],
    artifacts.HEAP_HISTO: ["histos", "histo_rows"],
    artifacts.APP_LOG: ["exceptions"],
}


class Engine:
    """Rules applied to parsed tables. Pass other rules to extend or narrow it."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = RULES if rules is None else rules

    def findings(self, tables: Tables, thresholds: Thresholds) -> DataFrame:
        spark = tables.lines.sparkSession
        out = spark.createDataFrame([], FINDING)
        for rule in self.rules:
            out = out.unionByName(rule.evaluate(tables, thresholds))
        return out

    def _written(self, tables: Tables, present: set[str], space: Workspace) -> dict[str, str]:
        """Write what was parsed; of a kind that is absent, or whose parser fails, the tables are empty. Returns errors by table."""
        errors: dict[str, str] = {}

        def write(kind: str, name: str) -> DataFrame:
            df = getattr(tables, name)
            if kind in present:
                try:
                    return space.written(df, name)
                except Exception as e:
                    errors[name] = f"the parser of {name} failed: {type(e).__name__}"
            return space.spark.createDataFrame([], df.schema)

        with ThreadPoolExecutor(max_workers=8) as pool:
            made = {name: pool.submit(write, kind, name) for kind, names in TABLES_OF.items() for name in names}
        for name, df in made.items():
            setattr(tables, name, df.result())
        return errors

    def isolated(self, tables: Tables, thresholds: Thresholds, space: Workspace, present: set[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
        """Findings, (snapshot_id, rule_id, why) of what was declined, and errors by rule: a rule that fails costs no other's findings."""
        spark = tables.lines.sparkSession
        errors: dict[str, str] = {}

        def kept(name: str, rule: Rule, make: Callable[[], DataFrame]) -> DataFrame | None:
            try:
                return space.written(make(), f"{name}-{rule.id}")
            except Exception as e:
                errors[rule.id] = f"{rule.id} failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
                return None

        def run(rule: Rule) -> tuple[DataFrame | None, DataFrame | None]:
            found = kept("findings", rule, lambda: rule.evaluate(tables, thresholds))
            why = kept("declined", rule, lambda: rule.declined(tables, thresholds).withColumn("rule_id", F.lit(rule.id))) if found is not None and rule.declined else None
            return found, why

        with ThreadPoolExecutor(max_workers=8) as pool:  # small jobs that wait for one another would leave the cluster idle
            made = list(pool.map(run, [r for r in self.rules if r.artifact in present]))
        findings = reduce(DataFrame.unionByName, [f for f, _ in made if f is not None], spark.createDataFrame([], FINDING))
        declined = reduce(DataFrame.unionByName, [w for _, w in made if w is not None], spark.createDataFrame([], "snapshot_id string, why string, rule_id string"))
        return findings, declined, errors

    def declined(self, tables: Tables, thresholds: Thresholds) -> DataFrame:
        out = tables.lines.sparkSession.createDataFrame([], "snapshot_id string, why string, rule_id string")
        for rule in self.rules:
            if rule.declined:
                out = out.unionByName(rule.declined(tables, thresholds).withColumn("rule_id", F.lit(rule.id)))
        return out

    def analyze(self, files: DataFrame, thresholds: Thresholds | None = None, multi_log: bool = False) -> Analysis:
        """Findings, hypotheses, timeline and rule status of every snapshot in files (see ``sources.artifacts``).

        Lines, parsed tables and findings are written to the shared folder: several rules read each.
        """
        space = Workspace(files.sparkSession)
        lines = space.written(artifacts.lines_of(files), "lines")
        return self.analyze_lines(lines, files.select("snapshot_id").distinct(), space, thresholds, multi_log)

    def analyze_lines(self, lines: DataFrame, snapshots: DataFrame, space: Workspace, thresholds: Thresholds | None = None, multi_log: bool = False) -> Analysis:
        """The same of written lines; where a file is longer than a range, many tasks number its lines."""
        thresholds = thresholds or Thresholds()
        longest = lines.agg(F.max("line_no")).first()[0] or 0
        kinds = space.written(artifacts.sniff(lines), "kinds")
        kept, skipped = artifacts.first_of_kind(kinds, multi_log)
        tables = tables_of(lines, kept, LENGTH if longest > LENGTH else None)
        present = {r["kind"] for r in kept.select("kind").distinct().collect()}  # five at most
        errors = self._written(tables, present, space)
        found, declined, failed = self.isolated(tables, thresholds, space, present)
        errors |= failed
        merged = space.written(correlate.quoted(space.written(correlate.dedupe(found), "merged"), lines), "quoted")
        status = correlate.rule_status(snapshots, kept, merged, declined, self.rules, sorted(failed))
        return Analysis(tables, kinds, skipped, merged, correlate.hypotheses(merged), correlate.timeline(tables, thresholds), status, thresholds, errors)


def analyze_folder(spark: SparkSession, root: str, thresholds: Thresholds | None = None, snapshot_depth: int = 0) -> Analysis:
    """Analysis of the files under a root, of any number and size."""
    space = Workspace(spark)
    lines = space.written(read_lines(spark, root, space, snapshot_depth)[0], "lines")
    return Engine().analyze_lines(lines, lines.select("snapshot_id").distinct(), space, thresholds)
