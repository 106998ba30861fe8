"""analyze: report on snapshots; rules, explain: the catalogue; doctor: what this machine has. Exit code 0, 1 if a finding is at the gate, 2 if nothing was recognised."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Thresholds
from .functions.fixed import SEVERITIES
from .plans.engine import Engine
from .report import explained, gathered, rules_json, to_json, to_markdown
from .rules import RULES
from .sources import artifacts
from .sources.ranged import read_lines
from .sources.workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("-f", "--format", choices=["md", "json", "both"], default="md")
    a.add_argument("--fail-on", choices=[s.lower() for s in SEVERITIES], default="high")
    for f in fields(Thresholds):
        if f.name != "compat_bag":
            a.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=type(f.default))
    a.add_argument("-o", "--output", help="a folder: report.md and report.json are written there instead of printed")
    listed = sub.add_parser("rules")
    listed.add_argument("-f", "--format", choices=["text", "json"], default="text")
    sub.add_parser("explain").add_argument("rule")
    sub.add_parser("doctor")
    return p


def doctor() -> list[str]:
    """Versions, and the capture tools that are on the path."""
    import pyspark

    found = [f"{tool}: {shutil.which(tool) or 'not found; files captured elsewhere can still be analysed'}" for tool in ("java", "jstack", "jmap", "jcmd")]
    return [f"python: {sys.version.split()[0]}", f"pyspark: {pyspark.__version__}", *found, f"rules: {len(RULES)}", f"severities: {', '.join(SEVERITIES)}"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "rules":
        print(rules_json() if args.format == "json" else "\n".join(f"{r.id}  {r.title}  [{r.artifact}]  {r.limits}" for r in RULES))
        return 0
    if args.command == "explain":
        text = explained(args.rule)
        print(text or f"no rule is named {args.rule}", file=sys.stdout if text else sys.stderr)
        return 0 if text else 2
    if args.command == "doctor":
        print("\n".join(doctor()))
        return 0
    spark = spark or SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    given = {f.name: getattr(args, f.name) for f in fields(Thresholds) if getattr(args, f.name, None) is not None}
    # several paths are one snapshot; the first log of the first path wins
    space = Workspace(spark)
    parts = [read_lines(spark, path, space.inner(f"path-{k}"))[0].withColumn("snapshot_id", F.lit("snapshot")) for k, path in enumerate(args.paths)]
    lines = space.written(artifacts.merged(parts), "lines")
    analysis = Engine().analyze_lines(lines, lines.select("snapshot_id").distinct(), space, Thresholds().override(**given))
    if analysis.kinds.where(F.col("kind") != artifacts.UNKNOWN).isEmpty():
        print("no artifact was recognised", file=sys.stderr)
        return 2
    report = gathered(analysis, "snapshot")
    made = {kind: make(report) for kind, make in (("md", to_markdown), ("json", to_json)) if args.format in (kind, "both")}
    for kind, text in made.items():
        if args.output:
            os.makedirs(args.output, exist_ok=True)
            with open(os.path.join(args.output, f"report.{kind}"), "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    gate = SEVERITIES.index(args.fail_on.upper())
    return int(any(SEVERITIES.index(f["severity"]) <= gate for f in report["findings"]))


if __name__ == "__main__":
    sys.exit(main())
