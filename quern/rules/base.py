"""What all rules share: their input tables, the shape of a finding, and of a rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..operators.series import top_k

EVIDENCE = "struct<file:string,start_line:int,end_line:int,quote:string,note:string>"
FINDING = (
    "snapshot_id string, rule_id string, title string, severity string, confidence double, artifact string, variant string, summary string, "
    f"recommendations array<string>, evidence array<{EVIDENCE}>, metrics map<string,string>, first_line int"
)


@dataclass
class Tables:
    """Parsed tables of any number of snapshots."""

    lines: DataFrame
    dumps: DataFrame
    threads: DataFrame
    gc_logs: DataFrame
    gc_events: DataFrame
    histos: DataFrame
    histo_rows: DataFrame
    exceptions: DataFrame


@dataclass(frozen=True)
class Rule:
    """evaluate gives findings; declined gives (snapshot_id, why) where the data can't tell."""

    id: str
    title: str
    artifact: str
    limits: str
    evaluate: Callable[[Tables, Thresholds], DataFrame]
    declined: Callable[[Tables, Thresholds], DataFrame] | None = None


def rule_of(rule_id: str, rules: list[Rule]) -> Rule:
    return next(r for r in rules if r.id == rule_id)


def span(file: Column | str, start: Column | str, end: Column | str | None = None, note: Column | str | None = None) -> Column:
    """A piece of evidence; its quote is filled in from the lines later."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(
        of(file).alias("file"),
        of(start).cast("int").alias("start_line"),
        of(start if end is None else end).cast("int").alias("end_line"),
        F.lit(None).cast("string").alias("quote"),
        (F.lit(None) if note is None else of(note)).cast("string").alias("note"),
    )


def ordered(*parts: Column) -> Column:
    """Aggregate: evidence in the order of the parts before the last, which is the evidence itself."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))), lambda x: x[f"k{len(parts) - 1}"])


def first_few(rows: DataFrame, keys: list[str], order: list[Column], evidence: Column, most: int, name: str = "evidence") -> DataFrame:
    """(keys, evidence): that of the first rows of each key. Each task keeps so many of a key before any is gathered, so no group grows with its rows."""
    places = [f"_o{k}" for k in range(len(order))]
    first = top_k(rows.select(*keys, *[o.alias(p) for o, p in zip(order, places, strict=True)], evidence.alias("_e")), keys, [F.col(p) for p in places], most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_e"))), lambda x: x["_e"]).alias(name))


def with_evidence(rows: DataFrame, shown: DataFrame, keys: list[str], name: str = "evidence") -> DataFrame:
    """rows with evidence of their keys, an empty array where there is none; keys that are null are keys."""
    other = shown.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(name).alias(f"_{name}"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    met = rows.join(other, same, "left")
    return met.withColumn(name, F.coalesce(f"_{name}", F.array().cast(f"array<{EVIDENCE}>"))).drop(*[f"_of_{k}" for k in keys], f"_{name}")


def findings(rows: DataFrame, rule: str, title: str, artifact: str, severity: Column, confidence: Column, summary: Column, evidence: Column, metrics: dict[str, Column], advice: list[str], variant: str | None = None) -> DataFrame:
    values = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        "snapshot_id",
        F.lit(rule).alias("rule_id"),
        F.lit(title).alias("title"),
        severity.alias("severity"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).cast("double").alias("confidence"),
        F.lit(artifact).alias("artifact"),
        F.lit(variant).cast("string").alias("variant"),
        summary.alias("summary"),
        F.array(*map(F.lit, advice)).alias("recommendations"),
        evidence.cast(f"array<{EVIDENCE}>").alias("evidence"),
        F.create_map(*values).cast("map<string,string>").alias("metrics"),
        F.coalesce(F.get(evidence, 0)["start_line"], F.lit(0)).cast("int").alias("first_line"),
    )
