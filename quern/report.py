"""JSON and Markdown reports of one snapshot. Only its findings and what was made of them, a few dozen rows, reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import fixed
from .plans import correlate
from .plans.engine import Analysis
from .rules import RULES

SCHEMA_TAG = "quern.report/1"
MOST_HYPOTHESES, MOST_ENTRIES = 6, 40


def percent(share) -> F.Column:
    return F.format_string("%.1f%%", share * 100)


def collapsed(text) -> F.Column:
    """Text as one cell of a table: bars escaped, white space collapsed, 160 characters at most."""
    return F.left(F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "[ \\t\\n\\r\\f\\x0B]+", " ")), F.lit(160))


def _plain(value):
    """Rows as dicts without nulls, doubles with three digits."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return round(value, 3) if isinstance(value, float) else value


def gathered(a: Analysis, snapshot_id: str) -> dict:
    of = lambda df: df.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    entries = of(a.timeline).orderBy("sort_key", F.coalesce("line_no", F.lit(0))).drop("sort_key").collect()
    axis = of(correlate.single_axis(a.timeline, a.tables.gc_logs)).first()
    return {
        "schema": SCHEMA_TAG,
        "snapshot": snapshot_id,
        "files": {r["file"]: r["kind"] for r in of(a.kinds).orderBy("ord", "file").collect()},
        "findings": _plain(of(correlate.ordered(a.findings)).collect()),
        "hypotheses": _plain(of(a.hypotheses).orderBy("place").collect()),
        "timeline": _plain(entries),
        "singleAxis": bool(axis["single_axis"]) if axis else True,
        "ruleStatus": {r["rule_id"]: r["status"] for r in of(a.status).orderBy("rule_id").collect()},
        "errors": [a.errors[k] for k in sorted(a.errors)],
        "skipped": _plain(of(a.skipped).collect()),
        "thresholds": a.thresholds.as_map(),
    }


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def rules_json() -> str:
    """The catalogue of rules."""
    return json.dumps([{"id": r.id, "title": r.title, "artifact": r.artifact, "limits": r.limits} for r in sorted(RULES, key=lambda r: r.id)], indent=2)


def explained(rule_id: str) -> str | None:
    """What one rule looks at and where it can't tell; None if there is no such rule."""
    rule = next((r for r in RULES if r.id == rule_id.upper()), None)
    if rule is None:
        return None
    doc = " ".join((rule.evaluate.__doc__ or "").split())
    supports = [h for h, _, rules, _, _ in fixed.HYPOTHESES if rule.id in rules]
    return "\n".join(x for x in [f"{rule.id}: {rule.title} [{rule.artifact}]", doc, f"Limits: {rule.limits}", f"Speaks for: {', '.join(supports)}"] if x)


def narrative(report: dict) -> str:
    """A few sentences made from findings alone; it adds nothing that no rule found and changes none of them."""
    if not report["hypotheses"]:
        quiet = "no rule fired" if not report["findings"] else f"{len(report['findings'])} findings, none of which speaks for a cause"
        return f"In {report['snapshot']} {quiet}. What isn't in these files (heap contents, profiles) was not looked at."
    best = report["hypotheses"][0]
    grave = [f for f in report["findings"] if f["severity"] in ("CRITICAL", "HIGH")]
    said = [f"Best supported: {best['claim']}"]
    if grave:
        said.append("Gravest: " + "; ".join(f"{f['summary']} ({f['rule_id']})" for f in grave[:4]) + ".")
    if len(report["hypotheses"]) > 1:
        said.append("Also possible: " + ", ".join(h["hypothesis"] for h in report["hypotheses"][1:4]) + ".")
    steps = best["actions"][:3]
    said.append("Next: " + " ".join(f"{k}. {step}" for k, step in enumerate(steps, 1)) if steps else "Next: capture again, twice, a minute apart.")
    return "\n\n".join(said)


def _cell(text) -> str:
    return " ".join(str(text).replace("|", "\\|").split())[:160]


def _place(e: dict) -> str:
    return f"{e['file']}:{e.get('start_line') or e.get('line_no') or 1}"


def to_markdown(report: dict) -> str:
    findings, hypotheses, status = report["findings"], report["hypotheses"], report["ruleStatus"]
    out = [f"# Incident report: {report['snapshot']}", "", f"{len(report['files'])} files, {len(status)} rules, pause objective {report['thresholds']['sla-ms']} ms", ""]
    out += ["## Verdict", "", narrative(report), ""]
    if hypotheses:
        out += ["## Hypotheses", "", "| hypothesis | severity | score | rules |", "|---|---|---|---|"]
        out += [f"| {h['hypothesis']} | {h['severity']} | {h['score']} | {', '.join(h['rules'])} |" for h in hypotheses[:MOST_HYPOTHESES]] + [""]
        out += [f"- {action}" for action in hypotheses[0]["actions"]] + [""]
    if findings:
        out += ["## Findings", "", "| rule | severity | confidence | what | where |", "|---|---|---|---|---|"]
        out += [f"| {f['rule_id']} | {f['severity']} | {f['confidence']} | {_cell(f['summary'])} | {_place(f['evidence'][0]) if f['evidence'] else ''} |" for f in findings] + [""]
    if report["timeline"]:
        out += ["## Timeline", ""] + ([] if report["singleAxis"] else ["Uptimes and wall-clock times can't be put on one axis here.", ""])
        out += [f"- {'**' if e['major'] else ''}{_cell(e['label'])}{'**' if e['major'] else ''} ({_place(e)})" for e in report["timeline"][:MOST_ENTRIES]]
        out += [f"- and {len(report['timeline']) - MOST_ENTRIES} more"] * (len(report["timeline"]) > MOST_ENTRIES) + [""]
    if findings:
        out += ["## Detail", ""]
        for f in findings:
            out += [f"### {f['rule_id']} {f['title']}", "", _cell(f["summary"]), ""]
            out += [f"- {_place(e)}" + (f" `{_cell(e['quote'])}`" if e.get("quote") else "") + (f" ({_cell(e['note'])})" if e.get("note") else "") for e in f["evidence"]]
            out += [f"- {k}: {v}" for k, v in sorted(f["metrics"].items())] + [""]
    out += ["## Coverage", "", "| file | read as |", "|---|---|"] + [f"| {_cell(file)} | {kind} |" for file, kind in report["files"].items()] + [""]
    out += [f"- {rule}: {said}" for rule, said in status.items()] + [""]
    out += [f"- {_cell(s['advice'])}" for s in report["skipped"]] + [f"- {_cell(e)}" for e in report["errors"]]
    out += ["", "## Appendix", "", "Thresholds: " + ", ".join(f"{k} {v}" for k, v in report["thresholds"].items())]
    return "\n".join(out) + "\n"
