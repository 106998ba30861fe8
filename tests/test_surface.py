"""Reports, command line and streaming forms."""

import json

from pyspark.sql import functions as F

from quern import cli, report
from quern.plans.engine import Engine
from quern.rules import RULES
from quern.rules.base import Rule
from quern.sources import artifacts
from quern.streaming.bursts import bursts

HISTO = "   1:       2000000      200000000  [B (java.base@17)\n   2:          9000         480000  app.Row\n   3:   1   16  app.X\nTotal       2009001      200480016\n"


def test_report(spark):
    a = Engine([r for r in RULES if r.id == "HIS001"]).analyze(artifacts.from_texts(spark, [("s", "heap.histo", HISTO)]))
    made = report.gathered(a, "s")
    assert json.loads(report.to_json(made))["findings"][0]["rule_id"] == "HIS001"
    text = report.to_markdown(made)
    assert "H-HEAP-SHAPE" in text and "heap.histo:1" in text and "HIS001: 1 finding" in text
    assert "| heap.histo | HEAP_HISTO |" in text and "## Appendix" in text and "HIS001" in report.narrative(made)
    assert "no rule fired" in report.narrative(made | {"findings": [], "hypotheses": []})


def test_failing_rule_costs_no_other(spark):
    def broken(tables, thresholds):
        raise ValueError("broken")

    rules = [Rule("HIS999", "Broken", "HEAP_HISTO", "-", broken), Rule("HIS998", "Late", "HEAP_HISTO", "-", lambda t, c: t.histo_rows.select(F.raise_error(F.lit("late")).alias("snapshot_id"))), *[r for r in RULES if r.id == "HIS001"]]
    a = Engine(rules).analyze(artifacts.from_texts(spark, [("s", "heap.histo", HISTO)]))
    assert {r.rule_id: r.status for r in a.status.collect()} == {"HIS998": "error", "HIS999": "error", "HIS001": "1 finding"}
    assert sorted(a.errors) == ["HIS998", "HIS999"] and "broken" in a.errors["HIS999"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/heap.histo").write_text(HISTO)
    assert cli.main(["analyze", str(tmp_path / "in"), "-f", "both", "-o", str(tmp_path / "out"), "--fail-on", "high"], spark) == 1
    assert json.loads((tmp_path / "out/report.json").read_text())["files"] == {"heap.histo": "HEAP_HISTO"} and (tmp_path / "out/report.md").exists()
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.bin").write_text("nothing")
    assert cli.main(["analyze", str(tmp_path / "none")], spark) == 2
    capsys.readouterr()
    assert cli.main(["explain", "gca003"]) == 0 and "H-HEAP-LEAK" in capsys.readouterr().out
    assert cli.main(["explain", "nope"]) == 2 and cli.main(["doctor"]) == 0
    capsys.readouterr()
    assert cli.main(["rules", "-f", "json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 19


def test_rule_catalogue(capsys):
    assert cli.main(["rules"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 19 and all(r.limits for r in RULES)


def test_every_threshold_has_a_flag():
    args = cli.parser().parse_args(["analyze", "x", "--sla-ms", "5", "--mat-share", "0.2"])
    assert args.sla_ms == 5 and args.mat_share == 0.2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = bursts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "key", "ts", least=2)
    q = stream.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("found").collect()) == sorted(bursts(rows, "key", "ts", least=2).collect())
