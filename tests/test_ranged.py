"""Lines read by byte ranges against lines of whole files, however files are cut."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.plans.engine import analyze_folder
from quern.sources import artifacts
from quern.sources.ranged import read_lines
from quern.sources.workspace import Workspace
from tests.test_engine import DEADLOCK, stack


def rows_of(df):
    return sorted(map(str, df.select("snapshot_id", "file", "ord", "line_no", "text").collect()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("ranged dir+x"), random.Random(1)
    (root / "a/b").mkdir(parents=True)
    mixed = b"".join(bytes(f"line {k} " + "x" * rng.randrange(40), "utf8") + rng.choice([b"\n", b"\r\n", b"\r", b"\n\n", b"\r\r\n"]) for k in range(400))
    files = {
        "mixed.log": mixed, "bom.txt": b"\xef\xbb\xbffirst\nsecond", "empty.log": b"", "blank.log": b"\n\r\n\n", "tail.log": b"one\n\n \n\n\r\n", "a/gbk.log": "中文 日志\n第二行 é".replace("é", "").encode("gbk") + b"\nascii\n" * 30,
        "a/latin.log": "caf\xe9 \xff\n".encode("latin-1") * 20, "a/b/esc%20 name.log": b"\x1b[31mred\x1b[0m\nplain\n", "late.log": b"ascii\n" * 200 + "é".encode("latin-1") + b"\nmore\n", "report.md": b"no", "x.gz": b"not gzip", ".hidden": b"no",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return str(root)


@pytest.mark.parametrize("cut", [211, 4093])
def test_lines_as_of_whole_files(spark, folder, cut):
    wanted = rows_of(artifacts.lines_of(artifacts.scan(spark, folder)[0]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        lines, left_out = read_lines(spark, folder, Workspace(spark))
        assert rows_of(lines) == wanted and left_out.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bound_and_depth(spark, folder):
    lines, left_out = read_lines(spark, folder, Workspace(spark), most_bytes=1000)
    assert [(r.file, r.reason) for r in left_out.collect()] == [("mixed.log", "larger than 1000 bytes"), ("late.log", "larger than 1000 bytes")][: left_out.count()]
    assert lines.where("file = 'mixed.log'").count() == 0 and lines.where("file = 'tail.log'").count() == 3
    deep = read_lines(spark, folder, Workspace(spark), snapshot_depth=1)[0].where("snapshot_id = 'a'")
    assert rows_of(deep) == rows_of(artifacts.lines_of(artifacts.scan(spark, folder, 1)[0]).where("snapshot_id = 'a'"))


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    """One log of 60 MB: many splits, every number right."""
    text = "".join(f"{k} " + "y" * 50 + "\n" for k in range(100_000))
    with open(tmp_path / "app.log", "w") as f:
        for _ in range(10):
            f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        lines = read_lines(spark, str(tmp_path), Workspace(spark))[0]
        assert lines.rdd.getNumPartitions() >= 8
        wrong = lines.where((F.col("line_no") - 1) % 100_000 != F.substring_index("text", " ", 1).try_cast("int"))
        assert lines.count() == 1_000_000 and wrong.count() == 0 and lines.agg(F.max("line_no")).first()[0] == 1_000_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_analysis_of_cut_files(spark, tmp_path, monkeypatch):
    """The engine gives the same findings where ranges are far shorter than its files."""
    from quern.plans import engine

    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.jstack").write_text(DEADLOCK)
    (tmp_path / "s/app.log").write_text("".join(stack(k) for k in range(12)))
    fields = ["snapshot_id", "rule_id", "summary", "evidence", "first_line"]
    whole = sorted(map(str, analyze_folder(spark, str(tmp_path / "s")).findings.select(*fields).collect()))
    monkeypatch.setattr(engine, "LENGTH", 9)
    began = time.time()
    cut = sorted(map(str, analyze_folder(spark, str(tmp_path / "s")).findings.select(*fields).collect()))
    assert whole and whole == cut and time.time() > began
