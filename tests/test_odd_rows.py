"""Queries against their SQL on tables with odd values: zeros, nulls, infinities, many rows of a kind."""

import math

import duckdb
import pytest

from quern import artifact_queries, function_queries  # noqa: F401  both register their queries
from quern.queries import ORACLE_SQL, QUERIES


def plain(v):
    return None if v is None else str(v) if isinstance(v, (str, bool)) else "nan" if math.isnan(v) else f"{float(v):.6f}"


def matches(spark, name, folder, **tables):
    """tables: SELECTs that make them. Gives the rows, having compared them with those of the SQL."""
    duck = duckdb.connect()
    for t, sql in tables.items():
        duck.execute(f"copy ({sql}) to '{folder}/{t}.parquet'")
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    rows = df.collect()
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    wanted = sorted([tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall()], key=str)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=str) == wanted
    return rows


# users whose values begin, end or stand at zero, of either sign, below zero, at infinity, null or NaN; some places are unknown
ODD_EVENTS = """SELECT k::BIGINT AS event_id, CASE WHEN k % 7 < 6 THEN TIMESTAMP '2024-01-01' + to_seconds(k // 3) END AS ts, u::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{"k": 1}' AS props FROM (VALUES
    (1, 1, '0'), (2, 1, '5'), (3, 1, '0'), (4, 1, '0'), (5, 1, '-1'), (6, 1, '0'), (7, 2, '3'), (8, 2, '0'), (9, 2, '4'), (10, 3, '-0.0'), (11, 3, '2'), (12, 4, '0'), (13, 4, '0'), (14, 5, '-4'), (15, 5, '-2'), (16, 5, '8'),
    (17, 6, NULL), (18, 6, '2'), (20, 6, '3'), (21, 6, NULL), (22, 7, 'inf'), (23, 7, '1'), (24, 7, 'inf'), (25, 8, NULL), (26, 9, '7'), (27, 9, '9'), (28, NULL, '0'), (29, NULL, '6'), (30, 10, '0'), (31, 10, '-3'), (32, 2, '1'), (34, 2, '6'), (35, 11, '0'), (36, 11, 'nan')) t(k, u, v)"""


def test_pinned_stagnant_over_zero(spark, tmp_path):
    rows = {r.user_id: r for r in matches(spark, "pinned_stagnant", tmp_path, events=ODD_EVENTS)}
    assert rows[2].stagnant == 2 and rows[4].stagnant == 0  # what rises from zero frees nothing; zero of zero tells nothing


def test_live_set_series_from_zero(spark, tmp_path):
    rows = {r.user_id: r for r in matches(spark, "live_set_series", tmp_path, events=ODD_EVENTS)}
    assert math.isnan(rows[1].rise) and rows[3].rise == -math.inf and rows[5].rise == -3 and rows[6].first == 2 and rows[8].rise is None


def test_all_oversized_families(spark, tmp_path):
    """Five families of a capture are too large, one of them by its last thread; another lacks one."""
    customers = """SELECT row_number() OVER () - 1 AS c_custkey, 'S' || s AS c_mktsegment, n::INTEGER AS c_nationkey FROM range(2) a(s), (VALUES (1, 25), (3, 16), (7, 45), (8, 40), (9, 39), (11, 50), (12, 300)) f(n, k), range(k) r"""
    rows = matches(spark, "rule_tda003_oversized", tmp_path, customer=customers)
    assert sorted((r.family, r.threads) for r in rows if r.snapshot_id == "S1") == [("crew", 41), ("desk11", 50), ("desk12", 300), ("desk7", 45), ("desk8", 40)]
