"""Every query of the engine against its SQL twin in DuckDB."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from quern import artifact_queries, function_queries  # noqa: F401  both register their queries
from quern.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark):
    """All queries, several at a time: each waits for many small jobs."""

    def run(name):
        df = QUERIES[name](spark, SF)
        return sorted(df.columns), df.collect()

    with ThreadPoolExecutor(max_workers=6) as pool:
        yield {name: pool.submit(run, name) for name in sorted(QUERIES)}


def plain(v):
    return None if v is None else str(v) if isinstance(v, (str, bool)) else f"{float(v):.6f}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(results, duck, name):
    columns, rows = results[name].result()
    found = sorted([tuple(plain(r[c]) for c in columns) for r in rows], key=str)
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    wanted = sorted([tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall()], key=str)
    assert sorted(names) == columns
    assert found == wanted
