"""Every query with SQL against DuckDB on the same tables, and every other one for rows and columns."""

import math
import pathlib

import duckdb
import pytest

from strandloom.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries without SQL whose whole results other tests hold against plain Python, or walk through.
TESTED_ELSEWHERE = {"evidence_repairs", "editorial_changes", "mapping_reasons", "variant_families", "spacing_repairs", "segmentation_contract"}

pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return float(v) if type(v).__name__ == "Decimal" else v


def sorted_rows(columns, rows):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([plain(r[i]) for i in by]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    told = duck.sql(catalogue.ORACLES[name])
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - TESTED_ELSEWHERE))
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    again = catalogue.QUERIES[name](spark, SF_DIR)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, again.collect()))
