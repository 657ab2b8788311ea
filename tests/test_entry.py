import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rounded = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(rounded, found.fetchall())) == sorted(map(rounded, df.select([f"`{c}`" for c in names]).collect()))
