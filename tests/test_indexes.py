import datetime
import glob
import os

import duckdb
import pytest

from tidelog.operators import indexes
from tidelog.plans import queries

PROPS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("rows", [[(1, 7.0, 7)], [(1, 0.5, 7)], [(1, 3.0, 3)], [(1, 7.0, None)], []])
def test_index_exists_is_its_sql(spark, tmp_path, rows):
    """The inner v of the SQL is visible's: what is asked is whether a row's k is its own v."""
    day = datetime.datetime(2024, 1, 1)
    events = [(n, day, user, "signup", v, "{}" if k is None else f'{{"k": {k}}}') for n, (user, v, k) in enumerate(rows)]
    spark.createDataFrame(events, PROPS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{glob.glob(os.path.join(tmp_path, 'events.parquet', '*.parquet'))[0]}'")
    want = db.execute(queries.ORACLES["index_exists"]).fetchall()
    assert sorted(map(tuple, queries.index_exists(spark, str(tmp_path)).collect())) == sorted(want)


def test_exists_by_value(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "row_id long, k long")
    indexes.write(indexes.entries(rows, "k"), f"{tmp_path}/index")
    index = indexes.read(spark, f"{tmp_path}/index")
    assert [indexes.exists(index, v) for v in (7, "9", None, 8, 12345678)] == [True, True, True, False, False]
