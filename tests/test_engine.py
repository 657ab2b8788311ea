import pytest
from pyspark.sql import functions as F

from tidelog.operators import relational, replay
from tidelog.operators.evolution import AddColumn
from tidelog.plans.engine import ConstraintError, Engine
from tidelog.plans.statements import ColumnDef
from tidelog.sources.cdc import user_events
from tidelog.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), snapshot_interval=0)
    e.execute("CREATE TABLE users (id INT PRIMARY KEY, email TEXT UNIQUE, age INT)")
    e.insert_many("users", [{"id": 1, "email": "a", "age": 30}, {"id": 2, "email": "b", "age": 25}, {"id": 3, "email": "c", "age": 25}])
    return e


def test_flow(engine):
    assert engine.execute("UPDATE users SET age = 31 WHERE id = 1") == "Updated 1 row(s)"
    assert engine.execute("UPDATE users SET age = 26 WHERE age = 25") == "Updated 2 row(s)"
    assert engine.execute("DELETE FROM users WHERE id = 2") == "Deleted 1 row(s)"
    assert engine.execute("SELECT * FROM users WHERE id = '1'") == "map[age:31 email:a id:1]"
    assert engine.execute("SELECT * FROM users WHERE nope = 1") == "No rows returned"
    assert engine.row("users", 2).age == 26.0 and engine.row("users", 1) is None
    again = Engine(engine.spark, engine.path)
    assert again.tables() == ["users"] and again.insert("users", {"id": 9, "email": "z", "age": 1}) == 3
    assert engine.table("users", event_id=4).count() == 3
    assert again.report().corrupted == 0 and again.replay().where("not deleted").count() == 3  # Q3


def test_constraints(engine):
    for row, message in (({"id": 1, "email": "x", "age": 1}, "primary key"), ({"id": 7, "email": "a", "age": 1}, "unique"), ({"id": "7", "email": "x", "age": 1}, "expects INT"), ({"id": 7, "email": "x"}, "missing"), ({"id": 7, "email": "x", "age": 1, "z": 1}, "extra")):
        with pytest.raises(ConstraintError, match=message):
            engine.insert("users", row)
    with pytest.raises(ConstraintError):
        engine.insert_many("users", [{"id": 7, "email": "x", "age": 1}, {"id": 7, "email": "y", "age": 1}])
    with pytest.raises(ConstraintError, match="exists"):
        engine.execute("CREATE TABLE users (id INT)")
    with pytest.raises(ConstraintError, match="count mismatch"):
        engine.execute("INSERT INTO users VALUES (1)")
    with pytest.raises(LookupError):
        engine.execute("SELECT * FROM nobody")
    with pytest.raises(ConstraintError):  # Q7
        engine.execute("UPDATE users SET id = 2 WHERE id = 1")
    with pytest.raises(ConstraintError):
        engine.execute("UPDATE users SET id = 9 WHERE age = 25")
    assert engine.table("users").count() == 3 and engine.log.last_id() == 4


def test_snapshots_and_evolution(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), snapshot_interval=4)
    e.create_table("t", [ColumnDef("id", "INT", True)])
    e.insert_many("t", [{"id": k} for k in range(5)])
    assert e.snapshots.latest().base_event_id == 6
    e.insert("t", {"id": 7})
    assert e.table("t").count() == 6 and e.table("t", event_id=3).count() == 2
    assert e.evolve("t", [ColumnDef("id", "INT", True), ColumnDef("s", "TEXT")], [AddColumn("s", "new")]) == 2
    assert e.replay({"t": 2}).where("data['s'] = '\"new\"'").count() == 6
    assert Engine(spark, e.path).version == 2


def test_insert_frame(engine):
    rows = engine.spark.range(100, 150).select(F.col("id").cast("double"), F.concat(F.lit('q"'), "id").alias("email"), F.lit(1.0).alias("age"))
    assert engine.insert_frame("users", rows) == 50
    log = engine.log.read()
    assert log.select("id").distinct().count() == log.count() == engine.log.last_id() == 54
    assert engine.table("users").where("email = 'q\"120'").count() == 1
    with pytest.raises(ConstraintError):
        engine.insert_frame("users", rows)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([("1", 10), ("3", 30)], "ref string, n int")
    out = relational.join_equal(a, "a", "id", b, "b", "ref")
    assert out.columns == ["a.id", "a.v", "b.ref", "b.n"] and out.count() == 1
    assert relational.filter_equal(out, "b.n", "10").count() == 1 and relational.filter_equal(out, "n", 10.0).count() == 0
    with pytest.raises(ValueError):
        relational.join_equal(a, "a", "zz", b, "b", "ref")
    assert relational.join_equal(a, "a", "zz", b, "b", "yy", compat=True).count() == 4  # J5
    assert relational.join_equal(a, "a", "zz", b, "b", "ref", compat=True).count() == 0
    both = relational.join_equal(a, "a", "id", a, "a", "id")  # J4
    assert both.columns == ["a.id", "a.v"] and both.count() == 2


def test_streaming(spark, tmp_path, engine):
    folders = [str(tmp_path / n) for n in ("state", "checkpoint", "bad")]
    with pytest.raises(LookupError):
        ingest.maintained(spark, folders[0])
    for delete in (True, False):
        ingest.maintain(ingest.events_stream(spark, engine.log.path, 1), *folders).awaitTermination()
        if delete:
            engine.execute("DELETE FROM users WHERE id = 2")
    state = ingest.maintained(spark, folders[0])
    key = lambda df: sorted((r.row_id, sorted(r.data.items()), r.deleted) for r in df.collect())
    assert key(state) == key(engine.state()) and state.where("not deleted").count() == 2


def test_partial_states_merge_in_any_order(spark):
    log = user_events(spark, "/root/testdata/sf0.001")
    parts = [replay.partial_state(log.where(F.col("id") % 3 == k)) for k in (2, 0, 1)]
    merged = replay.finished(replay.merged_states(*parts, parts[0]))
    key = lambda df: sorted((r.row_id, sorted(r.data.items()), r.deleted) for r in df.collect())
    assert key(merged) == key(replay.fold(log))
