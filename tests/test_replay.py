import pytest
from pyspark.sql import functions as F

from tidelog.operators import integrity, replay, snapshots
from tidelog.operators.evolution import COMPATIBLE, INCOMPATIBLE, NEEDED, AddColumn, ModifyColumn, Registry, RemoveColumn, RenameColumn, history, migrated
from tidelog.sources import log as logs
from tidelog.sources.cdc import user_events

SF = "/root/testdata/sf0.001"


def make(spark, *events):
    return logs.events_frame(spark, events, 1)


def put(kind, row_id, data=None, version=1, table="t"):
    return logs.event(kind, table, version, row_id, data)


def maps(df):
    return {(r.table_name, r.row_id): (r.data, r.deleted) for r in df.collect()}


def test_update_wins_delete_hides_insert_replaces(spark):
    log = make(spark, put(logs.INSERTED, 1, {"a": 1, "b": "x"}), put(logs.UPDATED, 1, {"a": 2}), put(logs.INSERTED, 2, {"a": 5}), put(logs.DELETED, 2), put(logs.UPDATED, 3, {"a": None}), put(logs.INSERTED, 1, {"b": "y"}), put(logs.DELETED, 9))
    want = {("t", 1): ({"b": '"y"'}, False), ("t", 2): ({"a": "5"}, True), ("t", 3): ({"a": "null"}, False)}
    assert maps(replay.state_maps(log)) == want == maps(replay.fold(log))
    rows = replay.state(log, [replay.field("a", "double"), replay.field("b")], include_deleted=True).orderBy("row_id").collect()
    assert [(r.row_id, r.a, r.b, r.deleted) for r in rows] == [(1, None, "y", False), (2, 5.0, None, True), (3, None, None, False), (9, None, None, True)]


def test_revived_by_insert_not_by_update(spark):
    log = make(spark, put(logs.INSERTED, 1, {"a": 1}), put(logs.DELETED, 1), put(logs.UPDATED, 1, {"a": 2}))
    assert replay.state(log, [replay.field("a", "double")]).count() == 0
    assert maps(replay.state_maps(log)) == {("t", 1): ({"a": "2"}, True)} == maps(replay.fold(log))


def test_text_values_survive_json(spark):
    text = 'quote " back \\ slash, ümlaut ☃\nline'
    log = make(spark, put(logs.INSERTED, 1, {"a": text}))
    assert replay.state(log, [replay.field("a")]).first().a == text


@pytest.mark.parametrize("base", [0, 50, 200, 499, 500, 501, 999, 1000])
def test_q2_snapshot_and_tail_equal_full_replay(spark, base):
    log = user_events(spark, SF)
    full = maps(replay.state_maps(log))
    snapshot = replay.state_maps(replay.up_to(log, base)) if base else replay.state_maps(log.limit(0))
    assert maps(replay.state_maps(replay.with_tail(snapshot, base, log))) == full == maps(replay.fold(log))


def test_replay_ignores_the_order_of_rows(spark):
    log = user_events(spark, SF)
    assert maps(replay.state_maps(log.orderBy(F.rand(1)))) == maps(replay.state_maps(log)) == maps(replay.fold(log.orderBy(F.rand(2))))


def test_one_exchange_and_pruned_fields(spark):
    fields = [replay.field("v", "double"), replay.field("k", "bigint")]
    plan = replay.state(user_events(spark, SF), fields).where("row_id = 7").select("v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "__k" not in plan and "EqualTo(user_id,7)" in plan


def test_versions_and_next_ids(spark):
    log = make(spark, logs.event(logs.CREATED, "t", 1, definition=[]), put(logs.INSERTED, 0, {"a": 1}), put(logs.INSERTED, 1, {"a": 1}), put(logs.DELETED, 1))
    assert {(r.row_id, r.version) for r in replay.row_versions(log).collect()} == {(0, 2), (1, 4)}
    assert replay.next_row_ids(log).first().next_row_id == 2  # Q16: deleted ids aren't used again


def test_snapshot_store(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.restore()
    log = user_events(spark, SF)
    for base in (10, 20, 30, 40, 50):
        store.create(replay.state_maps(replay.up_to(log, base)), base)
    assert store.prune(9) == 0 and store.prune(2) == 3
    assert [r.base_event_id for r in store.history().collect()] == [40, 50]
    state, base = store.restore()
    assert base == 50 and maps(state) == maps(replay.state_maps(replay.up_to(log, 50)))
    assert store.newest_before(45) == store.history().first().snapshot_id and store.newest_before(5) is None
    entry = store.latest()
    state.where("row_id % 2 = 0").write.mode("overwrite").parquet(str(tmp_path / "other"))
    import shutil

    shutil.rmtree(entry.path)
    shutil.copytree(tmp_path / "other", entry.path)
    with pytest.raises(snapshots.CorruptSnapshot):
        store.restore(entry.snapshot_id)
    assert maps(snapshots.current_state(log, store)) == maps(replay.state_maps(log))


def test_operations(spark):
    row = {"id": 1, "user_name": "x", "old": 2}
    log = make(spark, put(logs.INSERTED, 1, row))
    registry = Registry()

    def after(*operations):
        registry.register_migration("t", 1, 2, list(operations))
        return migrated(log, registry, {"t": 2}, {"t": [1]}).first().data

    base = {"id": "1", "user_name": '"x"', "old": "2"}
    assert after(AddColumn("email", "none")) == base | {"email": '"none"'} and after(AddColumn("id", 9)) == base
    assert after(RemoveColumn("old")) == {"id": "1", "user_name": '"x"'}
    assert after(RenameColumn("user_name", "old")) == {"id": "1", "old": '"x"'} and after(RenameColumn("nope", "z")) == base
    assert after(ModifyColumn("id")) == base and after(ModifyColumn("id", "double"))["id"] == "1.0"


def test_q13_q14_paths(spark):
    registry = Registry()
    for v in (1, 3, 2):
        registry.register("t", v, [])
    registry.register_migration("t", 1, 2, [RenameColumn("a", "b")])
    registry.register_migration("t", 2, 3, [AddColumn("c", 0)])
    assert registry.latest("t") == 3 and registry.latest("none") == 0
    assert (registry.check("t", 1, 2), registry.check("t", 2, 2), registry.check("t", 2, 1), registry.check("t", 1, 9)) == (NEEDED, COMPATIBLE, COMPATIBLE, INCOMPATIBLE)
    assert (registry.check("t", 1, 3), registry.check_path("t", 1, 3)) == (INCOMPATIBLE, NEEDED)  # Q15
    with pytest.raises(ValueError):
        registry.path("t", 2, 1)
    log = make(spark, put(logs.INSERTED, 1, {"a": 1}), put(logs.UPDATED, 1, {"a": 2}), put(logs.INSERTED, 2, {"a": 3}, version=9))
    kept = maps(replay.state_maps(migrated(log, registry, {"t": 3}, {"t": [1, 9]}, "keep")))
    assert kept[("t", 1)][0] == {"a": "2", "b": "1", "c": "0"} and kept[("t", 2)][0] == {"a": "3"}
    moved = maps(replay.state_maps(migrated(log, registry, {"t": 3}, {"t": [1, 9]}, "keep", migrate_updates=True)))
    assert moved[("t", 1)][0] == {"b": "2", "c": "0"}
    dropped = maps(replay.state_maps(migrated(log, Registry(), {"t": 2}, {"t": [1, 9]}, "drop")))
    assert dropped[("t", 1)][0] == {"a": "2"} and ("t", 2) in dropped


def test_history(spark):
    log = make(spark, logs.event(logs.CREATED, "users", 1, definition=[]), logs.event(logs.EVOLVED, "users", 2, definition=[]), logs.event(logs.EVOLVED, "users", 2, definition=[]), logs.event(logs.CREATED, "products", 1, definition=[]))
    assert {r.table_name: r.versions for r in history(log).collect()} == {"users": [1, 2], "products": [1]}


def test_corruption(spark):
    log = make(spark, logs.event(logs.CREATED, "t", 1, definition=[]), put(logs.INSERTED, 1, {"a": 1}), put(logs.INSERTED, None, {"a": 1}), put(logs.INSERTED, 2, {"a": 2}), put("OTHER", None))
    assert integrity.report(log).first().asDict() == {"total": 5, "corrupted": 1, "first_issue": 3, "last_valid": 5, "recovered": 2, "can_partial": True}
    bad = log.withColumn("checksum", F.when(F.col("id") == 4, "0").otherwise(F.col("checksum")))
    assert [(r.id, r.issue) for r in integrity.issues(bad).orderBy("id").collect()] == [(3, "structure"), (4, "checksum")]
    assert maps(replay.state_maps(integrity.valid(bad))) == {("t", 1): ({"a": "1"}, False)}
    assert integrity.report(log.limit(0)).first().asDict() == {"total": 0, "corrupted": 0, "first_issue": 0, "last_valid": 0, "recovered": 0, "can_partial": False}
    assert integrity.status(bad).startswith("3 of 5 events are usable\n2 corrupt, from event 3 on") and len(log.first().checksum) == 64


def test_q12_lines(spark, tmp_path):
    log = make(spark, put(logs.INSERTED, 1, {"a": "x"}), put(logs.UPDATED, 1, {"a": "y"}), put(logs.DELETED, 1))
    lines = [r.value for r in log.orderBy("id").select(F.to_json(F.struct("id", "type", "timestamp", "version", "tx_id", F.to_json(F.struct("table_name", "row_id", F.col("data"))).alias("payload"), "checksum")).alias("value")).collect()]
    path = tmp_path / "events.log"
    path.write_text("\n".join([lines[0], "{torn", lines[1], lines[2]]) + "\n")
    events, bad = logs.read_lines(spark, str(path))
    assert [r.id for r in events.orderBy("id").collect()] == [1, 2, 3] and bad.first().line == "{torn"
    assert [r.id for r in logs.read_lines(spark, str(path), stop_at_error=True)[0].collect()] == [1]
    logs.write_lines(log, str(tmp_path / "out"))
    assert logs.read_lines(spark, str(tmp_path / "out"))[0].count() == 3
