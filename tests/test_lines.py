from tidelog.operators import integrity
from tidelog.plans import queries
from tidelog.sources import log as logs
from tidelog.sources.cdc import user_events


def test_a_line_is_parsed_once(spark, tmp_path):
    """However many columns, checks and filters rest on what a line holds."""
    log = user_events(spark, "/root/testdata/sf0.001", with_checksums=True)
    logs.write_lines(log, f"{tmp_path}/lines")
    read = integrity.valid(logs.read_lines(spark, f"{tmp_path}/lines")[0])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # the line; the objects data and changes, deleted_data, old_values
    assert plan.count("from_json(") == 4, plan.count("from_json(")
    state = [sorted(map(tuple, queries._rows(x).collect())) for x in (read, log)]
    assert state[0] == state[1] and read.count() == log.count()
