from pyspark.sql import functions as F

from tidelog.llm import common, compact_windows, set_join


def test_wanted_rows_are_split_off(spark):
    """None of the wanted is missed, null keys and negative ones neither; all rows are in one of the two parts, and few others are with the wanted."""
    rows = spark.range(-20_000, 20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.col("id").alias("__slots"), F.lit("x").alias("__bits"))
    wanted = rows.where("doc_id % 7 = 0 or doc_id is null").select("doc_id")
    some, rest = common.split_by(rows, ["doc_id"], wanted)
    some, rest = ([tuple(r) for r in x.collect()] for x in (some, rest))
    assert sorted(r[1] for r in some + rest) == list(range(-20_000, 20_000))
    least = {r[1] for r in rows.where("doc_id % 7 = 0 or doc_id is null").collect()}
    assert least <= {r[1] for r in some} and len(some) < len(least) + 100
    assert common.split_by(rows, ["doc_id"], wanted.limit(0))[0].count() == 0



def test_rows_that_stay_are_not_shipped(spark):
    """Of the branches of a result, one takes rows as they are: those that nothing is cut from, and ids that stay."""
    docs = spark.createDataFrame([(k, f"text {k} " + " ".join(f"w{k}-{j}" for j in range(80)), 1) for k in range(20)], "doc_id long, text string, n_chars int")
    docs = common.staged(docs, "test")
    for out in (compact_windows.cut_repeats(docs), set_join.keep_one_of_each(docs, 5, 80)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and out.count() == 20
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
