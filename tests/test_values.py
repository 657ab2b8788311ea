import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from tidelog.functions import values as V

RENDERED = {7.0: "7", 1.5: "1.5", 999999.0: "999999", 1000000.0: "1e+06", 12345678.0: "1.2345678e+07", 0.00001: "1e-05", 0.0001: "0.0001", 0.1: "0.1", 0.0: "0", -2.25: "-2.25", -1e21: "-1e+21", 123456.75: "123456.75"}


def test_render_table():
    for number, text in RENDERED.items():
        assert V.render(number) == text
    assert (V.render(True), V.render(None), V.render("x")) == ("true", "<nil>", "x")


def test_render_column_agrees(spark):
    rows = spark.createDataFrame([(n, t) for n, t in RENDERED.items()], "n double, t string")
    assert [(r.got, r.t) for r in rows.select(V.render_column(F.col("n"), DoubleType()).alias("got"), "t").collect()] == [(t, t) for t in RENDERED.values()]


def test_literals():
    assert V.parse_literal("'a b'") == "a b" and V.parse_literal("'it''s'") == "it's"
    assert V.parse_literal("TRUE") is True and V.parse_literal("7") == 7.0 and V.parse_literal("0x1p4") == 16.0
    assert V.parse_literal("NULL") == "NULL" and V.parse_literal("'") == "'"
    for text in ("nan", "inf", "-Infinity"):
        with pytest.raises(ValueError):
            V.parse_literal(text)


def test_q1_equality_by_text(spark):
    df = spark.createDataFrame([(1.0, 1, "1", True), (1e6, 1000000, "1000000", False)], "d double, l long, s string, b boolean")
    kinds = {"d": DoubleType(), "l": LongType(), "s": StringType(), "b": BooleanType()}
    hits = lambda c, lit: df.where(V.equals_literal(F.col(c), kinds[c], lit)).count()
    assert hits("d", "1") == hits("l", "1") == hits("s", 1.0) == hits("b", "true") == 1
    assert hits("d", "1.0") == hits("d", "1000000") == hits("s", 1e6) == hits("b", 1.0) == 0
    assert hits("d", "1e+06") == hits("l", "1e+06") == hits("s", "1000000") == 1


def test_q1_predicate_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumnRenamed("id", "k").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(V.equals_literal(F.col("k"), LongType(), "7"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan


def test_type_checks():
    assert V.type_matches("INT", 1.5) and not V.type_matches("INT", True) and not V.type_matches("INT", "1")
    assert V.type_matches("TEXT", "x") and not V.type_matches("BOOL", 1.0) and V.type_matches("BLOB", None)
