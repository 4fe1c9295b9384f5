import hashlib

from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.functions.regex import match_lines, with_flags


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys()))
    return df.select(expr.alias("x")).first()["x"]


def test_loc_cases(spark):
    df = spark.createDataFrame([("",), ("\n",), ("a\n\n",), ("a\nb",), ("\n\na",)], ["t"])
    assert [r.x for r in df.select(S.loc("t").alias("x")).collect()] == [1, 0, 1, 2, 3]


def test_offset_to_line(spark):
    assert one(spark, S.offset_to_line(F.col("t"), F.lit(0)), t="a\nb") == 1
    assert one(spark, S.offset_to_line(F.col("t"), F.lit(2)), t="a\nb") == 2


def test_short_md5(spark):
    assert one(spark, S.short_md5("t"), t="héllo") == hashlib.md5("héllo".encode()).hexdigest()[:16]


def test_strip_options_drops_every_known_option_with_its_value(spark):
    args = ["--mine", "--cvc5Exe", "/opt/solver", "--printMethodCFGs", "--timeout", "77", "--other", "value"]
    df = spark.createDataFrame([(args,)], "a array<string>")
    assert df.select(S.strip_options("a").alias("x")).first().x == ["--mine", "--other", "value"]


def test_strip_option_first_occurrence_and_flag_value(spark):
    df = spark.createDataFrame([(["--timeout", "--x", "--timeout", "5"],)], "a array<string>")
    # first --timeout is followed by a flag: only it is dropped
    assert df.select(S.strip_option(F.col("a"), "--timeout").alias("x")).first().x == ["--x", "--timeout", "5"]
    df2 = spark.createDataFrame([(["a", "--timeout"],)], "a array<string>")
    assert df2.select(S.strip_option(F.col("a"), "--timeout").alias("x")).first().x == ["a"]


def test_rerun_args(spark):
    df = spark.createDataFrame([(["--timeout", "3", "--keep"], True)], "a array<string>, own boolean")
    out = df.select(S.rerun_args(F.array(F.lit("--extra")), "a", F.col("own"), F.lit(7)).alias("x")).first().x
    assert out == ["--extra", "--keep", "--timeout", "7"]


def test_time_budget(spark):
    df = spark.createDataFrame([(100,), (10000,), (500000,)], ["r"])
    rows = df.select(S.time_budget("r").alias("b"), S.rerun_budget("r").alias("u")).collect()
    assert [r.b for r in rows] == [10, 50, 600]
    assert [r.u for r in rows] == [0, 50, 2500]


def test_runtime_differs(spark):
    df = spark.createDataFrame([(100, 150), (100, 149), (150, 100)], ["a", "b"])
    assert [r.x for r in df.select(S.runtime_differs("a", "b", 1.5).alias("x")).collect()] == [True, False, True]


def test_phase_durations(spark):
    df = spark.createDataFrame([([("parse", 5), ("check", 12), ("verify", 30)],)],
                               "p array<struct<phase:string,millis:bigint>>")
    out = df.select(S.phase_durations("p").alias("x")).first().x
    assert [(r.phase, r.millis) for r in out] == [("parse", 5), ("check", 7), ("verify", 18)]


def test_regex_lines_cases(spark):
    df = spark.createDataFrame([("a\nwhile(x)\n\nwhile(y) while(z)\n",)], ["t"])
    assert df.select(match_lines(F.col("t"), r"while\([^)]*\)").alias("x")).first().x == [2, 4, 4]
    df2 = spark.createDataFrame([("a\nb",)], ["t"])
    assert df2.select(match_lines(F.col("t"), "(?m)^").alias("x")).first().x == [1, 2]
    assert df2.select(match_lines(F.col("t"), "z").alias("x")).first().x == []


def test_flags():
    assert with_flags("a.b", 0x02 | 0x08) == "(?im)a.b"
    assert with_flags("a.b\\E", 0x10) == "\\Qa.b\\E\\\\E\\Q\\E"
    import pytest

    with pytest.raises(ValueError):
        with_flags("x", 0x80)


def test_literal_flag_matches_literally(spark):
    df = spark.createDataFrame([("a.b axb",)], ["t"])
    assert df.select(match_lines(F.col("t"), with_flags("a.b", 0x10)).alias("x")).first().x == [1]
