from pyspark.sql import functions as F

from stepwise.functions import (Alias, canonicalise, classify, distinct_from, nonzero_or, pad_position, rewrite_codes,
                                safe_number, split_first, strict_greatest, strict_least, tsql_concat, tsql_plus)


def test_strict_least_greatest_null_if_any_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None)], "a double, b double")
    got = [(r.l, r.g) for r in df.select(strict_least("a", "b").alias("l"), strict_greatest("a", "b").alias("g")).collect()]
    assert got == [(1.0, 2.0), (None, None), (None, None)]


def test_safe_number_and_distinct_from(spark):
    df = spark.createDataFrame([("12.5", 1, 1), ("abc", None, None), (None, 1, None)], "s string, a int, b int")
    got = [(r.n, r.d) for r in df.select(safe_number("s").alias("n"), distinct_from("a", "b").alias("d")).collect()]
    assert got == [(12.5, False), (None, False), (None, True)]


def test_nonzero_or_counts_null_and_zero_as_default(spark):
    df = spark.createDataFrame([(0.0,), (None,), (920.0,)], "t double")
    assert [r.x for r in df.select((F.floor(nonzero_or("t", 460) / 460)).alias("x")).collect()] == [1, 1, 2]


def test_pad_position_plus_and_concat_forms(spark):
    df = spark.createDataFrame([("1",), ("12 ",), ("123",), ("1234",), ("",), (None,)], "p string")
    got = [(r.plus, r.cat) for r in df.select(pad_position("p", 3, "plus").alias("plus"),
                                             pad_position("p", 3, "concat").alias("cat")).collect()]
    assert got == [("001", "001"), ("012", "012"), ("123", "123"), (None, "1234"), ("000", "000"), (None, None)]


def test_tsql_concat_vs_plus(spark):
    df = spark.createDataFrame([("a", None, 3)], "a string, b string, n bigint")
    r = df.select(tsql_concat("a", "b", "n").alias("c"), tsql_plus("a", "b").alias("p")).first()
    assert r.c == "a3" and r.p is None


def test_split_first_is_literal_and_rewrites_are_nested(spark):
    df = spark.createDataFrame([("Singulation|parent", "403020")], "s string, c string")
    r = df.select(split_first("s", "|").alias("x"), rewrite_codes("c", [("^403", "404"), ("^404", "304")]).alias("y")).first()
    assert r.x == "Singulation" and r.y == "304020"


def test_canonicalise_order_values_then_like(spark):
    aliases = [Alias("HardwarePlatform", values=["Hardware Platform"], like=["Hardware%Platform%"]),
               Alias("Microwave", values=["Microwave", "Cabinet Type"])]
    df = spark.createDataFrame([("Hardware Platform",), ("Hardware X Platform v2",), ("Cabinet Type",), ("Turbo",), (None,)], "p string")
    got = [r.c for r in df.select(canonicalise("p", aliases).alias("c")).collect()]
    assert got == ["HardwarePlatform", "HardwarePlatform", "Microwave", "Turbo", None]


def test_classify_without_default_is_null(spark):
    df = spark.createDataFrame([(5,), (50,)], "x int")
    got = [r.c for r in df.select(classify([(F.col("x") > 10, "big")]).alias("c")).collect()]
    assert got == [None, "big"]
