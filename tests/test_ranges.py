"""Counts and sums of points in ranges: any length, ties, equal ranges, nulls, rows that don't grow with the product."""

import random

from stepwise.operators.ranges import range_totals


def test_range_totals_equal_pairs(spark):
    rnd = random.Random(4)
    points = [(rnd.choice([1, 1, 1, 2, None]), rnd.randrange(-3000, 3000), rnd.choice(["a", "b", None]), rnd.choice([None, 0.5, -2.0, 8.0])) for _ in range(500)]
    points += points[:20]
    ranges = []
    for n in range(120):
        lo = rnd.randrange(-3200, 3200)
        ranges.append((rnd.choice([1, 2, 3]), lo, lo + rnd.choice([0, 0, 1, 2, 3, 7, 8, 60, 500, 6000]), n))
    ranges += [(1, p[1], p[1], 200 + i) for i, p in enumerate(points[:20])]
    ranges += [(1, 5, 4, 300), (None, -9, 9, 301), (1, None, 9, 302), (1, -9, None, 303), (1, -(1 << 61), 1 << 61, 304), (2, -4096, 4095, 305)]
    ranges += ranges[:10]  # equal ranges count again
    want = {}
    for key, lo, hi, n in ranges:
        for k, code, item, value in points:
            if key is not None and k == key and None not in (lo, hi) and lo <= code <= hi:
                of = want.setdefault(n, [{}, None])
                of[0][item] = of[0].get(item, 0) + 1
                of[1] = of[1] if value is None else (of[1] or 0) + value
    p = spark.createDataFrame(points, "key int, code long, item string, value double")
    r = spark.createDataFrame(ranges, "key long, lo long, hi long, n int")
    for top in (0, 3, 6, 11, 40):
        got = {}
        for total, n, items, counts in range_totals(p, r.filter("hi - lo < 9000") if top == 0 else r, top).collect():
            of = got.setdefault(n, [{}, None])
            for item, c in zip(items, counts, strict=True):
                of[0][item] = of[0].get(item, 0) + c
            of[1] = of[1] if total is None else (of[1] or 0) + total
        assert got == {n: v for n, v in want.items() if top or n != 304}


def test_a_range_is_a_few_rows_whatever_its_length_and_points(spark):
    points = spark.range(4000).selectExpr("1 key", "id * 1000 code", "concat('i', id % 7) item", "1D value")
    ranges = spark.range(500).selectExpr("1 key", "id * 10 lo", "id * 10 + pow(10, id % 7) hi", "id n").selectExpr("key", "lo", "cast(hi as long) hi", "n")
    rows = range_totals(points, ranges, 18)
    assert rows.groupBy("n").count().agg({"count": "max"}).first()[0] <= 8
    assert rows.selectExpr("sum(total)").first() == ranges.join(points, "key").filter("code between lo and hi").selectExpr("sum(value)").first()


def test_range_totals_of_nothing(spark):
    p = spark.createDataFrame([], "key int, code long, item string, value double")
    r = spark.createDataFrame([(1, 0, 9, 1)], "key int, lo long, hi long, n int")
    assert range_totals(p, r, 3).count() == 0
    assert range_totals(p.unionByName(spark.createDataFrame([(1, 5, None, None)], p.schema)), r.filter("n > 1"), 3).count() == 0
