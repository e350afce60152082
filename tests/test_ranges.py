import random

import pytest
from pyspark.sql import functions as F

from vetra.operators import ranges

SCOPE = "path string, start_line long, end_line long"


def brute(rows, scope):
    return [r for r in rows if r[1] is not None and any(p == r[0] and s is not None and e is not None and r[1] <= e and (r[2] if r[2] is not None else r[1]) >= s for p, s, e in scope)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_touch_the_same_ranges_as_pair_by_pair(spark, seed):
    rnd = random.Random(seed)
    at = lambda: rnd.choice([rnd.randint(-5, 40), rnd.randint(0, 3000), 255, 256, 257])
    scope = [(p, s, rnd.choice([s, s + rnd.randint(0, 9), s + rnd.randint(0, 700), s - 1, (1 << 63) - 1 if rnd.random() < 0.05 else s])) for p in "abc" for s in (at() for _ in range(12))] + [("c", None, 4), ("c", 4, None), ("d", 1, (1 << 63) - 1)]
    rows = [(p, s, rnd.choice([None, s, s + rnd.randint(0, 400)]), i) for p in "abcde" for i, s in enumerate(at() for _ in range(60))] + [("a", None, None, -1), (None, 3, 3, -2)] + [("a", 7, 9, 70)] * 2
    df = spark.createDataFrame(rows, "path string, line long, end_line long, n int")
    got = ranges.touching(df, spark.createDataFrame(scope, SCOPE), F.col("line"), F.coalesce("end_line", "line"))
    assert got.columns == df.columns
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, scope), key=key)


def test_nothing_touches_nothing(spark):
    df = spark.createDataFrame([("a", 1)], "path string, line long")
    assert ranges.touching(df, spark.createDataFrame([], SCOPE), F.col("line"), F.col("line")).count() == 0
    assert ranges.touching(df.where("false"), spark.createDataFrame([("a", 1, 2)], SCOPE), F.col("line"), F.col("line")).count() == 0


def test_a_path_with_very_many_rows_and_ranges(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("hot").alias("path"), (F.col("id") * 3).alias("line"), "id")
    scope = spark.range(n).select(F.lit("hot").alias("path"), (F.col("id") * 6).alias("start_line"), (F.col("id") * 6 + 1).alias("end_line"))
    out = ranges.touching(df, scope, F.col("line"), F.col("line"))
    assert out.count() == n // 2
    assert ranges.islands(scope).count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_islands_are_the_lines_of_all_ranges(spark, seed):
    rnd = random.Random(seed)
    scope = [(p, s, s + rnd.choice([-1, 0, 3, 40, 600])) for p in "ab" for s in (rnd.randint(0, 4000) for _ in range(40))] + [("c", 10, 10), ("c", 11, 20), ("c", 22, 23)]
    want = set()
    for p in "abc":
        lines = sorted({x for q, s, e in scope if q == p for x in range(s, e + 1)})
        at = None
        for i, x in enumerate(lines):
            at = x if i == 0 or lines[i - 1] != x - 1 else at
            if i + 1 == len(lines) or lines[i + 1] != x + 1:
                want.add((p, at, x))
    assert {tuple(r) for r in ranges.islands(spark.createDataFrame(scope, SCOPE)).collect()} == want
