"""Results against brute force where the plan takes a shortcut, and on NaN."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import cleaning, splits


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.46, 0.5, 0.9, 1.5])
def test_close_compositions_against_all_pairs(spark, threshold):
    r = random.Random(1)
    sets = [dict.fromkeys("ABCDEFGHIJ", 1.0), dict.fromkeys("KLMNOPQRST", 1.0), dict.fromkeys("ABCD", 1.0), dict.fromkeys("BCD", 1.0), {"A": 1.0}, {"K": 1.0}]
    sets += [{e: r.choice((0.5, 1.0, 2.0, 3.0)) for e in r.sample("ABCDEFGHIJKLMNOPQRST", r.randint(1, 12))} for _ in range(40)]
    vectors = {f"f{i}": {e: x / sum(s.values()) for e, x in s.items()} for i, s in enumerate(sets)}
    df = spark.createDataFrame([(f, e, x) for f, v in vectors.items() for e, x in v.items()], "formula string, element string, fraction double")
    distance = lambda a, b: sum((a.get(e, 0) - b.get(e, 0)) ** 2 for e in a.keys() | b.keys()) ** 0.5
    expected = {(f, g) for f, g in itertools.product(vectors, vectors) if distance(vectors[f], vectors[g]) ** 2 <= threshold**2 + 1e-12}
    got = [(x.split, x.member) for x in splits.close_compositions(df, "formula", threshold).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, nan), (2, nan, 2.0), (3, 3.0, 4.0), (4, None, 4.0)], "id long, a double, b double")
    assert cleaning.columns_with_null(df) == ["a", "b"]
    assert cleaning.drop_columns_with_null(df).columns == ["id"]
    assert cleaning.drop_rows_with_null(df).count() == 1
    filled = {r.id: (r.a, r.b) for r in cleaning.impute(df, ["a", "b"]).collect()}
    assert filled == {1: (1.0, pytest.approx(10 / 3)), 2: (2.0, 2.0), 3: (3.0, 4.0), 4: (2.0, 4.0)}


def test_time_folds_against_a_sort(spark):
    rows = [(i, (i * 7919) % 50) for i in range(307)]
    df = spark.createDataFrame(rows, "id long, t long")
    got = {r.id: r.block for r in splits.time_series_folds(df, "id", F.col("t"), 4, ranges=8).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    first = 307 - 4 * (307 // 5)
    assert got == {r[0]: 0 if k <= first else -(-(k - first) // (307 // 5)) for k, r in enumerate(ordered, 1)}
