from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators.quantiles import exact_median, exact_quantiles, placed_values
from spectrafold.operators.splits import split_points

PLACES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "top": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    plain = spark.range(60000).selectExpr(
        "id % 3 AS g", "CASE WHEN id % 7 = 0 THEN 5D WHEN id % 3 = 2 THEN 1D ELSE sin(id) * 100 END AS v"
    )
    null_key = spark.range(15001).selectExpr("CAST(NULL AS BIGINT) AS g", "id * 1D AS v")
    unknown = spark.range(12000).selectExpr("7L AS g", "IF(id = 5, NULL, id * 1D) AS v")
    few = spark.range(4).selectExpr("8L AS g", "id * id * 1D AS v")
    return plain.unionAll(null_key).unionAll(unknown).unionAll(few)


@pytest.mark.parametrize("group_rows", [10**9, 10])
@pytest.mark.parametrize("interpolate", [True, False])
def test_equals_numpy(values, group_rows, interpolate):
    frame = values.toPandas()
    method = "linear" if interpolate else "inverted_cdf"
    got = exact_quantiles(values, ["g"], "v", PLACES, group_rows, interpolate).collect()
    assert len(got) == 6
    for row in got:
        if row.g == 7:
            assert row.mid is None and row.top is None
            continue
        group = frame[frame.g.isna()] if row.g is None else frame[frame.g == row.g]
        want = np.quantile(group.v, list(PLACES.values()), method=method)
        assert [row[n] for n in PLACES] == pytest.approx(list(want))


def test_median_of_even_count_is_the_mean_of_the_middle(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0)], "k string, x double")
    assert exact_median(df, ["k"], "x").collect()[0].x == 3.0


def test_ranking_is_bounded_whatever_the_group(spark):
    df = spark.range(40000).selectExpr("1 AS k", "IF(id % 3 = 0, 5D, exp(id % 50) + id) AS _v")
    points = split_points(df, ["k"], ["_v"], 300)
    slices = placed_values(df, points, ["k"]).groupBy("_slice").agg(F.countDistinct("_v").alias("n"))
    assert slices.count() > 20
    assert slices.agg(F.max("n")).collect()[0][0] < 300 * 12  # one value that a third of the rows have counts once


def test_infinite_and_single_values(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "CASE WHEN id % 2 = 0 THEN 4D WHEN id % 4 = 1 THEN id * 1D ELSE double('inf') END AS v")
    for every in (10**9, 10):
        got = {r.k: (r.mid, r.top) for r in exact_quantiles(df, ["k"], "v", {"mid": 0.25, "top": 1.0}, every).collect()}
        assert got[0] == (4.0, 4.0) and got[1][1] == float("inf")
        assert got[1][0] == pytest.approx(np.quantile([i for i in range(5000) if i % 4 == 1] + [np.inf] * 1250, 0.25))
