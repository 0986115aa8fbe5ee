from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.functions import numeric, ordered, samples, tails

# two-sided values from printed t tables
T_TABLE = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (1.972, 200, 0.05), (1.962, 1000, 0.05), (2.576, 10**9, 0.01)]


def test_t_tail_matches_tables(spark):
    df = spark.createDataFrame([(t, d) for t, d, _ in T_TABLE], "t double, d bigint")
    got = [r[0] for r in df.select(tails.student_t_two_sided(F.col("t"), F.col("d"))).collect()]
    for p, (_, _, want) in zip(got, T_TABLE, strict=True):
        assert p == pytest.approx(want, rel=2e-3)


def test_t_tail_series_and_asymptotics_agree_at_the_switch(spark):
    rows = [(t, float(d)) for t in (0.01, 0.5, 2.0, 6.0) for d in (199, 200, 201, 202)]
    df = spark.createDataFrame(rows, "t double, d double")
    for r in df.select("t", tails._t_series(F.col("t"), F.col("d")).alias("s"), tails._t_asymptotic(F.col("t"), F.col("d")).alias("a")).collect():
        assert r.s == pytest.approx(r.a, abs=1e-12)


def test_t_tail_edges(spark):
    df = spark.createDataFrame([(0.0, 5), (None, 5), (1.0, 0), (1e300, 5), (-2.0, 10)], "t double, d bigint")
    got = [r[0] for r in df.select(tails.student_t_two_sided(F.col("t"), F.col("d"))).collect()]
    assert got[0] == 1.0 and got[1] is None and got[2] is None and got[3] == 0.0
    assert got[4] == pytest.approx(0.07338803477074037, abs=1e-14)


def test_normal_cdf_matches_erfc(spark):
    zs = [-40.0, -9.0, -3.0, -2.999, -1.5, -1e-9, 0.0, 0.3, 1.959963984540054, 3.0, 5.0, 40.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", tails.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-12, abs=1e-300)


def test_chi2_tail():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert tails.chi2_tail(0.0, 3) == 1.0
    assert tails.chi2_tail(1e5, 28) == 0.0


def _test_pair(spark, x1, x2):
    df = spark.createDataFrame([(1, float(v)) for v in x1] + [(2, float(v)) for v in x2], "k int, v double")

    def stats(k):
        v = F.when(F.col("k") == k, F.col("v"))
        return [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.var_samp(v).alias(f"v{k}")]

    pair = [F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]
    return df.agg(*stats(1), *stats(2)).select(samples.t_test_p(*pair).alias("p"), samples.cohen_d(*pair).alias("d")).first()


def test_two_samples(spark):
    r = _test_pair(spark, [1, 2, 3, 4], [3, 4, 5, 6])
    assert r.d == pytest.approx(2 / math.sqrt(5 / 3))
    # t = -2.19089 with 6 degrees of freedom
    assert r.p == pytest.approx(0.070986, abs=1e-5)
    back = _test_pair(spark, [3, 4, 5, 6], [1, 2, 3, 4])
    assert back.d == pytest.approx(-r.d) and back.p == pytest.approx(r.p)


def test_two_samples_without_enough_values_or_spread(spark):
    assert tuple(_test_pair(spark, [1], [2, 3])) == (None, None)
    assert tuple(_test_pair(spark, [2, 2], [3, 3])) == (0.0, 0.0)
    assert tuple(_test_pair(spark, [2, 2], [2, 2])) == (None, 0.0)


def test_merged_moments_keep_precision(spark):
    from pyspark.sql import Window as W

    random.seed(5)
    values = [1e8 + random.random() for _ in range(300)]
    df = spark.createDataFrame([("g", i % 7, v) for i, v in enumerate(values)], "g string, part int, x double")
    parts = df.groupBy("g", "part").agg(*samples.moment_columns("x", "x"))
    row = (
        parts.withColumns(samples.merged("x", W.partitionBy("g")))
        .groupBy("g")
        .agg(samples.merged_mean("x").alias("m"), samples.merged_variance("x").alias("v"))
        .first()
    )
    assert row.m == pytest.approx(statistics.fmean(values), rel=1e-15)
    assert row.v == pytest.approx(statistics.variance(values), rel=1e-6)


def test_finite_and_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r.x for r in numeric.finite_columns(df).collect()] == [None, None, None, 1.5, None]
    text = spark.createDataFrame([(v,) for v in ["1.5", " 2 ", "x", "", "inf", "NaN", "1d", "1e3", None]], "x string")
    assert [r[0] for r in text.select(numeric.to_number(F.col("x"))).collect()] == [1.5, 2.0, None, None, None, None, None, 1000.0, None]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(numeric.half_even(F.col("x"), 0)).collect()] == [0.0, 2.0, 2.0, -2.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=60))
def test_grouped_median_is_exact(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    want = {g: statistics.median([float(v) for h, v in rows if h == g]) for g, _ in rows}
    assert {r.g: r.median for r in ordered.grouped_median(df, ["g"], "v").collect()} == want


def test_grouped_median_with_a_hot_value_and_many_rows(spark):
    df = spark.range(30000).select(
        (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(500.0)).otherwise((F.col("id") * 7919 % 10007).cast("double")).alias("v")
    )
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.median for r in ordered.grouped_median(df, ["g"], "v").collect()} == want


def test_positions_across_hours_and_for_dates(spark):
    random.seed(1)
    base = datetime(2024, 1, 1)
    rows = [(k, base + timedelta(minutes=m), 1.0 if m % 2 else None) for k in "xy" for m in random.sample(range(5000), 80)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    for frame in (df, df.groupBy("k", F.to_date("ts").alias("ts")).agg(F.max("v").alias("v"))):
        got = {(r.k, r.ts): (r.pos, r.n_points, r.n_values) for r in ordered.with_position(frame, ["k"], "ts", "v").collect()}
        for k in "xy":
            mine = sorted(((r.ts, r.v) for r in frame.collect() if r.k == k), key=lambda p: p[0])
            present = sum(v is not None for _, v in mine)
            assert [got[k, ts] for ts, _ in mine] == [(i, len(mine), present) for i in range(len(mine))]
