from __future__ import annotations

import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from helpers import MEASURES, by, measures, one
from pyspark.sql import functions as F

from motionlake.functions import folding, rules
from motionlake.operators import profiles, quality, selection, trends


def names(spark, *metrics):
    return spark.createDataFrame([(m,) for m in metrics], "metric string")


def test_test_types(spark):
    df = spark.createDataFrame([("SJ", "x"), ("CMJ", "y"), (None, "z")], "test_type string, metric string")
    assert [r[0] for r in selection.test_types(df).collect()] == ["CMJ", "SJ"]
    assert [r[0] for r in selection.test_types(names(spark, "cmj height", "DJ RSI", "Jump Height", "x")).collect()] == ["CMJ", "DJ", "JUMP"]
    assert [r[0] for r in selection.test_types(names(spark, "Force")).collect()] == ["All Jumps"]
    jumps = df.withColumnRenamed("test_type", "jump_type")
    assert [r[0] for r in selection.test_types(jumps).collect()] == ["CMJ", "SJ"]


def test_type_filter(spark):
    df = spark.createDataFrame([("SJ", "x"), ("CMJ", "cmj y")], "test_type string, metric string")
    assert selection.of_test_type(df, "All Jumps").count() == 2
    assert [r.metric for r in selection.of_test_type(df, "SJ").collect()] == ["x"]
    assert [r.metric for r in selection.of_test_type(df.drop("test_type"), "CM.").collect()] == ["cmj y"]


def test_dates_are_inclusive(spark):
    rows = [("a", "m", 1.0, datetime(2024, 1, 1) + timedelta(hours=h)) for h in (-1, 0, 47, 48)]
    df = spark.createDataFrame(rows, MEASURES)
    assert selection.in_dates(df, date(2024, 1, 1), date(2024, 1, 2)).count() == 2


def test_members_by_list_and_table(spark):
    df = measures(spark, [("a", "m", 1, 0), ("b", "m", 2, 0), ("c", "m", 3, 0)])
    assert {r.entity for r in selection.members(df, "entity", ["a", "c"]).collect()} == {"a", "c"}
    many = ["a"] + [f"x{i}" for i in range(selection.INLINE_LIMIT)]
    assert {r.entity for r in selection.members(df, "entity", many).collect()} == {"a"}
    twice = spark.createDataFrame([("b",), ("b",)], "entity string")
    assert [r.entity for r in selection.members(df, "entity", twice).collect()] == ["b"]


def test_search(spark):
    df = names(spark, "Peak Power", "Peak Force", "Mean Power", "L|R Time", None)
    got = {r[0] for r in selection.search_metrics(df, "peak", "Power & Force").collect()}
    assert got == {"Peak Power", "Peak Force"}
    assert {r[0] for r in selection.search_metrics(df, "", "Asymmetry").collect()} == {"L|R Time"}
    assert selection.search_metrics(df).count() == 5


def test_categories_and_families(spark):
    df = names(spark, "Braking RFD", "Peak Braking Force", "Force RFD", "L|R Landing", "x", None)
    got = {}
    for r in selection.metric_categories(df).collect():
        got.setdefault(r.metric, []).append(r.category)
    assert got == {
        "Braking RFD": ["rfd"], "Peak Braking Force": ["force", "braking"], "Force RFD": ["rfd"], "L|R Landing": ["landing", "asymmetry"],
    }
    counts = {r.category: r.metrics for r in selection.category_counts(df).collect()}
    assert len(counts) == len(rules.CATEGORIES) and counts["rfd"] == 2 and counts["power"] == 0
    families = {}
    for r in selection.metric_families(names(spark, "RESULT_TYPE", "result_type", "RELATIVE_POWER", "RSI_MODIFIED")).collect():
        families.setdefault(r.metric, []).append(r.family)
    assert "RESULT_TYPE" not in families
    assert families["result_type"] == ["All Performance Metrics"]
    assert families["RELATIVE_POWER"] == ["All Performance Metrics", "Power Output"]
    assert families["RSI_MODIFIED"] == ["All Performance Metrics", "Jump Mechanics", "Ratios & Performance Indices"]


def test_chosen_metrics_keep_first_occurrence(spark):
    df = spark.createDataFrame(
        [("Jump Power", 100.0), ("Jump B", 100.0), ("Jump A", 50.0), ("Power Z", None)], "metric string, completeness_pct double"
    )
    got = selection.chosen_metrics(df, ["power", "jump"], 3).collect()
    assert [(r.metric, r.category_position) for r in got] == [("Jump Power", 1), ("Power Z", 1), ("Jump B", 2)]


def test_profile_and_gate(spark):
    rows = [(e, f"m{i}", v, d) for i in range(4) for e, v, d in (("a", 1, 0), ("b", 3, 1))]
    rows += [("a", "lonely", 5, 0), ("a", "empty", None, 0), ("a", "gappy", 0, 0), ("b", "gappy", None, 0)]
    profile = quality.metric_profile(measures(spark, rows))
    got = by(profile, "metric")
    assert got["m0"]["cv"] == pytest.approx(math.sqrt(2) / 2) and got["m0"]["entities"] == 2
    assert got["gappy"]["cv"] == 0 and got["gappy"]["completeness_pct"] == 100 and got["gappy"]["row_completeness_pct"] == 50
    assert got["empty"]["completeness_pct"] is None and got["lonely"]["cv"] == 0
    # gappy has rows of two entities, so five metrics pass the strict gate
    assert {r.metric for r in quality.available_metrics(profile).collect()} == {"m0", "m1", "m2", "m3", "gappy"}
    few = quality.metric_profile(measures(spark, [r for r in rows if r[1] not in ("m0", "m1")]))
    assert {r.metric for r in quality.available_metrics(few).collect()} == {"m2", "m3", "gappy", "lonely"}


def test_coverage(spark):
    df = measures(spark, [("a", "x", 1, 0), ("a", "x", None, 1), ("a", "y", 2, 0), ("b", "z", 2, 0), ("b", "z", 2, 1), ("b", "z", 2, 3)])
    listed = names(spark, "x", "q", "r")
    scores = quality.coverage_scores(df, listed)
    got = by(scores, "entity")
    assert got["a"]["coverage_pct"] == 66.7 and got["a"]["avg_points_per_metric"] == 1.5 and got["b"]["coverage_pct"] == 33.3
    total = quality.coverage_rollup(scores, listed).first()
    assert total.low_coverage_entities == 1 and total.overall_completeness == 100
    wide = by(quality.completeness_matrix(df, ["x", "q"]), "entity")
    assert (wide["a"]["x"], wide["a"]["q"], wide["b"]["x"]) == (1, 0, 0)
    summary = quality.load_summary(df).first()
    assert (summary.rows, summary.entities, summary.metrics, summary.training_days) == (6, 2, 3, 3)


def test_trend_report(spark):
    random.seed(3)
    noisy = [random.gauss(10 + i / 3, 1) for i in range(20)]
    series = {
        "noisy": noisy, "line": [1, 2, 3, 4], "flat": [5, 5, 5, 5], "two": [4, 2], "zero": [0, 5, 1], "one": [3], "hole": [1, None, 3, 4],
        "negative": [-10, -5, -8],
    }
    rows = [("e", m, v, d) for m, values in series.items() for d, v in enumerate(values)]
    rows.append(("e", "two", 6, 0))  # averaged into the first point
    df = measures(spark, rows)
    got = by(trends.improvement_report(df), "metric")
    assert "one" not in got
    assert got["two"]["improvement_pct"] == -60 and got["two"]["significance"] == "N/A" and got["two"]["effect_size"] is None
    assert got["zero"]["improvement_pct"] == 0 and got["negative"]["improvement_pct"] == pytest.approx(20)
    assert got["line"]["p_value"] == pytest.approx(0, abs=1e-12) and got["line"]["significance"] == "***"
    assert got["line"]["effect_size"] == pytest.approx(2 / math.sqrt(0.5))
    assert got["flat"]["p_value"] == 1 and got["flat"]["significance"] == "ns" and got["flat"]["effect_size"] is None
    assert got["hole"]["data_points"] == 4 and got["hole"]["p_value"] is None and got["hole"]["significance"] == "ns"
    x = list(range(20))
    mx, my = statistics.fmean(x), statistics.fmean(noisy)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, noisy, strict=True))
    sxx, syy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in noisy)
    r = sxy / math.sqrt(sxx * syy)
    t = r * math.sqrt(18 / (1 - r * r))
    cos2 = 18 / (18 + t * t)
    term, total = 1.0, 1.0
    for j in range(1, 9):
        term *= cos2 * (2 * j - 1) / (2 * j)
        total += term
    assert got["noisy"]["p_value"] == pytest.approx(1 - math.sqrt(1 - cos2) * total, abs=1e-13)
    a, b = noisy[:10], noisy[10:]
    d = (statistics.fmean(b) - statistics.fmean(a)) / math.sqrt((statistics.variance(a) + statistics.variance(b)) / 2)
    assert got["noisy"]["effect_size"] == pytest.approx(d)
    assert by(trends.first_to_last(df), "metric")["two"]["improvement_pct"] == -60


def test_leaders(spark):
    report = spark.createDataFrame([(f"e{i}", "m", float(v)) for i, v in enumerate([5, -3, 0, 9, -7, 2, -1])], "entity string, metric string, improvement_pct double")
    rows = trends.improvement_leaders(report, 4).collect()
    assert [r.entity for r in rows if r.board == "top"] == ["e3", "e0", "e5"]
    assert {r.entity for r in rows if r.board == "bottom"} == {"e4", "e1", "e6"}
    wide = by(trends.improvement_matrix(report, ["m", "none"]), "entity")
    assert wide["e3"]["m"] == 9 and wide["e3"]["none"] is None


def test_profiles(spark):
    df = measures(spark, [
        ("a", "x", 1, 0), ("a", "x", 3, 1), ("b", "x", 8, 0), ("a", "flat", 2, 0), ("b", "flat", 2, 0), ("c", "own", 4, 0),
        ("d", "x", 1000, 0),
    ])
    got = by(profiles.entity_profiles(df, ["a", "b", "c"]), "entity", "metric")
    std = statistics.stdev([1, 3, 8])
    assert got["a", "x"]["z_score"] == pytest.approx(round((2 - 4) / std, 2))
    assert got["a", "x"]["percentile"] == pytest.approx(round(50 * math.erfc(-(2 - 4) / std / math.sqrt(2)), 1))
    assert got["a", "flat"]["z_score"] == 0 and got["a", "flat"]["percentile"] == 50
    assert got["c", "own"]["z_score"] == 0  # one row: no spread
    assert got["d", "x"]["z_score"] > 100 and got["d", "x"]["percentile"] == 100  # measured against the group, not part of it
    summary = by(profiles.profile_summary(profiles.entity_profiles(df)), "entity")
    assert summary["a"]["metrics"] == 2


def test_strengths_overlap_with_few_metrics(spark):
    rows = [("a", f"m{i}", float(z)) for i, z in enumerate([3, 1, 1, -2, 0, -1, 2])]
    df = spark.createDataFrame(rows, "entity string, metric string, z_score double")
    got = profiles.strengths_and_weaknesses(df).collect()
    assert [r.metric for r in sorted((r for r in got if r.kind == "strength"), key=lambda r: r.rank)] == ["m0", "m6", "m1", "m2", "m4"]
    assert {r.metric for r in got if r.kind == "weakness"} == {"m1", "m2", "m4", "m5", "m3"}


def test_head_to_head(spark):
    df = measures(spark, [
        ("a", "x", 3, 0), ("b", "x", 2, 0), ("a", "tie", 5, 0), ("b", "tie", 5, 0), ("a", "zero", 1, 0), ("b", "zero", 0, 0),
        ("a", "only", 1, 0), ("a", "none", None, 0), ("b", "none", 4, 0),
    ])
    pairs = spark.createDataFrame([("a", "b")], "first string, second string")
    comparison = profiles.head_to_head(df, pairs)
    got = by(comparison, "metric")
    assert set(got) == {"x", "tie", "zero", "none"}
    assert got["x"]["difference_pct"] == 50 and got["x"]["winner"] == "a" and got["tie"]["winner"] == "b"
    assert got["zero"]["difference_pct"] == 0 and got["zero"]["winner"] == "a" and got["none"]["winner"] == "b"
    radar = by(profiles.radar_values(comparison), "metric")
    assert (radar["x"]["first_radar"], radar["x"]["second_radar"], radar["tie"]["first_radar"]) == (100, 20, 60)
    tally = profiles.win_tally(comparison).first()
    assert (tally.first_wins, tally.second_wins) == (2, 2)
    summary = profiles.run_summary(df, quality.available_metrics(quality.metric_profile(df))).first()
    assert (summary.entities, summary.rows, summary.period, summary.clusters) == (2, 9, "2024-2024", None)


def test_one_row_helper(spark):
    assert one(measures(spark, [("a", "x", 1, 0)]), entity="a")["value"] == 1


def _partitionings(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def _odd_measures(spark):
    rows = [("a", "x", 1, 0), ("a", "x", 3, 0), ("a", "x", None, 1), ("a", "x", 5, 4), ("a", "y", None, 0), ("a", "y", 2, 2), ("b", "y", 4, 0), ("b", "y", 1, 3)]
    rows += [("b", "z", None, 1), ("b", "z", None, 2), (None, "x", 9, 0), ("c", None, 9, 0)]
    return measures(spark, rows)


def test_few_metrics_travel_in_one_row(spark, monkeypatch):
    """F3, F5 to F8, F10: each measure used to travel on its own, with its metric, through every exchange."""
    df = _odd_measures(spark)
    daily = df.withColumn("test_ts", F.to_date("test_ts"))
    operators = {
        "points": lambda: trends.points_over_time(df),
        "ends": lambda: trends.first_to_last(df),
        "report": lambda: trends.improvement_report(daily),
    }
    folded = {name: (sorted(map(str, made().collect())), made().schema.names) for name, made in operators.items()}
    for made in operators.values():
        exchanges = _partitionings(made())
        assert exchanges and not any("metric" in line.split("), ")[0] for line in exchanges), exchanges
    monkeypatch.setattr("motionlake.operators.trends.few_metrics", lambda _: None)
    plain = {name: (sorted(map(str, made().collect())), made().schema.names) for name, made in operators.items()}
    assert folded == plain
    assert by(trends.points_over_time(df), "entity", "metric", "test_ts")[("a", "x", datetime(2024, 1, 1))]["value"] == 2
    assert len(folded["points"][0]) == 9 and len(folded["ends"][0]) == 4


def test_many_metrics_stay_long(spark):
    df = measures(spark, [("a", f"m{i}", i, d) for i in range(folding.WIDEST + 1) for d in (0, 1)])
    assert folding.few_metrics(df) is None and folding.few_metrics(df.where("metric is null")) is None
    assert len(folding.few_metrics(df.where("metric <> 'm0'"))) == folding.WIDEST
    assert trends.first_to_last(df).count() == folding.WIDEST + 1
    few = df.where("metric <> 'm0'")
    assert {r.metric: r.first_value for r in trends.first_to_last(few).collect()} == {f"m{i}": float(i) for i in range(1, folding.WIDEST + 1)}
