from __future__ import annotations

import math
import random
from datetime import date

import pytest
from helpers import by, one, sprint, sprints

from motionlake.operators import asymmetry, athletes, forecast, loads, sessions, similarity, teams


def test_velocity_decrement_uses_the_lightest_load_of_the_same_day(spark):
    df = sprints(spark, [
        sprint(day=0, rep=0, speed=8, load=0), sprint(day=0, rep=1, speed=10, load=0), sprint(day=0, rep=2, speed=6, load=20),
        sprint(day=1, rep=3, speed=7, load=20), sprint("b", speed=5, load=None), sprint("b", rep=1, speed=4, load=10),
    ])
    rows = by(sessions.velocity_decrement(df), "client", "session_date", "top_speed")
    day = date(2024, 1, 1)
    assert rows["a", day, 8.0]["velocity_decrement"] == pytest.approx(20)
    assert rows["a", day, 6.0]["velocity_decrement"] == pytest.approx(40)
    assert rows["a", date(2024, 1, 2), 7.0]["velocity_decrement"] is None
    assert rows["b", day, 4.0]["velocity_decrement"] == 0 and rows["b", day, 5.0]["velocity_decrement"] == pytest.approx(-25)
    assert len(rows) == 6


def test_session_stats_and_summary(spark):
    df = sprints(spark, [sprint(speed=8), sprint(rep=1, speed=10, split=None), sprint(day=1, speed=9, split=0.9), sprint(None)])
    rows = by(sessions.session_stats(df), "session_date")
    first = rows[date(2024, 1, 1)]
    assert (first["max_speed"], first["avg_speed"], first["sprints"], first["best_split"]) == (10, 9, 2, 1.0)
    assert first["consistency"] == pytest.approx(math.sqrt(2) / 9 * 100)
    assert rows[date(2024, 1, 2)]["consistency"] is None
    summary = one(sessions.athlete_summary(df), client="a")
    assert summary["sessions"] == 2 and summary["best_split"] == 0.9


def test_trend_line_squeezes_out_missing_sessions(spark):
    splits = [1.0, None, 2.0, 3.0]
    df = sprints(spark, [sprint(day=d, split=s, speed=8) for d, s in enumerate(splits)] + [sprint("b")])
    rows = by(sessions.session_trend_lines(df), "client", "metric", "session_index")
    # fitted to (0,1) (1,2) (2,3), read at 0..3
    assert [rows["a", "best_split", i]["trend"] for i in range(4)] == pytest.approx([1, 2, 3, 4])
    assert rows["a", "max_speed", 3]["trend"] == pytest.approx(8)
    assert rows["b", "max_speed", 0]["trend"] is None


def test_first_to_latest_flips_time_metrics(spark):
    df = sprints(spark, [sprint(split=2.0, speed=8), sprint(day=3, split=1.0, speed=6), sprint("b")])
    rows = by(sessions.first_to_latest_change(df), "client", "metric")
    assert rows["a", "best_split"]["change_pct"] == 50 and rows["a", "max_speed"]["change_pct"] == -25
    assert ("b", "max_speed") not in rows


def test_baseline_progression(spark):
    df = sprints(spark, [
        sprint(rep=0, speed=8), sprint(rep=1, speed=9), sprint(day=7, speed=10), sprint(day=7, rep=1, speed=11),
        sprint(day=9, speed=8.5), sprint("b"),
    ])
    progression = sessions.baseline_progression(df)
    rows = by(progression, "client", "days")
    assert set(rows) == {("a", 7), ("a", 9)}
    assert rows["a", 7]["change"] == 2 and rows["a", 7]["improved"] and rows["a", 7]["effect_size"] == pytest.approx(2 / math.sqrt(0.5))
    assert rows["a", 9]["p_value"] is None and not rows["a", 9]["improved"]
    summary = one(sessions.progression_summary(progression), client="a")
    assert (summary["improved_sessions"], summary["later_sessions"], summary["verdict"]) == (1, 2, "Positive")
    assert summary["latest_speed"] == 8.5 and summary["total_gain"] == -0.5


def test_team_periods(spark):
    base, recent = (date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 5), date(2024, 1, 7))
    df = sprints(spark, [
        sprint(day=0, speed=8), sprint(day=0, rep=1, speed=9), sprint(day=2, speed=7), sprint(day=3, speed=99),
        sprint(day=4, speed=10), sprint(day=6, speed=12), sprint("b", day=0), sprint("c", day=5),
    ])
    periods = teams.team_periods(df, base, recent)
    row = one(periods, client="a")
    assert (row["baseline_sprints"], row["baseline_dates"], row["recent_sprints"], row["recent_dates"]) == (3, 2, 2, 2)
    assert row["speed_change"] == 3 and row["speed_change_pct"] == pytest.approx(100 / 3)
    assert row["effect_size"] == pytest.approx(3 / math.sqrt((2 * 1 + 1 * 2) / 3))
    assert periods.count() == 1
    total = teams.team_summary(periods).first()
    assert (total.athletes, total.improved, total.improvement_rate, total.verdict) == (1, 1, 100.0, "Excellent")
    assert teams.team_summary(periods.where("client = 'zz'")).count() == 0
    for bad in [((base[1], base[0]), recent), (base, (recent[1], recent[0])), (base, (base[1], recent[1]))]:
        with pytest.raises(ValueError):
            teams.team_periods(df, *bad)


def test_features_retention_and_filling(spark):
    df = sprints(spark, [
        sprint(rep=0, speed=10, load=0), sprint(rep=1, speed=8, load=0), sprint(rep=2, speed=6.5, load=30),
        sprint("b", speed=7, load=5, split=None), sprint("c", speed=10, load=1), sprint("c", rep=1, speed=5, load=2),
        sprint("d", speed=10, load=None), sprint("d", rep=1, speed=20, load=4),
    ])
    features = loads.athlete_features(df)
    rows = by(features, "client")
    assert rows["a"]["retention"] == 65 and rows["a"]["profile"] == "Balanced"  # exactly 65 is not above it
    assert rows["c"]["retention"] == 50 and rows["c"]["profile"] == "Velocity-Dominant"
    assert rows["b"]["retention"] == 100 and rows["b"]["profile"] is None and rows["b"]["consistency"] is None
    assert rows["d"]["retention"] == 100 and rows["d"]["max_speed"] == 20 and rows["d"]["avg_speed"] == 15
    assert rows["a"]["consistency"] == pytest.approx(1.755942292)
    filled = by(loads.fill_with_means(features), "client")
    known = [rows[c]["consistency"] for c in "acd"]
    assert filled["b"]["consistency"] == pytest.approx(sum(known) / 3) and filled["b"]["best_split"] == 1.0


def test_similar_athletes(spark):
    rows = [("t", 8.0, 7.0, 1.0), ("x", 8.0, 7.0, 1.0), ("y", 9.0, 7.0, 1.0), ("n", 8.0, 7.0, None), ("z", 8.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "client string, max_speed double, avg_speed double, best_split double")
    got = similarity.similar_athletes(df, "t", 4).collect()
    assert [r.client for r in got] == ["x", "y", "z", "n"]
    assert got[0].similarity == 100 and got[1].similarity == pytest.approx(100 / (1 + 1 / math.sqrt(3)))
    assert got[3].similarity is None


@pytest.mark.parametrize(("block", "visitors"), [(2000, 50000), (6, 50000), (9, 5)])
def test_similar_to_each_matches_brute_force(spark, block, visitors):
    rng = random.Random(11)
    rows = [(f"c{i:03d}", round(rng.uniform(5, 9), 2), round(rng.uniform(4, 8), 2), round(rng.uniform(0.9, 1.2), 2)) for i in range(60)]
    rows += [(f"copy{i:02d}", 7.0, 6.0, 1.0) for i in range(40)]  # a hot spot
    rows += [(f"grid{i:02d}", 5.0 + i % 3, 5.0, 1.0) for i in range(9)] + [("far", 100.0, 90.0, 9.0), ("part", 7.0, None, 1.0)]
    df = spark.createDataFrame(rows, "client string, max_speed double, avg_speed double, best_split double")
    whole = [r for r in rows if None not in r]
    want = {}
    for c, *x in whole:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), d) for d, *y in whole if d != c)[:3]
        want[c] = [(d, pytest.approx(100 / (1 + math.sqrt(q) / math.sqrt(3)))) for q, d in near]
    want["part"] = [("c000", None), ("c001", None), ("c002", None)]
    got = {}
    for r in similarity.similar_to_each(df, 3, block, visitors).orderBy("client", "rank").collect():
        got.setdefault(r.client, []).append((r.partner, r.similarity))
    assert got == want


def test_similar_to_each_with_few_complete_athletes(spark):
    rows = [("a", 7.0, 6.0, 1.0), ("b", 7.0, 6.0, 1.0), ("c", None, 6.0, 1.0), ("d", 8.0, 6.0, 1.0), ("e", 8.0, 6.0, None)]
    df = spark.createDataFrame(rows, "client string, max_speed double, avg_speed double, best_split double")
    got = {}
    for r in similarity.similar_to_each(df).orderBy("client", "rank").collect():
        got.setdefault(r.client, []).append((r.rank, r.partner, r.similarity is None))
    assert got["a"] == [(1, "b", False), (2, "d", False), (3, "c", True)] == [(k, n.replace("a", "b"), x) for k, n, x in got["b"]]
    assert got["c"] == [(1, "a", True), (2, "b", True), (3, "d", True)]
    assert got["e"] == [(1, "a", True), (2, "b", True), (3, "c", True)]
    assert [n for _, n, _ in got["d"]] == ["a", "b", "c"]
    for client in "abd":
        assert [n for _, n, _ in got[client]] == [r.client for r in similarity.similar_athletes(df, client).collect()]
    assert similarity.similar_to_each(df.where("client = 'c'")).count() == 0 == similarity.similar_to_each(df.limit(0)).count()


def test_weight_of_tied_reps_does_not_depend_on_layout(spark):
    rows = [sprint(load=10 * (1 + i % 4), weight=95 - i % 9, speed=8 - i % 4) for i in range(60)]
    for n in (1, 3, 11):
        df = sprints(spark, rows).repartition(n)
        assert {r.weight for r in loads.load_power(df).collect()} == {87.0}
        assert {r.weight for r in loads.force_velocity_profiles(df).collect()} == {87.0}


def test_power_and_zones(spark):
    df = sprints(spark, [
        sprint(rep=5, speed=8, accel=4, load=10, weight=90), sprint(rep=1, speed=6, accel=4, load=30, weight=70),
        sprint(rep=2, speed=6, accel=4, load=30, weight=99), sprint(rep=9, speed=4, accel=4, load=80, weight=1),
    ])
    power = by(loads.load_power(df), "load")
    assert power[10.0]["power"] == (70 + 10) * 4 * 8 and power[80.0]["weight"] == 70
    best = loads.optimal_power(df)
    row = one(best, client="a")
    assert row["optimal_load"] == 10 and row["max_power"] == 2560  # 10 kg: 2560, 30 kg: 2400, 80 kg: 2400
    zones = one(loads.training_zones(best), client="a")
    assert (zones["speed_zone_low"], zones["speed_zone_high"]) == (10, 11)
    assert (zones["power_zone_low"], zones["power_zone_high"]) == (10, 12)
    assert (zones["strength_zone_low"], zones["strength_zone_high"]) == (13, 80)
    plan = by(loads.weekly_plan(loads.training_zones(best)), "day")
    assert [plan[d]["load_kg"] for d in ("Monday", "Wednesday", "Friday")] == [10, 11, 13]
    assert plan["Friday"]["rest"] == "4-5 min"


def test_equal_power_takes_the_lightest_load(spark):
    df = sprints(spark, [sprint(speed=8, accel=1, load=0, weight=50), sprint(rep=1, speed=4, accel=1, load=50, weight=50)])
    assert one(loads.optimal_power(df), client="a")["optimal_load"] == 0


def test_force_velocity_profiles_and_shift(spark):
    rows = []
    for day, (v0, slope) in enumerate([(10, -0.1), (10.25, -0.1), (10.5, -0.1), (20, -0.1)]):
        rows += [sprint(day=day, rep=i, speed=v0 + slope * x, load=float(x)) for i, x in enumerate([0, 20, 40])]
    rows += [sprint("rising", speed=5, load=0), sprint("rising", rep=1, speed=6, load=10), sprint("flat", speed=5, load=0),
             sprint("flat", rep=1, speed=5, load=10), sprint("single", speed=5, load=0), sprint("single", rep=1, speed=6, load=0)]
    df = sprints(spark, rows)
    profiles = by(loads.force_velocity_profiles(df), "client", "session_date")
    first = profiles["a", date(2024, 1, 1)]
    assert {c for c, _ in profiles} == {"a"}
    assert first["v0"] == pytest.approx(10) and first["f0_load"] == pytest.approx(100) and first["n_points"] == 3
    assert first["f0_newtons"] == pytest.approx(180 * 9.81) and first["pmax"] == pytest.approx(180 * 9.81 * 10 / 4)
    assert first["r_squared"] == pytest.approx(1)
    sessions_ = by(loads.profile_sessions(df), "client", "session_date")
    assert sessions_["a", date(2024, 1, 1)]["load_range"] == "0-40 kg" and ("single", date(2024, 1, 1)) not in sessions_
    shift = one(loads.profile_shift(df), client="a")
    assert shift["profiles"] == 3 and shift["last_date"] == date(2024, 1, 3)  # the fourth session is not selected
    assert shift["v0_change_pct"] == pytest.approx(5) and shift["shift"] == "Overall Improvement"
    assert shift["notes"] == ["Velocity capability improved", "Power output increased"]


def test_dominance_thresholds(spark):
    df = sprints(spark, [
        sprint("7.0", speed=7.0), sprint("8.5", speed=8.5), sprint("fast", speed=8.6), sprint("slow", speed=6.9),
        sprint("none", split=None),
    ])
    rows = by(athletes.acceleration_dominance(df), "client")
    assert [rows[c]["profile"] for c in ("7.0", "8.5", "fast", "slow", "none")] == [
        "Balanced", "Balanced", "Top Speed Dominant", "Acceleration Dominant", "Balanced",
    ]
    assert (rows["fast"]["speed_contribution"], rows["fast"]["accel_contribution"]) == (60, 40)


def test_eccentric_capacity_gate_and_bands(spark):
    def athlete(name, n, con, ecc):
        return [sprint(name, rep=i, load=con, ecc=ecc) for i in range(n)]

    df = sprints(spark, athlete("four", 4, 10, 20) + athlete("1.4", 5, 10, 14) + athlete("1.2", 5, 10, 12)
                 + athlete("1.0", 5, 10, 10) + athlete("low", 5, 10, 9) + athlete("zero", 5, 0, 9) + athlete("big", 5, 10, 15))
    rows = by(athletes.eccentric_capacity(df), "client")
    assert "four" not in rows and rows["zero"]["ratio"] == 0
    assert [rows[c]["capacity"] for c in ("big", "1.4", "1.2", "1.0", "low")] == [
        "Excellent", "Good", "Developing", "Developing", "Needs Development",
    ]


def test_power_endurance(spark):
    def session(name, speeds):
        return [sprint(name, rep=len(speeds) - i, speed=s) for i, s in enumerate(reversed(speeds))]

    df = sprints(spark, session("five", [9] * 5) + session("six", [10, 10, 10, 9.7, 9.7, 9.7]) + session("more", [10, 10, 10, 1, 9, 9, 9])
                 + session("up", [9, 9, 9, 10, 10, 10]))
    rows = by(athletes.power_endurance(df), "client")
    assert "five" not in rows
    assert rows["six"]["decrement"] == pytest.approx(3) and rows["six"]["reps"] == 6
    assert rows["more"]["decrement"] == pytest.approx(10) and rows["more"]["endurance"] == "Poor"
    assert rows["up"]["endurance"] == "Excellent" and rows["up"]["decrement"] < 0


def test_injury_risk(spark):
    rows = [sprint("risky", day=d, rep=d, speed=s, side="Left") for d, s in enumerate([10, 10, 10, 8, 8, 8])]
    rows += [sprint("risky", day=5, rep=9, speed=7, side="Right")]
    rows += [sprint("calm", day=d, rep=d, speed=9) for d in range(6)]
    rows += [sprint("short", day=d, rep=d, speed=s) for d, s in enumerate([10, 10, 10, 10, 9.9])]
    got = by(athletes.injury_risk(sprints(spark, rows)), "client")
    risky = got["risky"]
    assert risky["risk_score"] == 100 and risky["risk_level"] == "High"
    assert risky["risk_factors"][0] == "High asymmetry: 30.0%" and risky["risk_factors"][1] == "Recent speed drop: 20.0%"
    assert got["calm"]["risk_score"] == 0 and got["calm"]["risk_factors"] == []
    assert got["calm"]["recommendation"] == "Continue current training program"
    assert got["short"]["speed_drop"] is None and got["short"]["risk_level"] == "Low"


def test_asymmetry(spark):
    df = sprints(spark, [
        sprint("a", speed=10, accel=5, split=1.0, side="Left", load=5), sprint("a", rep=1, speed=9.5, accel=4.5, split=1.1, side="Right", load=5),
        sprint("a", rep=2, speed=7, side="Right", load=6), sprint("one", side="Left"), sprint("third", side="Left"),
        sprint("third", side="Both"), sprint("null", side=None),
    ])
    simple = by(asymmetry.simple_asymmetry(df), "client")
    assert set(simple) == {"a"}
    assert simple["a"]["speed_asymmetry"] == pytest.approx(5) and simple["a"]["risk_level"] == "Moderate"
    assert simple["a"]["accel_asymmetry"] == 0  # the default acceleration of the third rep equals the left one
    assert [r.client for r in asymmetry.sided_athletes(df).collect()] == ["a"]
    signed = by(asymmetry.signed_asymmetry(df), "metric")
    assert signed["top_speed"]["asymmetry"] == pytest.approx(0.5 / 9.75 * 100) and signed["top_speed"]["dominant"] == "Left"
    assert signed["split_5"]["asymmetry"] == 0 and signed["split_5"]["dominant"] == "Balanced"
    assert (signed["top_speed"]["left_count"], signed["top_speed"]["right_count"]) == (1, 2)
    matched = asymmetry.load_matched_asymmetry(df).collect()
    assert [(r.load, r.left_speed, r.right_speed) for r in matched] == [(5.0, 10.0, 9.5)]
    assert one(asymmetry.action_tier(asymmetry.signed_asymmetry(df)), client="a")["tier"] == "moderate"


def test_time_asymmetry_favours_the_faster_side_and_swaps_sign(spark):
    def pair(left, right):
        return sprints(spark, [sprint(split=left, side="Left"), sprint(rep=1, split=right, side="Right")])

    a = by(asymmetry.signed_asymmetry(pair(1.0, 1.2)), "metric")["split_5"]
    b = by(asymmetry.signed_asymmetry(pair(1.2, 1.0)), "metric")["split_5"]
    assert a["dominant"] == "Left" and a["asymmetry"] == pytest.approx(-b["asymmetry"]) and a["asymmetry"] > 0


def test_asymmetry_direction_needs_three_sessions(spark):
    def day(client, d, left, right):
        return [sprint(client, day=d, speed=left, side="Left"), sprint(client, day=d, rep=1, speed=right, side="Right")]

    rows = day("a", 0, 10, 9) + day("a", 1, 10, 5) + day("a", 2, 10, 10) + day("b", 0, 10, 9) + day("b", 1, 10, 10)
    rows += day("c", 0, 10, 10) + day("c", 1, 10, 10) + day("c", 2, 10, 9)
    got = by(asymmetry.asymmetry_direction(asymmetry.asymmetry_trend(sprints(spark, rows))), "client")
    assert {c: r["direction"] for c, r in got.items()} == {"a": "improving", "c": "worsening"}


def _forecast_by_hand(days, speeds):
    smooth = [speeds[0]]
    for s in speeds[1:]:
        smooth.append(0.3 * s + 0.7 * smooth[-1])
    x, y = days[-5:], smooth[-5:]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    rate = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    last = speeds[-1]
    out = {d: min(max(smooth[-1] + rate * d * (1 - d / 100), last * 0.95), last * 1.05) for d in (7, 14, 30)}
    tail = speeds[-5:]
    mean = sum(tail) / len(tail)
    std = math.sqrt(sum((s - mean) ** 2 for s in tail) / len(tail))
    return smooth[-1], rate, out, std


def test_forecast_matches_the_recursion(spark):
    series = {
        "long": ([0, 3, 4, 9, 12, 20, 31], [8.0, 8.2, 8.1, 8.4, 8.3, 8.6, 8.9]),
        "three": ([0, 5, 6], [9.0, 8.0, 8.5]),
        "even": ([0, 1, 2, 3], [7.0, 7.0, 7.0, 7.0]),
        "two": ([0, 1], [7.0, 8.0]),
    }
    rows = [sprint(c, day=d, speed=s) for c, (days, speeds) in series.items() for d, s in zip(days, speeds, strict=True)]
    rows.append(sprint("long", day=31, rep=1, speed=1.0))  # not the day's best
    got = by(forecast.speed_forecast(sprints(spark, rows)), "client")
    assert "two" not in got
    for client in ("long", "three", "even"):
        smooth, rate, out, std = _forecast_by_hand(*series[client])
        row = got[client]
        assert row["smoothed_speed"] == pytest.approx(smooth) and row["trend_rate"] == pytest.approx(rate, abs=1e-12)
        for d, value in out.items():
            assert row[f"predicted_{d}d"] == pytest.approx(value)
        assert row["consistency"] == ("high" if std < 0.1 else "moderate" if std < 0.2 else "low")
    assert (got["even"]["trend"], got["even"]["confidence"]) == ("Stable", "High")
    assert (got["long"]["trend"], got["long"]["confidence"]) == ("Improving", "Moderate")
