"""Queries on the sprint view."""

from __future__ import annotations

from datetime import date

from ..operators import asymmetry, athletes, forecast, loads, sessions, similarity, teams
from .registry import query
from .sql_parts import retention_label, risk, t_test
from .views import REP_ORDER, Tables

BASELINE = (date(1995, 1, 1), date(1997, 12, 31))
RECENT = (date(1999, 1, 1), date(2001, 12, 31))


@query(
    "a18_velocity_decrement",
    sql="""
    with lightest as (select client as c, min(load) as min_load from sprints group by client),
    best as (
      select s.client, s.session_date, max(s.top_speed) as best
      from sprints s join lightest l on s.client = l.c and s.load = l.min_load group by all)
    select s.client, s.session_date, s.set_id, s.set_no, s.drill_id, s.load, s.top_speed,
           (b.best - s.top_speed) / b.best * 100 as velocity_decrement
    from sprints s left join best b on s.client = b.client and s.session_date = b.session_date
    """,
    top_speed=6,
    velocity_decrement=6,
)
def _(t: Tables):
    return sessions.velocity_decrement(t.sprints).select(
        "client", "session_date", "set_id", "set_no", "drill_id", "load", "top_speed", "velocity_decrement"
    )


@query(
    "g02_session_stats",
    sql="""
    select client, session_date, max(top_speed) as max_speed, avg(top_speed) as avg_speed,
           min(split_5) as best_split, avg(split_5) as avg_split, max(max_accel) as max_acceleration,
           stddev_samp(top_speed) / avg(top_speed) * 100 as consistency, count(*) as sprints,
           count(top_speed) as n_speeds, var_samp(top_speed) as speed_var
    from sprints group by client, session_date
    """,
    max_speed=6, avg_speed=6, best_split=6, avg_split=6, max_acceleration=6, consistency=5, speed_var=1,
)
def _(t: Tables):
    return sessions.session_stats(t.sprints)


@query(
    "g03_athlete_summary",
    sql="""
    select client, max(top_speed) as max_speed, avg(top_speed) as avg_speed, min(split_5) as best_split,
           stddev_samp(top_speed) / avg(top_speed) * 100 as consistency, count(distinct session_date) as sessions
    from sprints group by client
    """,
    max_speed=6, avg_speed=6, best_split=6, consistency=6,
)
def _(t: Tables):
    return sessions.athlete_summary(t.sprints)


@query(
    "g04_session_progress",
    sql="""
    select client, session_date, max(top_speed) as max_speed, min(split_5) as best_split,
           max(max_accel) as max_acceleration from sprints group by client, session_date
    """,
    max_speed=6, best_split=6, max_acceleration=6,
)
def _(t: Tables):
    return sessions.session_progress(t.sprints)


_PROGRESS_LONG = """
    progress as (
      select client, session_date, max(top_speed) as max_speed, min(split_5) as best_split,
             max(max_accel) as max_acceleration from sprints group by client, session_date),
    long as (
      select client, session_date, 'max_speed' as metric, max_speed as value from progress
      union all select client, session_date, 'best_split', best_split from progress
      union all select client, session_date, 'max_acceleration', max_acceleration from progress)
"""


@query(
    "g05_session_trend_lines",
    sql=f"""
    with {_PROGRESS_LONG},
    placed as (
      select *, cast(row_number() over (partition by client, metric order by session_date) - 1 as int) as session_index from long),
    sums as (
      select client, metric, count(*) as n, avg(session_index) as mx, avg(value) as my,
             avg(session_index * value) as mxy, avg(session_index * session_index) as mxx
      from placed group by client, metric),
    line as (select *, (mxy - mx * my) / (mxx - mx * mx) as slope from sums where n >= 2)
    select p.client, p.session_date, p.metric, p.value, p.session_index,
           l.my + l.slope * (p.session_index - l.mx) as trend
    from placed p left join line l on p.client = l.client and p.metric = l.metric
    """,
    value=6, trend=4,
)
def _(t: Tables):
    return sessions.session_trend_lines(t.sprints)


@query(
    "g06_first_to_latest_change",
    sql=f"""
    with {_PROGRESS_LONG},
    ends as (
      select client, metric, first(value order by session_date) as first_value,
             last(value order by session_date) as latest_value, count(*) as sessions
      from long group by client, metric having count(*) >= 2)
    select *, case when metric = 'best_split' then -1 else 1 end * (latest_value - first_value) / first_value * 100 as change_pct
    from ends
    """,
    first_value=6, latest_value=6, change_pct=6,
)
def _(t: Tables):
    return sessions.first_to_latest_change(t.sprints)


_P_BASE, _D_BASE = t_test("b", "s")
_PROGRESSION = f"""
    stat as (
      select client, session_date, max(top_speed) as s_max, count(*) as s_n, avg(top_speed) as s_mean,
             var_samp(top_speed) as s_var from sprints group by client, session_date),
    base as (
      select client, session_date as baseline_date, s_max as b_max, s_n as b_n, s_mean as b_mean, s_var as b_var
      from stat qualify row_number() over (partition by client order by session_date) = 1),
    progression as (
      select s.client, s.session_date, b.baseline_date, cast(s.session_date - b.baseline_date as int) as days,
             s_max as max_speed, s_max - b_max as change, (s_max - b_max) / b_max * 100 as change_pct,
             {_P_BASE} as p_value, {_D_BASE} as effect_size, s_max - b_max > 0 as improved
      from stat s join base b on s.client = b.client and s.session_date > b.baseline_date)
"""


@query(
    "g07_baseline_progression",
    sql=f"with {_PROGRESSION} select * from progression",
    max_speed=6, change=6, change_pct=6, p_value=6, effect_size=4,
)
def _(t: Tables):
    return sessions.baseline_progression(t.sprints)


@query(
    "g08_progression_summary",
    sql=f"""
    with {_PROGRESSION},
    summary as (
      select client, count(*) filter (where improved) as improved_sessions, count(*) as later_sessions,
             avg(change_pct) as avg_change_pct, last(max_speed order by session_date) as latest_speed,
             last(change order by session_date) as total_gain
      from progression group by client)
    select *, case when improved_sessions >= 0.75 * later_sessions then 'Excellent'
                   when improved_sessions >= 0.5 * later_sessions then 'Positive' else 'Review Needed' end as verdict
    from summary
    """,
    avg_change_pct=5, latest_speed=6, total_gain=6,
)
def _(t: Tables):
    return sessions.progression_summary(sessions.baseline_progression(t.sprints))


_P_TEAM, _D_TEAM = t_test("b", "r")
_IN_B = f"session_date between date '{BASELINE[0]}' and date '{BASELINE[1]}'"
_IN_R = f"session_date between date '{RECENT[0]}' and date '{RECENT[1]}'"
_PERIODS = f"""
    sides as (
      select client,
             count(*) filter (where {_IN_B}) as b_n, count(*) filter (where {_IN_R}) as r_n,
             count(distinct session_date) filter (where {_IN_B}) as baseline_dates,
             count(distinct session_date) filter (where {_IN_R}) as recent_dates,
             max(top_speed) filter (where {_IN_B}) as b_max, max(top_speed) filter (where {_IN_R}) as r_max,
             avg(top_speed) filter (where {_IN_B}) as b_mean, avg(top_speed) filter (where {_IN_R}) as r_mean,
             var_samp(top_speed) filter (where {_IN_B}) as b_var, var_samp(top_speed) filter (where {_IN_R}) as r_var
      from sprints group by client),
    periods as (
      select client, b_n as baseline_sprints, r_n as recent_sprints, baseline_dates, recent_dates,
             b_max as baseline_max, r_max as recent_max, r_max - b_max as speed_change,
             (r_max - b_max) / b_max * 100 as speed_change_pct, {_P_TEAM} as p_value, {_D_TEAM} as effect_size,
             r_max - b_max > 0 as improved
      from sides where b_n > 0 and r_n > 0)
"""


@query(
    "g09_team_periods",
    sql=f"with {_PERIODS} select * from periods",
    baseline_max=6, recent_max=6, speed_change=6, speed_change_pct=6, p_value=6, effect_size=6,
)
def _(t: Tables):
    return teams.team_periods(t.sprints, BASELINE, RECENT)


@query(
    "g01_two_sample_test",
    sql=f"""
    with grouped as (
      select client,
             count(*) filter (where side = 'Left') as b_n, avg(top_speed) filter (where side = 'Left') as b_mean,
             var_samp(top_speed) filter (where side = 'Left') as b_var,
             count(*) filter (where side = 'Right') as r_n, avg(top_speed) filter (where side = 'Right') as r_mean,
             var_samp(top_speed) filter (where side = 'Right') as r_var
      from sprints group by client)
    select client, b_n as n1, r_n as n2, {_P_TEAM} as p_value, {_D_TEAM} as effect_size from grouped
    """,
    p_value=6, effect_size=6,
)
def _(t: Tables):
    from pyspark.sql import functions as F

    from ..functions.samples import cohen_d, t_test_p

    def stats(side: str, k: int):
        value = F.when(F.col("side") == side, F.col("top_speed"))
        return [F.count(value).alias(f"n{k}"), F.avg(value).alias(f"m{k}"), F.var_samp(value).alias(f"v{k}")]

    pair = [F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]
    grouped = sessions.known_clients(t.sprints).groupBy("client").agg(*stats("Left", 1), *stats("Right", 2))
    return grouped.select(
        "client", "n1", "n2", t_test_p(*pair).alias("p_value"), cohen_d(*pair).alias("effect_size")
    )


@query(
    "g10_team_summary",
    sql=f"""
    with {_PERIODS},
    totals as (
      select count(*) as athletes, count(*) filter (where improved) as improved,
             count(*) filter (where p_value < 0.05) as significant,
             avg(baseline_max) as avg_baseline_max, avg(recent_max) as avg_recent_max from periods)
    select *, improved / athletes * 100 as improvement_rate,
           case when improved >= 0.75 * athletes then 'Excellent' when improved >= 0.5 * athletes then 'Good'
                else 'Review' end as verdict
    from totals where athletes > 0
    """,
    avg_baseline_max=6, avg_recent_max=6, improvement_rate=6,
)
def _(t: Tables):
    return teams.team_summary(teams.team_periods(t.sprints, BASELINE, RECENT))


_FEATURES = f"""
    curve as (select client, load, max(top_speed) as best from sprints where load is not null group by client, load),
    ends as (
      select client, count(*) as loads_tested, last(best order by load) / first(best order by load) * 100 as kept
      from curve group by client),
    features as (
      select s.client, max(s.top_speed) as max_speed, avg(s.top_speed) as avg_speed, min(s.split_5) as best_split,
             stddev_samp(s.top_speed) as consistency, any_value(e.loads_tested) as loads_tested,
             case when any_value(e.loads_tested) > 1 then any_value(e.kept) else 100 end as retention,
             case when any_value(e.loads_tested) > 1 then {retention_label('any_value(e.kept)')} end as profile
      from sprints s join ends e on s.client = e.client group by s.client)
"""


@query(
    "h01_athlete_features",
    sql=f"with {_FEATURES} select * exclude (profile) from features",
    max_speed=6, avg_speed=6, best_split=6, consistency=6, retention=6,
)
def _(t: Tables):
    return loads.fill_with_means(loads.athlete_features(t.sprints)).drop("profile")


@query(
    "h05_retention_profile",
    sql=f"with {_FEATURES} select client, retention, profile from features",
    retention=6,
)
def _(t: Tables):
    return loads.athlete_features(t.sprints).select("client", "retention", "profile")


@query(
    "h04_similar_athletes",
    sql=f"""
    with {_FEATURES},
    target as (select * from features where client = 1)
    select f.client, f.max_speed, f.best_split,
           100 / (1 + sqrt((f.max_speed - t.max_speed) ** 2 + (f.avg_speed - t.avg_speed) ** 2
                           + (f.best_split - t.best_split) ** 2) / sqrt(3)) as similarity
    from features f, target t where f.client <> 1
    order by similarity desc nulls last, f.client limit 3
    """,
    similarity=5, max_speed=6, best_split=6,
)
def _(t: Tables):
    return similarity.similar_athletes(loads.athlete_features(t.sprints), target=1)


_SIMILAR_TO_EACH = f"""
    with {_FEATURES},
    gaps as (
      select t.client, f.client as partner, f.max_speed, f.best_split,
             (f.max_speed - t.max_speed) ** 2 + (f.avg_speed - t.avg_speed) ** 2 + (f.best_split - t.best_split) ** 2 as d
      from features t join features f on t.client <> f.client),
    ranked as (select *, cast(row_number() over (partition by client order by d, partner) as int) as rank from gaps)
    select client, rank, partner, 100 / (1 + sqrt(d) / sqrt(3)) as similarity, max_speed, best_split
    from ranked where rank <= 3
"""


@query("h04_similar_to_each", sql=_SIMILAR_TO_EACH, similarity=5, max_speed=6, best_split=6)
def _(t: Tables):
    return similarity.similar_to_each(loads.athlete_features(t.sprints))


@query("h04_similar_to_each_many_cells", sql=_SIMILAR_TO_EACH, similarity=5, max_speed=6, best_split=6)
def _(t: Tables):
    return similarity.similar_to_each(loads.athlete_features(t.sprints), block=8, visitors=25)


@query(
    "h04_similar_to_each_with_gaps",
    sql=f"""
    with {_FEATURES},
    known as (select * replace (case when client % 7 = 0 then null else best_split end as best_split) from features),
    gaps as (
      select t.client, f.client as partner, f.max_speed, f.best_split,
             (f.max_speed - t.max_speed) ** 2 + (f.avg_speed - t.avg_speed) ** 2 + (f.best_split - t.best_split) ** 2 as d
      from known t join known f on t.client <> f.client),
    ranked as (select *, cast(row_number() over (partition by client order by d nulls last, partner) as int) as rank from gaps)
    select client, rank, partner, 100 / (1 + sqrt(d) / sqrt(3)) as similarity, max_speed, best_split
    from ranked where rank <= 3
    """,
    similarity=5, max_speed=6, best_split=6,
)
def _(t: Tables):
    from pyspark.sql import functions as F

    known = loads.athlete_features(t.sprints).withColumn("best_split", F.when(F.col("client") % 7 != 0, F.col("best_split")))
    return similarity.similar_to_each(known)


@query(
    "h06_load_velocity_curve",
    sql=f"""
    with curve as (select client, load, max(top_speed) as best from sprints where load is not null group by client, load),
    sums as (
      select client, count(*) as loads_tested, avg(load) as mx, avg(best) as my,
             sum(load * best) as sxy, sum(load * load) as sxx,
             first(best order by load) as speed_at_min_load,
             last(best order by load) / first(best order by load) * 100 as retention
      from curve group by client having count(*) >= 2),
    line as (select *, (sxy - loads_tested * mx * my) / (sxx - loads_tested * mx * mx) as slope from sums)
    select client, loads_tested, slope, my - slope * mx as intercept, speed_at_min_load, retention,
           {retention_label('retention')} as profile from line
    """,
    slope=4, intercept=4, speed_at_min_load=6, retention=6,
)
def _(t: Tables):
    return loads.load_velocity_curve(t.sprints)


_FIRST_WEIGHT = "first(weight order by rep_ts nulls first, load nulls first, weight nulls first)"
_OPTIMAL = f"""
    weights as (select client, {_FIRST_WEIGHT} as weight from sprints group by client),
    per_load as (
      select s.client, s.load, any_value(w.weight) as weight,
             (any_value(w.weight) + s.load) * avg(s.max_accel) * avg(s.top_speed) as power,
             avg(s.top_speed) as mean_speed, avg(s.max_accel) as mean_accel
      from sprints s join weights w on s.client = w.client where s.load is not null group by s.client, s.load),
    ranked as (
      select *, row_number() over (partition by client order by power desc, load) as k from per_load),
    optimal as (
      select client, max(load) filter (where k = 1) as optimal_load, max(power) as max_power,
             count(*) as loads_tested, min(load) as min_load, max(load) as max_load
      from ranked group by client),
    zones as (
      select *, min_load as speed_zone_low,
             greatest(least(min_load + (max_load - min_load) / 3, 0.7::double * optimal_load), min_load + 1) as speed_zone_high,
             greatest(0.8::double * optimal_load, min_load) as power_zone_low,
             least(1.2::double * optimal_load, max_load) as power_zone_high,
             least(1.3::double * optimal_load, max_load - 5) as strength_zone_low, max_load as strength_zone_high
      from optimal)
"""


@query(
    "h07_optimal_power",
    sql=f"with {_OPTIMAL} select * from optimal",
    max_power=3,
)
def _(t: Tables):
    return loads.optimal_power(t.sprints)


@query(
    "h07_load_power",
    sql=f"""with {_OPTIMAL}
    select client, load, weight, mean_speed, mean_accel, power from per_load""",
    mean_speed=5, mean_accel=5, power=3,
)
def _(t: Tables):
    return loads.load_power(t.sprints)


@query(
    "h08_training_zones",
    sql=f"with {_OPTIMAL} select * from zones",
    max_power=3, speed_zone_high=6, power_zone_low=6, power_zone_high=6, strength_zone_low=6,
)
def _(t: Tables):
    return loads.training_zones(loads.optimal_power(t.sprints))


@query(
    "h09_weekly_plan",
    sql=f"""
    with {_OPTIMAL}
    select client, 'Monday' as day, 'Power' as focus, cast(round_even(optimal_load, 0) as int) as load_kg,
           '6 x 3' as sets, '3-4 min' as rest from zones
    union all select client, 'Wednesday', 'Speed', cast(round_even(speed_zone_high, 0) as int), '4 x 4', '2-3 min' from zones
    union all select client, 'Friday', 'Strength', cast(round_even(strength_zone_low, 0) as int), '5 x 3', '4-5 min' from zones
    """,
)
def _(t: Tables):
    return loads.weekly_plan(loads.training_zones(loads.optimal_power(t.sprints)))


@query(
    "h10_acceleration_dominance",
    sql="""
    with base as (
      select client, min(split_5) as best_split, max(top_speed) as max_speed,
             max(top_speed) / min(split_5) as ratio from sprints group by client)
    select *, case when ratio > 8.5 then 'Top Speed Dominant' when ratio < 7 then 'Acceleration Dominant' else 'Balanced' end as profile,
           case when ratio > 8.5 then 60 when ratio < 7 then 40 else 50 end as speed_contribution,
           case when ratio > 8.5 then 40 when ratio < 7 then 60 else 50 end as accel_contribution
    from base
    """,
    best_split=6, max_speed=6, ratio=6,
)
def _(t: Tables):
    return athletes.acceleration_dominance(t.sprints)


@query(
    "h11_eccentric_capacity",
    sql="""
    with base as (
      select client, count(ecc_load) as rows_with_eccentric, avg(load) as avg_concentric, avg(ecc_load) as avg_eccentric,
             max(ecc_load) as max_eccentric, max(load) as max_concentric
      from sprints group by client having count(ecc_load) >= 5),
    rated as (select *, case when avg_concentric > 0 then avg_eccentric / avg_concentric else 0 end as ratio from base)
    select *, case when ratio > 1.4 then 'Excellent' when ratio > 1.2 then 'Good' when ratio >= 1 then 'Developing'
                   else 'Needs Development' end as capacity from rated
    """,
    avg_concentric=6, avg_eccentric=6, ratio=6,
)
def _(t: Tables):
    return athletes.eccentric_capacity(t.sprints)


@query(
    "h12_power_endurance",
    sql="""
    with ranked as (
      select client, session_date, top_speed,
             row_number() over (partition by client, session_date
                                order by rep_ts, set_id, set_no, drill_id, top_speed) as k,
             count(*) over (partition by client, session_date) as reps
      from sprints),
    ends as (
      select client, session_date, any_value(reps) as reps, avg(top_speed) filter (where k <= 3) as first_avg,
             avg(top_speed) filter (where k > reps - 3) as last_avg
      from ranked where reps >= 6 group by client, session_date),
    rated as (select *, (first_avg - last_avg) / first_avg * 100 as decrement from ends)
    select *, case when decrement < 3 then 'Excellent' when decrement < 5 then 'Good'
                   when decrement < 8 then 'Moderate' else 'Poor' end as endurance from rated
    """,
    first_avg=5, last_avg=5, decrement=5,
)
def _(t: Tables):
    return athletes.power_endurance(t.sprints, REP_ORDER)


@query(
    "h13_injury_risk",
    sql="""
    with whole as (
      select client, max(top_speed) filter (where side = 'Left') as l, max(top_speed) filter (where side = 'Right') as r,
             stddev_samp(top_speed) / avg(top_speed) * 100 as speed_cv from sprints group by client),
    days as (
      select client, max(top_speed) as best, row_number() over (partition by client order by session_date desc) as k
      from sprints group by client, session_date),
    drops as (
      select client, max(best) filter (where k between 4 and 6) as before, max(best) filter (where k <= 3) as recent,
             count(*) as n from days group by client),
    figures as (
      select w.client, abs(l - r) / greatest(l, r) * 100 as gap, speed_cv,
             case when n >= 6 then (before - recent) / before * 100 end as speed_drop
      from whole w join drops d on w.client = d.client),
    scored as (
      select *, case when l_risk = 'High' then 35 when l_risk = 'Moderate' then 20 else 0 end
                + case when speed_drop > 5 then 35 else 0 end + case when speed_cv > 10 then 30 else 0 end as risk_score
      from (select *, """ + risk("gap") + """ as l_risk from figures))
    select client, risk_score,
           case when risk_score >= 50 then 'High' when risk_score >= 25 then 'Moderate' else 'Low' end as risk_level,
           concat_ws('; ', case when l_risk in ('High', 'Moderate') then l_risk || ' asymmetry: ' || format('{:.1f}', gap) || '%' end,
                     case when speed_drop > 5 then 'Recent speed drop: ' || format('{:.1f}', speed_drop) || '%' end,
                     case when speed_cv > 10 then 'High variability: ' || format('{:.1f}', speed_cv) || '% CV' end) as risk_factors,
           case when risk_score >= 50 then 'Reduce training load, focus on corrective exercises'
                when risk_score >= 25 then 'Monitor closely, consider lighter loads'
                else 'Continue current training program' end as recommendation,
           gap as speed_asymmetry, speed_drop, speed_cv
    from scored
    """,
    speed_asymmetry=6, speed_drop=6, speed_cv=6,
)
def _(t: Tables):
    from pyspark.sql import functions as F

    return athletes.injury_risk(t.sprints).withColumn("risk_factors", F.concat_ws("; ", "risk_factors"))


_FV = f"""
    weights as (select client, session_date, {_FIRST_WEIGHT} as weight from sprints group by client, session_date),
    points as (
      select client, session_date, load, max(top_speed) as v from sprints where load is not null
      group by client, session_date, load),
    eligible as (
      select client, session_date, count(distinct load) as n_loads, count(*) as n_sprints,
             min(load) as low, max(load) as high from sprints
      group by client, session_date having count(distinct load) >= 2),
    fits as (
      select p.client, p.session_date, count(*) as n_points, regr_slope(v, load) as slope, regr_intercept(v, load) as v0,
             corr(v, load) ** 2 as r_squared, any_value(w.weight) as weight
      from points p join weights w on p.client = w.client and p.session_date = w.session_date
      group by p.client, p.session_date having count(*) >= 2),
    profiles as (
      select client, session_date, v0, -v0 / slope as f0_load, (weight - v0 / slope) * 9.81::double as f0_newtons,
             (weight - v0 / slope) * 9.81::double * v0 / 4 as pmax, slope, r_squared, weight, n_points
      from fits where slope < 0)
"""


@query(
    "h14_force_velocity_profiles",
    sql=f"with {_FV} select client, session_date, v0, slope, r_squared, weight, n_points from profiles",
    v0=4, slope=4, r_squared=6,
)
def _(t: Tables):
    return loads.force_velocity_profiles(t.sprints).drop("f0_load", "f0_newtons", "pmax")


# a nearly flat line sends its zero crossing to any size, so the derived forces are compared relative to it
@query(
    "h14_force_velocity_limits",
    sql=f"""with {_FV}
    select client, session_date, ln(f0_load) as log_f0_load, ln(f0_newtons) as log_f0, ln(pmax) as log_pmax
    from profiles where v0 > 0""",
    log_f0_load=5, log_f0=5, log_pmax=5,
)
def _(t: Tables):
    from pyspark.sql import functions as F

    return (
        loads.force_velocity_profiles(t.sprints)
        .where("v0 > 0")
        .select(
            "client",
            "session_date",
            F.log("f0_load").alias("log_f0_load"),
            F.log("f0_newtons").alias("log_f0"),
            F.log("pmax").alias("log_pmax"),
        )
    )


@query(
    "h15_profile_sessions",
    sql=f"""with {_FV}
    select client, session_date, n_loads, n_sprints,
           cast(cast(low as int) as varchar) || '-' || cast(cast(high as int) as varchar) || ' kg' as load_range
    from eligible""",
)
def _(t: Tables):
    return loads.profile_sessions(t.sprints)


@query(
    "h16_profile_shift",
    sql=f"""
    with {_FV},
    chosen as (
      select client, session_date from eligible
      qualify row_number() over (partition by client order by session_date) <= 3),
    ends as (
      select p.client, min(p.session_date) as first_date, max(p.session_date) as last_date, count(*) as profiles,
             first(v0 order by p.session_date) as v1, last(v0 order by p.session_date) as v2,
             first(f0_newtons order by p.session_date) as f1, last(f0_newtons order by p.session_date) as f2,
             first(pmax order by p.session_date) as p1, last(pmax order by p.session_date) as p2
      from profiles p join chosen c on p.client = c.client and p.session_date = c.session_date
      group by p.client having count(*) >= 2),
    moved as (
      select *, (v2 - v1) / v1 * 100 as v, (f2 - f1) / f1 * 100 as f, (p2 - p1) / p1 * 100 as p from ends)
    select client, first_date, last_date, profiles, v2 - v1 as v0_change, v as v0_change_pct, f2 - f1 as f0_change,
           f as f0_change_pct, p2 - p1 as pmax_change, p as pmax_change_pct,
           case when v > 2 and f > 2 then 'Overall Improvement' when v > 2 then 'Velocity Shift'
                when f > 2 then 'Force Shift' when v < -2 or f < -2 then 'Declining' else 'Stable' end as shift,
           concat_ws('; ', case when v > 3 then 'Velocity capability improved' end,
                     case when f > 3 then 'Force capability improved' end,
                     case when p > 5 then 'Power output increased' end,
                     case when v < -3 or f < -3 then 'Performance declining' end) as notes
    from moved
    """,
    v0_change=4, v0_change_pct=4, f0_change=2, f0_change_pct=4, pmax_change=1, pmax_change_pct=4,
)
def _(t: Tables):
    from pyspark.sql import functions as F

    return loads.profile_shift(t.sprints).withColumn("notes", F.concat_ws("; ", "notes"))


@query(
    "h17_speed_forecast",
    sql="""
    with daily as (select client, session_date, max(top_speed) as x from sprints group by client, session_date),
    series as (
      select client, list(x order by session_date) as xs,
             list(cast(session_date - date '1900-01-01' as double) order by session_date) as ds, count(*) as n
      from daily group by client having count(*) >= 3),
    ewma as (
      select client, n, xs, ds, unnest(range(greatest(1, n - 4), n + 1)) as i from series),
    points as (
      select client, n, i, ds[i] as d, xs[n] as current_speed,
             list_reduce(list_slice(xs, 1, i), lambda acc, v: 0.7::double * acc + 0.3::double * v) as e, xs
      from ewma),
    fitted as (
      select client, any_value(current_speed) as current_speed, max(e) filter (where i = n) as smoothed_speed,
             regr_slope(e, d) as trend_rate, stddev_pop(xs[i]) as std
      from points group by client),
    labels as (
      select *, case when std < 0.1 then 'high' when std < 0.2 then 'moderate' else 'low' end as consistency,
             case when trend_rate > 0.002 then 'Improving' when trend_rate < -0.002 then 'Declining' else 'Stable' end as trend
      from fitted)
    select client, current_speed, smoothed_speed, trend_rate,
           least(greatest(smoothed_speed + trend_rate * 7 * 0.93, current_speed * 0.95), current_speed * 1.05) as predicted_7d,
           least(greatest(smoothed_speed + trend_rate * 14 * 0.86, current_speed * 0.95), current_speed * 1.05) as predicted_14d,
           least(greatest(smoothed_speed + trend_rate * 30 * 0.7, current_speed * 0.95), current_speed * 1.05) as predicted_30d,
           consistency, trend,
           case when consistency = 'high' then 'High' when trend = 'Stable' then 'Low' else 'Moderate' end as confidence
    from labels
    """,
    current_speed=6, smoothed_speed=5, trend_rate=6, predicted_7d=4, predicted_14d=4, predicted_30d=4,
)
def _(t: Tables):
    return forecast.speed_forecast(t.sprints)


@query(
    "i01_simple_asymmetry",
    sql=f"""
    with best as (
      select client, max(top_speed) filter (where side = 'Left') as left_speed,
             max(max_accel) filter (where side = 'Left') as left_accel,
             max(top_speed) filter (where side = 'Right') as right_speed,
             max(max_accel) filter (where side = 'Right') as right_accel from sprints group by client),
    gaps as (
      select *, abs(left_speed - right_speed) / greatest(left_speed, right_speed) * 100 as speed_asymmetry,
             abs(left_accel - right_accel) / greatest(left_accel, right_accel) * 100 as accel_asymmetry
      from best where left_speed is not null and right_speed is not null)
    select *, {risk('speed_asymmetry')} as risk_level from gaps
    """,
    left_speed=6, left_accel=6, right_speed=6, right_accel=6, speed_asymmetry=6, accel_asymmetry=6,
)
def _(t: Tables):
    return asymmetry.simple_asymmetry(t.sprints)


def _signed(by: str) -> str:
    parts = []
    for metric, agg, sign in (("top_speed", "max", 1), ("max_accel", "max", 1), ("split_5", "min", -1)):
        parts.append(
            f"""select {by}, count(*) filter (where side = 'Left') as left_count,
                count(*) filter (where side = 'Right') as right_count, '{metric}' as metric, {sign} as sign,
                {agg}({metric}) filter (where side = 'Left') as left_value,
                {agg}({metric}) filter (where side = 'Right') as right_value
                from sprints group by {by}"""
        )
    return f"""
    best as ({' union all '.join(parts)}),
    indexed as (
      select * exclude (sign),
             case when left_value + right_value > 0 then sign * (left_value - right_value) / ((left_value + right_value) / 2) * 100 else 0 end as asymmetry
      from best where left_value is not null and right_value is not null),
    signed as (
      select *, abs(asymmetry) as abs_asymmetry, {risk('abs(asymmetry)')} as risk,
             case when asymmetry > 0 then 'Left' when asymmetry < 0 then 'Right' else 'Balanced' end as dominant
      from indexed)
    """


@query(
    "i02_signed_asymmetry",
    sql=f"with {_signed('client')} select * from signed",
    left_value=6, right_value=6, asymmetry=5, abs_asymmetry=5,
)
def _(t: Tables):
    return asymmetry.signed_asymmetry(t.sprints)


@query(
    "i02_signed_asymmetry_by_session",
    sql=f"with {_signed('client, session_date')} select * from signed",
    left_value=6, right_value=6, asymmetry=5, abs_asymmetry=5,
)
def _(t: Tables):
    return asymmetry.signed_asymmetry(t.sprints, ["client", "session_date"])


_TREND = f"""
    {_signed('client, session_date')},
    trend as (
      select client, session_date, max(abs_asymmetry) filter (where metric = 'top_speed') as speed_asymmetry,
             max(dominant) filter (where metric = 'top_speed') as speed_dominant,
             max(abs_asymmetry) filter (where metric = 'max_accel') as accel_asymmetry,
             max(left_value) filter (where metric = 'top_speed') as left_speed,
             max(right_value) filter (where metric = 'top_speed') as right_speed
      from signed group by client, session_date)
"""


@query(
    "i03_asymmetry_trend",
    sql=f"with {_TREND} select * from trend where speed_asymmetry is not null",
    speed_asymmetry=5, accel_asymmetry=5, left_speed=6, right_speed=6,
)
def _(t: Tables):
    return asymmetry.asymmetry_trend(t.sprints)


def _matched(by: str) -> str:
    join = " and ".join(f"l.{c} = r.{c}" for c in [*by.split(", "), "load"])
    keys = ", ".join(f"l.{c}" for c in by.split(", "))
    return f"""
    with l as (select {by}, load, max(top_speed) as v from sprints where side = 'Left' group by {by}, load),
    r as (select {by}, load, max(top_speed) as v from sprints where side = 'Right' group by {by}, load),
    pairs as (
      select {keys}, l.load, l.v as left_speed, r.v as right_speed,
             (l.v - r.v) / ((l.v + r.v) / 2) * 100 as asymmetry from l join r on {join})
    select *, abs(asymmetry) as abs_asymmetry, {risk('abs(asymmetry)')} as risk from pairs
    """


@query(
    "i04_load_matched_asymmetry",
    sql=_matched("client"),
    left_speed=6, right_speed=6, asymmetry=5, abs_asymmetry=5,
)
def _(t: Tables):
    return asymmetry.load_matched_asymmetry(t.sprints)


@query(
    "i04_load_matched_by_session",
    sql=_matched("client, session_date"),
    left_speed=6, right_speed=6, asymmetry=5, abs_asymmetry=5,
)
def _(t: Tables):
    return asymmetry.load_matched_asymmetry(t.sprints, ["client", "session_date"])


@query(
    "i05_asymmetry_direction",
    sql=f"""
    with {_TREND},
    ends as (
      select client, count(*) as sessions, first(speed_asymmetry order by session_date) as first_value,
             last(speed_asymmetry order by session_date) as last_value
      from trend where speed_asymmetry is not null group by client having count(*) >= 3)
    select *, last_value - first_value as change,
           case when last_value - first_value < -2 then 'improving' when last_value - first_value > 2 then 'worsening'
                else 'stable' end as direction from ends
    """,
    first_value=5, last_value=5, change=5,
)
def _(t: Tables):
    return asymmetry.asymmetry_direction(asymmetry.asymmetry_trend(t.sprints))


@query(
    "i06_action_tier",
    sql=f"""
    with {_signed('client')}
    select client, max(abs_asymmetry) as max_asymmetry,
           case when max(abs_asymmetry) > 10 then 'high' when max(abs_asymmetry) > 5 then 'moderate' else 'low' end as tier
    from signed group by client
    """,
    max_asymmetry=5,
)
def _(t: Tables):
    return asymmetry.action_tier(asymmetry.signed_asymmetry(t.sprints))


@query(
    "b13_sided_athletes",
    sql="select client from sprints where side in ('Left', 'Right') group by client having count(distinct side) = 2",
)
def _(t: Tables):
    return asymmetry.sided_athletes(t.sprints)
