"""Queries on the long measurement views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import clusters, components, matrix, profiles, quality, selection, sprint_clusters, trends
from .registry import query
from .sql_parts import normal_cdf, t_two_sided
from .views import METRIC_NAMES, Tables

_NAMES = ", ".join(f"'{m}'" for m in METRIC_NAMES)


# ---------------------------------------------------------------- selection


@query("b01_test_types", sql="select distinct test_type from measures where test_type is not null")
def _(t: Tables):
    return selection.test_types(t.measures)


@query("b01_test_types_from_names", sql="select 'JUMP' as test_type")
def _(t: Tables):
    return selection.test_types(t.measures.drop("test_type"))


@query("b02_one_test_type", sql="select metric, count(*) as rows, count(value) as numbers from measures where test_type = 'A' group by metric")
def _(t: Tables):
    return (
        selection.of_test_type(t.measures, "A")
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("numbers"))
    )


@query("b02_test_type_by_name", sql="select entity, count(*) as rows from measures where metric ilike '%jump%' group by entity")
def _(t: Tables):
    named = selection.of_test_type(t.measures.drop("test_type"), "jump")
    return named.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"))


@query("b03_top_entities", sql="select entity, count(*) as rows from measures group by entity order by rows desc, entity limit 20")
def _(t: Tables):
    return selection.top_entities(t.measures)


@query("b04_entities", sql="select distinct entity from measures")
def _(t: Tables):
    return selection.distinct_sorted(t.measures, "entity")


@query("b04_session_dates", sql="select distinct session_date from sprints")
def _(t: Tables):
    return selection.distinct_sorted(t.sprints, "session_date")


@query(
    "b05_date_range",
    sql="""select entity, metric, count(*) as rows from measures
           where cast(test_ts as date) between date '1996-03-01' and date '1998-02-28' group by entity, metric""",
)
def _(t: Tables):
    chosen = selection.in_dates(t.measures, date(1996, 3, 1), date(1998, 2, 28))
    return chosen.groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "b06_members",
    sql="""with busy as (select entity from measures group by entity order by count(*) desc, entity limit 20)
           select entity, metric, count(*) as rows from measures
           where entity in (select entity from busy) and metric in ('Peak Power', 'Mean Force') group by entity, metric""",
)
def _(t: Tables):
    chosen = selection.members(t.measures, "metric", ["Peak Power", "Mean Force"])
    chosen = selection.members(chosen, "entity", selection.top_entities(t.measures))
    return chosen.groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "b07_metrics_by_pattern",
    sql="select distinct metric from measures where metric ilike '%power%' or metric ilike '%time%'",
)
def _(t: Tables):
    return selection.matching_metrics(t.measures.select("metric").distinct(), ["power", "Time"])


@query(
    "b08_preset_and_term",
    sql="""select distinct metric from measures
           where (metric ilike '%power%' or metric ilike '%force%') and metric ilike '%peak%'""",
)
def _(t: Tables):
    return selection.search_metrics(t.measures.select("metric").distinct(), "peak", "Power & Force")


# The rules once more, written down for SQL on their own: position, label, names wanted, names unwanted (all upper case).
_CATEGORIES = """
    rule(position, category, wanted, unwanted) as (values
      (0, 'power', 'POWER', null),
      (1, 'force', 'FORCE', 'RFD'),
      (2, 'velocity', 'VELOCITY|TAKEOFF', null),
      (3, 'jump', 'JUMP|HEIGHT|RSI|MRSI|MOMENTUM', null),
      (4, 'timing', 'TIME|DURATION|PHASE', null),
      (5, 'rfd', 'RFD', null),
      (6, 'impulse', 'IMPULSE', null),
      (7, 'stiffness', 'STIFFNESS|DISPLACEMENT|DEPTH', null),
      (8, 'landing', 'LANDING|STABILIZATION', null),
      (9, 'asymmetry', 'L[|]R|LEFT|RIGHT|ASYM|INDEX', null),
      (10, 'braking', 'BRAKING', 'RFD'),
      (11, 'propulsive', 'PROPULSIVE', null))
"""

_FAMILIES = """
    rule(position, family, wanted, unwanted) as (values
      (0, 'All Performance Metrics', '', 'RESULT_TYPE|START_OF_MOVEMENT_THRESHOLD|START_OF_INTEGRATION'),
      (1, 'Force Production', 'FORCE|WEIGHT_RELATIVE|BODYMASS_RELATIVE|BM_REL', 'RFD|RPD'),
      (2, 'Power Output', 'POWER|VELOCITY_AT_PEAK_POWER', null),
      (3, 'Speed/Velocity', 'VELOCITY|ACCELERATION', 'POWER'),
      (4, 'Jump Mechanics', 'JUMP_HEIGHT|FLIGHT_TIME|RSI|STIFFNESS|DISPLACEMENT', null),
      (5, 'Rate of Force Development', 'RFD|RPD', null),
      (6, 'Impulse & Momentum', 'IMPULSE|MOMENTUM', null),
      (7, 'Timing & Phases', 'TIME|DURATION|PHASE|BEGIN_|CONTRACTION', null),
      (8, 'Ratios & Performance Indices', 'RATIO|RELATIVE|INDEX|_REL_|MODIFIED', 'FORCE|POWER|VELOCITY|IMPULSE'))
"""

_FITS = """regexp_matches(upper(n.metric), r.wanted)
           and (r.unwanted is null or not regexp_matches(upper(n.metric), r.unwanted))"""


@query(
    "b09_metric_categories",
    sql=f"""with {_CATEGORIES}, names as (select distinct metric from measures)
           select n.metric, r.position, r.category from names n join rule r on {_FITS}""",
)
def _(t: Tables):
    return selection.metric_categories(t.measures.select("metric").distinct())


@query(
    "b10_category_counts",
    sql=f"""with {_CATEGORIES}, names as (select distinct metric from measures)
           select r.position, r.category, count(n.metric) as metrics from rule r left join names n on {_FITS}
           group by r.position, r.category""",
)
def _(t: Tables):
    return selection.category_counts(t.measures)


@query(
    "b11_metric_families",
    sql=f"""with {_FAMILIES}, names as (select distinct upper(replace(metric, ' ', '_')) as metric from measures)
           select n.metric, r.position, r.family from names n join rule r on {_FITS}""",
)
def _(t: Tables):
    names = t.measures.select(F.upper(F.replace("metric", F.lit(" "), F.lit("_"))).alias("metric")).distinct()
    return selection.metric_families(names)


_PROFILE = """
    profile as (
      select metric, avg(value) as mean, stddev_samp(value) as std, count(value) as datapoints,
             count(distinct entity) as entities, case when count(value) > 0 then 100.0::double end as completeness_pct,
             count(value) / count(*) * 100 as row_completeness_pct,
             case when avg(value) = 0 then 0 else coalesce(stddev_samp(value) / avg(value), 0) end as cv
      from measures group by metric)
"""


@query(
    "b12_chosen_metrics",
    sql=f"""
    with {_PROFILE}, {_CATEGORIES}, labelled as (select n.metric, r.category from profile n join rule r on {_FITS}),
    hits as (
      select metric, min(case category when 'jump' then 1 when 'power' then 2 else 3 end)::int as category_position
      from labelled where category in ('jump', 'power', 'asymmetry') group by metric)
    select h.metric, h.category_position from hits h join profile p on h.metric = p.metric
    order by category_position, completeness_pct desc, h.metric limit 10
    """,
)
def _(t: Tables):
    return selection.chosen_metrics(quality.metric_profile(t.measures), ["jump", "power", "asymmetry"], 10)


# ---------------------------------------------------------------- quality


@query(
    "c01_metric_profile",
    sql=f"with {_PROFILE} select * from profile",
    mean=3, std=3, row_completeness_pct=6, cv=6,
)
def _(t: Tables):
    return quality.metric_profile(t.measures)


@query(
    "c02_available_metrics",
    sql=f"""
    with {_PROFILE}, gate as (select count(*) as n from profile where completeness_pct >= 50 and entities >= 2)
    select metric, datapoints, entities from profile, gate
    where case when n >= 5 then completeness_pct >= 50 and entities >= 2 else datapoints >= 1 and entities >= 1 end
    """,
)
def _(t: Tables):
    return quality.available_metrics(quality.metric_profile(t.measures)).select("metric", "datapoints", "entities")


@query(
    "c03_completeness",
    sql="select entity, metric, count(value) as datapoints, count(*) as rows from measures group by entity, metric",
)
def _(t: Tables):
    return quality.completeness(t.measures)


@query(
    "c03_completeness_matrix",
    sql="select entity, "
    + ", ".join(f"count(value) filter (where metric = '{m}') as \"{m}\"" for m in METRIC_NAMES)
    + " from measures_orders group by entity",
)
def _(t: Tables):
    return quality.completeness_matrix(t.measures_orders, METRIC_NAMES)


_COVERAGE = """
    coverage as (
      select entity, count(distinct metric) as metrics_with_data, count(*) as total_points,
             round_even(count(distinct metric) / (select count(*) from profile) * 100 * 10, 0) / 10 as coverage_pct,
             round_even(count(*) / count(distinct metric) * 10, 0) / 10 as avg_points_per_metric
      from measures group by entity)
"""


@query("c04_coverage_scores", sql=f"with {_PROFILE}, {_COVERAGE} select * from coverage")
def _(t: Tables):
    available = quality.available_metrics(quality.metric_profile(t.measures))
    return quality.coverage_scores(t.measures, available)


@query(
    "c05_coverage_rollup",
    sql=f"""
    with {_PROFILE}, {_COVERAGE}
    select avg(coverage_pct) as avg_coverage, max(coverage_pct) as best_coverage, min(coverage_pct) as lowest_coverage,
           cast(sum(total_points) as bigint) as total_points, count(*) as entities,
           count(*) filter (where coverage_pct < 50) as low_coverage_entities,
           sum(total_points) / (count(*) * (select count(*) from profile)) * 100 as overall_completeness
    from coverage
    """,
    avg_coverage=6, overall_completeness=4,
)
def _(t: Tables):
    available = quality.available_metrics(quality.metric_profile(t.measures))
    return quality.coverage_rollup(quality.coverage_scores(t.measures, available), available)


@query(
    "c06_top_metrics",
    sql=f"with {_PROFILE} select metric, completeness_pct, entities from profile order by completeness_pct desc, metric limit 10",
)
def _(t: Tables):
    return quality.top_metrics(quality.metric_profile(t.measures))


# ---------------------------------------------------------------- matrices, components, clusters


@query(
    "d01_entity_matrix",
    sql="select entity, "
    + ", ".join(f"avg(value) filter (where metric = '{m}') as \"{m}\"" for m in METRIC_NAMES)
    + " from measures_orders group by entity",
    **{m: 4 for m in METRIC_NAMES},
)
def _(t: Tables):
    return matrix.entity_matrix(t.measures_orders, METRIC_NAMES)


_FILLED = """
    means as (select entity, metric, avg(value) as value from measures_orders group by entity, metric having count(value) > 0),
    medians as (select metric, median(value) as middle from means group by metric),
    grid as (select e.entity, m.metric, m.middle from (select distinct entity from means) e, medians m),
    filled as (
      select g.entity, g.metric, coalesce(v.value, g.middle) as value
      from grid g left join means v on g.entity = v.entity and g.metric = v.metric),
    spread as (
      select metric, avg(value) as mean, stddev_samp(value) as std_samp, stddev_pop(value) as std_pop
      from filled group by metric)
"""


def _order_matrix(t: Tables) -> matrix.Matrix:
    return matrix.complete_matrix(matrix.selected_means(t.measures_orders, METRIC_NAMES), metrics=METRIC_NAMES)


def _supplier_matrix(t: Tables) -> matrix.Matrix:
    return matrix.complete_matrix(matrix.selected_means(t.measures, METRIC_NAMES), metrics=METRIC_NAMES)


@query("d02_imputed_matrix", sql=f"with {_FILLED} select * from filled", value=4)
def _(t: Tables):
    return _order_matrix(t).long()


@query("d03_matrix_statistics", sql=f"with {_FILLED} select * from spread", mean=4, std_samp=4, std_pop=4)
def _(t: Tables):
    return _order_matrix(t).varying().statistics()


_SCALED = _FILLED + """, scaled as (
      select f.entity, f.metric, (f.value - s.mean) / s.std_pop as z from filled f join spread s on f.metric = s.metric)
"""


@query("d04_standardized_matrix", sql=f"with {_SCALED} select * from scaled", z=6)
def _(t: Tables):
    m = _order_matrix(t)
    return m.standardized().unpivot("entity", [matrix.quoted(c) for c in m.metrics], "metric", "z")


def _pairs_sql(names: str) -> str:
    return f"""
      select a.metric as metric_a, b.metric as metric_b, corr(a.value, b.value) as r
      from {names} a join {names} b on a.entity = b.entity group by all
    """


@query("d05_correlations", sql=f"with {_FILLED} {_pairs_sql('filled')}", r=6)
def _(t: Tables):
    return matrix.correlation_pairs(_order_matrix(t))


@query(
    "d06_capped_correlations",
    sql=f"""with {_FILLED},
    widest as (select metric from spread order by std_samp desc, metric limit 5),
    kept as (select * from filled where metric in (select metric from widest)) {_pairs_sql('kept')}""",
    r=6,
)
def _(t: Tables):
    return matrix.correlation_pairs(_order_matrix(t), max_metrics=5)


@query("d07_suitability")
def _(t: Tables):
    m = _order_matrix(t).varying()
    found = components.suitability(m.correlation(), m.n)
    return t.spark.createDataFrame(
        [tuple(found)], "kmo double, bartlett_chi2 double, bartlett_p double, bartlett_dof int"
    )


@query("d09_eigenvalues")
def _(t: Tables):
    m = _order_matrix(t).varying()
    return components.variance_table(t.spark, components.spectrum(m), 10)


@query("d11_parallel_thresholds")
def _(t: Tables):
    m = _order_matrix(t).varying()
    found = components.spectrum(m)
    limits = components.parallel_thresholds(t.spark, m.n, len(m.metrics))
    rows = [(i, float(e), float(x), bool(e > x)) for i, (e, x) in enumerate(zip(found.eigenvalues, limits, strict=False))]
    return t.spark.createDataFrame(rows, "rank int, eigenvalue double, threshold double, kept boolean")


@query("d12_component_counts")
def _(t: Tables):
    a = clusters.component_analysis(t.measures_orders, METRIC_NAMES)
    return t.spark.createDataFrame(
        [(a.n_kaiser, a.n_parallel, a.n_components)], "kaiser int, parallel int, components int"
    )


@query("d13_component_scores")
def _(t: Tables):
    return clusters.component_analysis(t.measures_orders, METRIC_NAMES).scores


@query("d14_feature_importance")
def _(t: Tables):
    return components.feature_importance(clusters.component_analysis(t.measures_orders, METRIC_NAMES).loadings)


@query("d15_kmeans_clusters")
def _(t: Tables):
    return clusters.cluster_entities(clusters.component_analysis(t.measures, METRIC_NAMES))


@query("d15_points_nearer_elsewhere", sql="select i as cluster, cast(0 as bigint) as points from range(3) as clusters(i)")
def _(t: Tables):
    """Points of each cluster that lie nearer to the mean of another one: none, once k-means has come to rest."""
    labelled = clusters.cluster_entities(clusters.component_analysis(t.measures, METRIC_NAMES))
    names = [c for c in labelled.columns if c.startswith("PC")][:3]
    means = labelled.groupBy("cluster").agg(F.array(*[F.avg(c) for c in names]).alias("mean"))
    known = means.agg(F.sort_array(F.collect_list(F.struct("cluster", "mean")))).scalar()
    gap = lambda c: sum(((F.col(n) - F.get(c["mean"], i)) * (F.col(n) - F.get(c["mean"], i)) for i, n in enumerate(names)), F.lit(0.0))
    own = F.array_min(F.transform(F.filter("_all", lambda c: c["cluster"] == F.col("cluster")), gap))
    judged = labelled.select("cluster", *names, known.alias("_all")).withColumn("elsewhere", F.array_min(F.transform("_all", gap)) < own)
    return judged.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.count_if("elsewhere").alias("points"))


def _thirds(t: Tables):
    """Labels that SQL can give too: the entity number modulo three, with three scaled metrics as coordinates."""
    m = _supplier_matrix(t)
    names = METRIC_NAMES[:3]
    scaled = m.rows.select("entity", *[m.scaled(c).alias(f"x{i}") for i, c in enumerate(names)])
    return m, scaled.withColumn("cluster", (F.col("entity") % 3).cast("int"))


_SUPPLIER_SCALED = _SCALED.replace("measures_orders", "measures")
_POINTS = (
    _SUPPLIER_SCALED
    + ", points as (select entity, cast(entity % 3 as int) as cluster, "
    + ", ".join(f"max(z) filter (where metric = '{m}') as x{i}" for i, m in enumerate(METRIC_NAMES[:3]))
    + " from scaled group by entity)"
)


_SILHOUETTE = f"""
    with {_POINTS},
    sizes as (select cluster, count(*) as size from points group by cluster),
    mean_gap as (
      select a.entity, a.cluster, b.cluster as other, sum(sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) as total
      from points a, points b group by all),
    sided as (
      select g.entity, max(case when g.cluster = g.other then total / (size - 1) end) as a,
             min(case when g.cluster <> g.other then total / size end) as b
      from mean_gap g join sizes s on g.other = s.cluster group by g.entity),
    score as (select avg((b - a) / greatest(a, b)) as silhouette from sided)
    select silhouette, case when silhouette < 0.25 then 'Poor' when silhouette < 0.5 then 'Fair'
           when silhouette < 0.75 then 'Good' else 'Excellent' end as quality,
           (select count(*) from sizes) as clusters, (select count(*) from points) as points from score
    """


@query("d16_silhouette_given_labels", sql=_SILHOUETTE, silhouette=6)
def _(t: Tables):
    return clusters.silhouette_score(_thirds(t)[1], "entity", ["x0", "x1", "x2"])


@query("d16_silhouette_many_blocks", sql=_SILHOUETTE, silhouette=6)
def _(t: Tables):
    return clusters.silhouette_score(_thirds(t)[1], "entity", ["x0", "x1", "x2"], block=24)


_SQUARED = f"""
    with {_POINTS},
    sizes as (select cluster, count(*) as size from points group by cluster),
    mean_gap as (
      select a.entity, a.cluster, b.cluster as other, sum((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) as total
      from points a, points b group by all),
    sided as (
      select g.entity, g.cluster, max(case when g.cluster = g.other then total / (size - 1) end) as a,
             min(case when g.cluster <> g.other then total / size end) as b
      from mean_gap g join sizes s on g.other = s.cluster group by g.entity, g.cluster),
    widths as (select entity, cluster, (b - a) / greatest(a, b) as silhouette from sided)
"""


@query("d16_moment_silhouettes_given_labels", sql=_SQUARED + "select entity, cluster, silhouette from widths", silhouette=6)
def _(t: Tables):
    return clusters.moment_silhouettes(_thirds(t)[1], "entity", ["x0", "x1", "x2"])


@query(
    "d16_moment_silhouette_given_labels",
    sql=_SQUARED
    + """
    select avg(silhouette) as silhouette,
           case when avg(silhouette) < 0.25 then 'Poor' when avg(silhouette) < 0.5 then 'Fair'
                when avg(silhouette) < 0.75 then 'Good' else 'Excellent' end as quality,
           count(distinct cluster) as clusters, count(*) as points
    from widths
    """,
    silhouette=6,
)
def _(t: Tables):
    return clusters.moment_silhouette_score(_thirds(t)[1], "entity", ["x0", "x1", "x2"])


@query(
    "d17_cluster_sizes_given_labels",
    sql="select cast(entity % 3 as int) as cluster, count(distinct entity) as size from measures group by 1",
)
def _(t: Tables):
    return clusters.cluster_sizes(_thirds(t)[1])


@query("d18_biplot")
def _(t: Tables):
    a = clusters.component_analysis(t.measures_orders, METRIC_NAMES)
    return components.biplot(a.scores, "entity", a.loadings)


_CLUSTER_Z = _SUPPLIER_SCALED + """,
    by_cluster as (
      select cast(entity % 3 as int) as cluster, metric, avg(value) as cluster_mean from filled group by all),
    zs as (
      select c.cluster, c.metric, c.cluster_mean, (c.cluster_mean - s.mean) / (s.std_samp + 1e-8) as z_samp,
             (c.cluster_mean - s.mean) / (s.std_pop + 1e-8) as z_pop
      from by_cluster c join spread s on c.metric = s.metric)
"""


@query(
    "d19_cluster_insights_given_labels",
    sql=f"""
    with {_CLUSTER_Z},
    ranked as (
      select *, row_number() over (partition by cluster order by z_samp desc, metric) as high,
             row_number() over (partition by cluster order by z_samp, metric) as low from zs),
    words as (
      select cluster, high, case when contains(upper(metric), 'POWER') then 'Power' when contains(upper(metric), 'FORCE') then 'Force'
             when contains(upper(metric), 'VELOCITY') or contains(upper(metric), 'SPEED') then 'Speed'
             when contains(upper(metric), 'JUMP') or contains(upper(metric), 'HEIGHT') then 'Jump'
             when contains(upper(metric), 'RFD') then 'RFD' else split_part(metric, ' ', 1) end as word
      from ranked where high <= 2),
    names as (
      select cluster, 'High ' || case when min(word) = max(word) then min(word) else string_agg(word, '/' order by high) end as name
      from words group by cluster)
    select r.cluster, any_value(n.name) as name, (select count(distinct entity) from filled where entity % 3 = r.cluster) as size,
           string_agg(metric, '; ' order by high) filter (where high <= 3) as strengths,
           string_agg(metric, '; ' order by low) filter (where low <= 3) as weaknesses, avg(z_samp) as avg_z
    from ranked r join names n on r.cluster = n.cluster group by r.cluster
    """,
    avg_z=6,
)
def _(t: Tables):
    m, labels = _thirds(t)
    found = clusters.cluster_insights(m, labels)
    return found.withColumns(
        {
            "strengths": F.array_join("strengths.metric", "; "),
            "weaknesses": F.array_join("weaknesses.metric", "; "),
        }
    )


@query(
    "d20_covered_metrics",
    sql="""
    with means as (
      select entity, metric from measures_orders group by entity, metric having count(value) > 0)
    select metric, count(*) as entities from means group by metric
    having count(*) >= greatest(3, 0.5 * (select count(distinct entity) from measures_orders))
    """,
)
def _(t: Tables):
    everyone = t.measures_orders.select("entity").distinct().count()
    return clusters.covered_metrics(matrix.selected_means(t.measures_orders, METRIC_NAMES), everyone)


_GATE = """
    with means as (
      select entity, metric from measures_orders where metric in ({metrics}) group by entity, metric having count(value) > 0),
    covered as (
      select metric from means group by metric
      having count(*) >= greatest(3, 0.5 * (select count(distinct entity) from measures_orders))),
    found as (select (select count(*) from covered) as metrics, (select count(distinct entity) from means) as entities)
    select case when metrics < 3 then 'too_few_metrics' when entities < 3 then 'too_few_entities' else 'ok' end as status,
           metrics, entities from found
"""


def _gate_sql(metrics: list[str]) -> str:
    return _GATE.format(metrics=", ".join(f"'{m}'" for m in metrics))


@query("d20_gate", sql=_gate_sql(METRIC_NAMES))
def _(t: Tables):
    return clusters.gate(t.measures_orders, METRIC_NAMES)


@query("d20_gate_closed", sql=_gate_sql(METRIC_NAMES[:2]))
def _(t: Tables):
    return clusters.gate(t.measures_orders, METRIC_NAMES[:2])


@query("d20_gated_analysis")
def _(t: Tables):
    return clusters.gated_analysis(t.measures, METRIC_NAMES).labelled


@query("d20_gated_silhouette")
def _(t: Tables):
    return clusters.gated_analysis(t.measures, METRIC_NAMES).score


@query("d21_top_loadings")
def _(t: Tables):
    return components.top_loadings(clusters.component_analysis(t.measures_orders, METRIC_NAMES).loadings)


@query(
    "d22_cluster_characteristics_given_labels",
    sql=f"""
    with {_CLUSTER_Z},
    ranked as (
      select *, row_number() over (partition by cluster order by z_pop desc, metric) as high,
             row_number() over (partition by cluster order by z_pop, metric) as low from zs)
    select cluster, metric, cluster_mean, z_pop as z, 'strength' as kind, cast(high as int) as rank from ranked where high <= 5
    union all
    select cluster, metric, cluster_mean, z_pop, 'weakness', cast(low as int) from ranked where low <= 5
    """,
    cluster_mean=3, z=6,
)
def _(t: Tables):
    m, labels = _thirds(t)
    return clusters.cluster_characteristics(m, labels)


@query("d23_variance_explained")
def _(t: Tables):
    a = clusters.component_analysis(t.measures_orders, METRIC_NAMES)
    return components.variance_table(t.spark, a.spectrum, a.n_components)


@query("d24_component_export")
def _(t: Tables):
    return clusters.exported(clusters.component_analysis(t.measures, METRIC_NAMES))


@query("h02_athlete_clusters")
def _(t: Tables):
    return sprint_clusters.cluster_athletes(t.sprints)


@query("h03_cluster_summary")
def _(t: Tables):
    return sprint_clusters.cluster_summary(sprint_clusters.cluster_athletes(t.sprints))


@query(
    "h03_cluster_summary_given_labels",
    sql="""
    with curve as (select client, load, max(top_speed) as best from sprints where load is not null group by client, load),
    kept as (
      select client, max(best) as max_speed,
             case when count(*) > 1 then last(best order by load) / first(best order by load) * 100 else 100 end as retention
      from curve group by client)
    select cast(client % 3 as int) as cluster, count(*) as members, avg(max_speed) as avg_max_speed, avg(retention) as avg_retention
    from kept group by 1
    """,
    avg_max_speed=4, avg_retention=5,
)
def _(t: Tables):
    from ..operators.loads import athlete_features

    labelled = athlete_features(t.sprints).withColumn("cluster", (F.col("client") % 3).cast("int"))
    return sprint_clusters.cluster_summary(labelled)


# ---------------------------------------------------------------- trends


@query(
    "e01_points_over_time",
    sql="select entity, metric, test_ts, avg(value) as value from measures group by entity, metric, test_ts",
    value=5,
)
def _(t: Tables):
    return trends.points_over_time(t.measures)


def _improvement_sql(view: str) -> str:
    return f"""
    series as (
      select entity, metric, test_ts, avg(value) as value,
             row_number() over (partition by entity, metric order by test_ts) - 1 as i,
             count(*) over (partition by entity, metric) as n
      from {view} group by entity, metric, test_ts),
    sums as (
      select entity, metric, any_value(n) as data_points, count(value) as present,
             max(value) filter (where i = 0) as first_value, max(value) filter (where i = n - 1) as last_value,
             regr_slope(value, i) as slope, var_samp(value) as vy, var_samp(i) as vx,
             avg(value) filter (where i < n // 2) as m1, avg(value) filter (where i >= n // 2) as m2,
             var_samp(value) filter (where i < n // 2) as v1, var_samp(value) filter (where i >= n // 2) as v2
      from series group by entity, metric having any_value(n) >= 2),
    tested as (
      select *, case when present = data_points and data_points >= 3 then data_points - 2 end as dof,
             case when vy = 0 then 0 else slope / sqrt(greatest((vy - slope * slope * vx) / vx, 1e-300) / (data_points - 2)) end as t
      from sums),
    report as (
      select entity, metric,
             case when first_value = 0 then 0 else (last_value - first_value) / abs(first_value) * 100 end as improvement_pct,
             first_value, last_value, data_points,
             case when dof is not null then {t_two_sided("t", "dof")} end as p_value,
             case when dof is not null and v1 + v2 > 0 then (m2 - m1) / sqrt((v1 + v2) / 2) end as effect_size
      from tested)
    """


_STARS = """case when data_points < 3 then 'N/A' when p_value < 0.001 then '***' when p_value < 0.01 then '**'
            when p_value < 0.05 then '*' else 'ns' end as significance"""


@query(
    "e02_first_to_last",
    sql=f"""with {_improvement_sql('measures')}
    select entity, metric, first_value, last_value, data_points, improvement_pct from report""",
    first_value=5, last_value=5, improvement_pct=4,
)
def _(t: Tables):
    return trends.first_to_last(t.measures)


@query(
    "e07_improvement_report",
    sql=f"with {_improvement_sql('measures_events')} select *, {_STARS} from report",
    first_value=6, last_value=6, improvement_pct=4, p_value=6, effect_size=5,
)
def _(t: Tables):
    return trends.improvement_report(t.events)


@query(
    "e07_improvement_report_daily",
    sql=f"with {_improvement_sql('measures')} select *, {_STARS} from report",
    first_value=5, last_value=5, improvement_pct=4, p_value=6, effect_size=5,
)
def _(t: Tables):
    # the tests carry dates only; as DATE their points are ranked without hour buckets
    return trends.improvement_report(t.measures.withColumn("test_ts", F.to_date("test_ts")))


@query(
    "e03_trend_significance",
    sql=f"with {_improvement_sql('measures_events')} select entity, metric, data_points, p_value, {_STARS} from report",
    p_value=6,
)
def _(t: Tables):
    return trends.improvement_report(t.events).select("entity", "metric", "data_points", "p_value", "significance")


@query(
    "e04_half_split_effect",
    sql=f"with {_improvement_sql('measures_events')} select entity, metric, effect_size from report",
    effect_size=5,
)
def _(t: Tables):
    return trends.improvement_report(t.events).select("entity", "metric", "effect_size")


_PER_ENTITY = """
    per_entity as (
      select entity, round_even(avg(improvement_pct) * 10, 0) / 10 as improvement_pct from report group by entity)
"""


@query(
    "e05_improvement_leaders",
    sql=f"""with {_improvement_sql('measures')}, {_PER_ENTITY},
    best as (select * from per_entity where improvement_pct is not null order by improvement_pct desc, entity limit 5),
    worst as (select * from per_entity where improvement_pct is not null order by improvement_pct, entity desc limit 5)
    select entity, improvement_pct, 'top' as board from best where improvement_pct > 0
    union all select entity, improvement_pct, 'bottom' from worst where improvement_pct < 0""",
)
def _(t: Tables):
    return trends.improvement_leaders(trends.first_to_last(t.measures))


@query(
    "e05_entity_improvement",
    sql=f"with {_improvement_sql('measures')}, {_PER_ENTITY} select * from per_entity",
)
def _(t: Tables):
    return trends.entity_improvement(trends.first_to_last(t.measures))


@query(
    "e06_improvement_matrix",
    sql=f"with {_improvement_sql('measures')} select entity, "
    + ", ".join(
        f"round_even(avg(improvement_pct) filter (where metric = '{m}') * 10, 0) / 10 as \"{m}\"" for m in METRIC_NAMES
    )
    + " from report group by entity",
)
def _(t: Tables):
    return trends.improvement_matrix(trends.first_to_last(t.measures), METRIC_NAMES)


# ---------------------------------------------------------------- profiles

_PROFILES = f"""
    grp as (select metric, avg(value) as m, stddev_samp(value) as s from measures group by metric),
    own as (select entity, metric, avg(value) as v from measures group by entity, metric),
    raw as (select o.entity, o.metric, v, m, case when s > 0 then (v - m) / s else 0 end as z from own o join grp g on o.metric = g.metric),
    cdf as (select *, {normal_cdf('z')} as phi from raw),
    prof as (
      select entity, metric, round_even(v * 100, 0) / 100 as value, round_even(m * 100, 0) / 100 as group_avg,
             round_even(z * 100, 0) / 100 as z_score, round_even(phi * 100 * 10, 0) / 10 as percentile
      from cdf)
"""


@query("f01_entity_profiles", sql=f"with {_PROFILES} select * from prof")
def _(t: Tables):
    return profiles.entity_profiles(t.measures)


@query(
    "f02_strengths_and_weaknesses",
    sql=f"""
    with {_PROFILES},
    ranked as (
      select entity, metric, z_score, cast(row_number() over (partition by entity order by z_score desc nulls last, metric) as int) as rank,
             count(*) over (partition by entity) as n from prof)
    select entity, metric, z_score, rank, 'strength' as kind from ranked where rank <= 5
    union all select entity, metric, z_score, rank, 'weakness' from ranked where rank > n - 5
    """,
)
def _(t: Tables):
    return profiles.strengths_and_weaknesses(profiles.entity_profiles(t.measures))


@query(
    "f03_profile_summary",
    sql=f"""with {_PROFILES} select entity, count(*) as metrics, avg(percentile) as avg_percentile,
            count(*) filter (where z_score > 0) as above_average from prof group by entity""",
    avg_percentile=5,
)
def _(t: Tables):
    return profiles.profile_summary(profiles.entity_profiles(t.measures))


def _neighbours(t: Tables):
    """Every entity against the one with the next number."""
    every = t.measures.select(F.col("entity").alias("first")).distinct()
    return every.select("first", (F.col("first") + 1).alias("second"))


_HEAD = """
    own as (select entity, metric, avg(value) as v from measures group by entity, metric),
    cmp as (
      select a.entity as first, b.entity as second, a.metric, round_even(a.v * 100, 0) / 100 as first_value,
             round_even(b.v * 100, 0) / 100 as second_value, round_even((a.v - b.v) * 100, 0) / 100 as difference,
             round_even(case when b.v = 0 then 0 else (a.v - b.v) / abs(b.v) * 100 end * 10, 0) / 10 as difference_pct,
             case when a.v - b.v > 0 then a.entity else b.entity end as winner
      from own a join own b on b.entity = a.entity + 1 and a.metric = b.metric)
"""


@query("f04_head_to_head", sql=f"with {_HEAD} select * from cmp")
def _(t: Tables):
    return profiles.head_to_head(t.measures, _neighbours(t))


@query(
    "f05_radar_values",
    sql=f"""with {_HEAD}
    select first, second, metric,
           case when first_value = second_value then 60.0::double
                else 20 + (first_value - least(first_value, second_value)) / abs(first_value - second_value) * 80 end as first_radar,
           case when first_value = second_value then 60.0::double
                else 20 + (second_value - least(first_value, second_value)) / abs(first_value - second_value) * 80 end as second_radar
    from cmp qualify row_number() over (partition by first, second order by metric) <= 10""",
    first_radar=6, second_radar=6,
)
def _(t: Tables):
    return profiles.radar_values(profiles.head_to_head(t.measures, _neighbours(t)))


@query(
    "f06_win_tally",
    sql=f"""with {_HEAD}
    select first, second, count(*) filter (where winner = first) as first_wins,
           count(*) filter (where winner = second) as second_wins, avg(abs(difference_pct)) as avg_difference_pct
    from cmp group by first, second""",
    avg_difference_pct=4,
)
def _(t: Tables):
    return profiles.win_tally(profiles.head_to_head(t.measures, _neighbours(t)))


@query(
    "f07_run_summary",
    sql="""select count(distinct entity) as entities, count(*) as rows, min(year(test_ts)) || '-' || max(year(test_ts)) as period,
           count(distinct metric) as metrics, cast(count(distinct entity % 3) as bigint) as clusters from measures""",
)
def _(t: Tables):
    available = quality.available_metrics(quality.metric_profile(t.measures))
    labels = t.measures.select((F.col("entity") % 3).alias("cluster")).distinct()
    return profiles.run_summary(t.measures, available, labels)
