"""Component queries over three metrics, where eigenvalues and eigenvectors have closed forms that SQL can state.

The operators are those of the queries over all metrics; only the number of metrics differs.  A 3 x 3 correlation matrix has
its eigenvalues from the cosine of a third of an angle, and each eigenvector is a cross product of two rows of the matrix
less its eigenvalue (the longest of the three products).
"""

from __future__ import annotations

from ..operators import clusters, components, matrix
from .jump_queries import _FILLED, _SCALED
from .registry import query
from .views import Tables

_THREE = ["Asymmetry Index", "Jump Height", "Mean Force"]
_LISTED = ", ".join(f"('{m}', {i})" for i, m in enumerate(_THREE, 1))
_A, _B, _C = (f"'{m}'" for m in _THREE)

_R = """, wide as (
      select max(value) filter (where metric = 'Asymmetry Index') as x, max(value) filter (where metric = 'Jump Height') as y,
             max(value) filter (where metric = 'Mean Force') as z
      from filled group by entity),
    r as (select corr(x, y) as a, corr(x, z) as b, corr(y, z) as c, count(*) as n from wide),
    sums as (select *, a * a + b * b + c * c as squares, 1 + 2 * a * b * c - a * a - b * b - c * c as det from r),
    angles as (
      select *, sqrt(squares / 3) as radius, acos(greatest(-1, least(1, a * b * c / power(squares / 3, 1.5)))) / 3 as angle from sums),
    roots as (
      select *, 1 as j, 1 + 2 * radius * cos(angle) as root from angles
      union all select *, 2, 1 + 2 * radius * cos(angle - 2 * pi() / 3) from angles
      union all select *, 3, 1 + 2 * radius * cos(angle + 2 * pi() / 3) from angles),
    crossed as (
      select *, 1 - root as d,
        [[a * c - b * (1 - root), a * b - (1 - root) * c, (1 - root) * (1 - root) - a * a],
         [a * (1 - root) - b * c, b * b - (1 - root) * (1 - root), (1 - root) * c - a * b],
         [(1 - root) * (1 - root) - c * c, b * c - a * (1 - root), a * c - b * (1 - root)]] as products
      from roots),
    products as (select j, root, n, unnest(products) as v from crossed),
    longest as (
      select j, root, n, v from products
      qualify row_number() over (partition by j order by v[1] * v[1] + v[2] * v[2] + v[3] * v[3] desc) = 1),
    units as (
      select j, root, n, v, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3])
        * sign(case when abs(v[1]) >= greatest(abs(v[2]), abs(v[3])) then v[1] when abs(v[2]) >= abs(v[3]) then v[2] else v[3] end) as norm
      from longest),
    components as (select 'PC' || j as component, j, root * n / (n - 1) as eigenvalue, root / 3 as ratio, v, norm from units),
"""
_LOADED = _R + f"""
    loaded as (
      select component, j, ratio, metric, v[i] / norm as loading from components, (values {_LISTED}) as names(metric, i) where j <= 2),
    scored as (
      select s.entity, sum(s.z * loading) filter (where j = 1) as "PC1", sum(s.z * loading) filter (where j = 2) as "PC2"
      from scaled s join loaded l on s.metric = l.metric group by s.entity)
"""


def _three(text: str) -> str:
    return text.replace("from measures_orders", f"from measures_orders where metric in ({_A}, {_B}, {_C})")


def _fitted(t: Tables) -> clusters.ComponentAnalysis:
    return clusters.component_analysis(t.measures_orders, _THREE)


def _matrix(t: Tables) -> matrix.Matrix:
    return matrix.complete_matrix(matrix.selected_means(t.measures_orders, _THREE), metrics=_THREE).varying()


# Bartlett's p for 3 degrees of freedom: the tail of the chi density by Simpson's rule over its root.
@query(
    "d07_suitability_of_three",
    sql=_three(f"with {_FILLED}") + _R + """
    inverse as (
      select *, (1 - c * c) / det + 1e-10 as xx, (1 - b * b) / det + 1e-10 as yy, (1 - a * a) / det + 1e-10 as zz,
             (b * c - a) / det as xy, (a * c - b) / det as xz, (a * b - c) / det as yz from sums),
    tests as (
      select n, round(2 * squares / (2 * squares + 2 * (xy * xy / (xx * yy) + xz * xz / (xx * zz) + yz * yz / (yy * zz)) + 1e-10), 3) as kmo,
             -((n - 1) - 11 / 6.0::double) * ln(det) as chi2 from inverse),
    steps as (select kmo, chi2, least(sqrt(chi2), 12) / 400 as h, unnest(range(0, 401)) as k from tests)
    select kmo, round(chi2, 1) as bartlett_chi2,
      1 - sum(h / 3 * case when k in (0, 400) then 1 when k % 2 = 1 then 4 else 2 end
              * sqrt(2 / pi()) * (k * h) * (k * h) * exp(-(k * h) * (k * h) / 2)) as bartlett_p,
      3::int as bartlett_dof
    from steps group by kmo, chi2
    """,
    bartlett_p=6,
)
def _(t: Tables):
    m = _matrix(t)
    found = components.suitability(m.correlation(), m.n)
    return t.spark.createDataFrame([tuple(found)], "kmo double, bartlett_chi2 double, bartlett_p double, bartlett_dof int")


_VARIANCE = "component, eigenvalue, ratio, sum(ratio) over (order by j) as cumulative"


@query(
    "d09_eigenvalues_of_three",
    sql=_three(f"with {_FILLED}") + _R + f"final as (select {_VARIANCE} from components) select * from final",
    eigenvalue=6, ratio=6, cumulative=6,
)
def _(t: Tables):
    return components.variance_table(t.spark, components.spectrum(_matrix(t)), 10)


@query(
    "d10_kaiser_count_of_three",
    sql=_three(f"with {_FILLED}") + _R + """
    final as (select greatest(1, count(*) filter (where eigenvalue > 1))::int as kaiser from components) select * from final""",
)
def _(t: Tables):
    return t.spark.createDataFrame([(components.kaiser_count(components.spectrum(_matrix(t))),)], "kaiser int")


# Three eigenvalues that add up to three are not all above 1, so the count is 2 whatever the simulated thresholds are.
@query("d12_component_count_of_three", sql="select 2 as components")
def _(t: Tables):
    return t.spark.createDataFrame([(_fitted(t).n_components,)], "components int")


@query("d13_component_scores_of_three", sql=_three(f"with {_SCALED}") + _LOADED + "select * from scored", PC1=5, PC2=5)
def _(t: Tables):
    return _fitted(t).scores


@query("d13_loadings_of_three", sql=_three(f"with {_SCALED}") + _LOADED + "select component, metric, loading, ratio from loaded", loading=6, ratio=6)
def _(t: Tables):
    return _fitted(t).loadings


@query(
    "d14_feature_importance_of_three",
    sql=_three(f"with {_SCALED}") + _LOADED + "select metric, sum(abs(loading) * ratio) as importance from loaded group by metric",
    importance=6,
)
def _(t: Tables):
    return components.feature_importance(_fitted(t).loadings)


@query(
    "d18_biplot_of_three",
    sql=_three(f"with {_SCALED}") + _LOADED + """,
    arrows as (
      select metric, max(loading) filter (where j = 1) as x, max(loading) filter (where j = 2) as y from loaded group by metric),
    final as (
      select 'score' as kind, entity::varchar as label, "PC1" / max(greatest(abs("PC1"), abs("PC2"))) over () as x,
             "PC2" / max(greatest(abs("PC1"), abs("PC2"))) over () as y from scored
      union all
      select 'loading', metric, x / max(greatest(abs(x), abs(y))) over (), y / max(greatest(abs(x), abs(y))) over () from arrows)
    select * from final
    """,
    x=5, y=5,
)
def _(t: Tables):
    a = _fitted(t)
    return components.biplot(a.scores, "entity", a.loadings)


@query(
    "d21_top_loadings_of_three",
    sql=_three(f"with {_SCALED}") + _LOADED + """,
    ranked as (
      select component, metric, loading, row_number() over (partition by component order by abs(loading) desc, metric) as rank,
             case when loading > 0.3 then 'high positive' when loading < -0.3 then 'high negative' end as strong from loaded)
    select component, rank::int as rank, metric, loading,
      case when row_number() over (partition by component, strong order by rank) <= 3 then strong end as contribution
    from ranked
    """,
    loading=6,
)
def _(t: Tables):
    return components.top_loadings(_fitted(t).loadings)


@query(
    "d23_variance_explained_by_two_of_three",
    sql=_three(f"with {_FILLED}") + _R + f"final as (select {_VARIANCE} from components) select * from final where component <> 'PC3'",
    eigenvalue=6, ratio=6, cumulative=6,
)
def _(t: Tables):
    a = _fitted(t)
    return components.variance_table(t.spark, a.spectrum, a.n_components)


# Labels that SQL can form stand for those of k-means; the operator is the one that writes the export.
@query(
    "d24_component_export_of_three_given_labels",
    sql=_three(f"with {_SCALED}") + _LOADED + 'select entity, (entity % 3)::int + 1 as cluster, round_even("PC1", 4) as "PC1", round_even("PC2", 4) as "PC2", 0::double as "PC3" from scored',
    PC1=4, PC2=4,
)
def _(t: Tables):
    scores = _fitted(t).scores
    return components.export_table(scores.withColumn("cluster", (scores["entity"] % 3).cast("int")))
