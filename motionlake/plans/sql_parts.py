"""SQL fragments for statistics that SQL lacks; written on gamma functions, unlike the Spark side."""

from __future__ import annotations


def t_two_sided(t: str, dof: str) -> str:
    """Two-sided Student p-value for integer degrees of freedom (finite series with lgamma)."""
    cos2 = f"({dof} / ({dof} + ({t}) * ({t})))"
    sine = f"(abs({t}) / sqrt({dof} + ({t}) * ({t})))"
    even = (
        f"{sine} * coalesce(list_sum(list_transform(range(0, cast({dof} as bigint) // 2), "
        f"lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln({cos2})))), 0)"
    )
    odd = (
        f"2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sine} * sqrt({cos2}) * "
        f"coalesce(list_sum(list_transform(range(0, (cast({dof} as bigint) - 1) // 2), "
        f"lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + lgamma(1.5) + k * ln({cos2})))), 0))"
    )
    return f"greatest(0, least(1, 1 - case when {dof} % 2 = 0 then {even} else {odd} end))"


def normal_cdf(z: str) -> str:
    """Normal CDF by the incomplete-gamma series at a = 1/2."""
    half = f"(({z}) * ({z}) / 2)"
    series = (
        f"list_sum(list_transform(range(0, 200), lambda k: "
        f"exp((k + 0.5) * ln({half}) - {half} - lgamma(k + 1.5))))"
    )
    return (
        f"case when {z} is null then null when {z} = 0 then 0.5 when abs({z}) > 8 then (case when {z} > 0 then 1.0 else 0.0 end) "
        f"else 0.5 + sign({z}) * 0.5 * {series} end"
    )


def t_test(prefix1: str, prefix2: str) -> tuple[str, str]:
    """(p, d) from columns ``<prefix>_n``, ``<prefix>_mean``, ``<prefix>_var``."""
    n1, n2 = f"{prefix1}_n", f"{prefix2}_n"
    dof = f"({n1} + {n2} - 2)"
    pooled = f"sqrt((({n1} - 1) * {prefix1}_var + ({n2} - 1) * {prefix2}_var) / {dof})"
    t = f"(({prefix1}_mean - {prefix2}_mean) / ({pooled} * sqrt(1.0 / {n1} + 1.0 / {n2})))"
    both = f"{n1} > 1 and {n2} > 1"
    p = (
        f"case when not ({both}) then null when {pooled} = 0 then "
        f"(case when {prefix1}_mean = {prefix2}_mean then null else 0.0 end) else {t_two_sided(t, dof)} end"
    )
    d = (
        f"case when not ({both}) then null when {pooled} = 0 then 0.0 "
        f"else ({prefix2}_mean - {prefix1}_mean) / {pooled} end"
    )
    return p, d


def risk(gap: str) -> str:
    return f"case when {gap} is null then null when {gap} < 5 then 'Low' when {gap} < 10 then 'Moderate' else 'High' end"


def retention_label(value: str) -> str:
    return (
        f"case when {value} is null then null when {value} > 65 then 'Force-Dominant' "
        f"when {value} > 50 then 'Balanced' else 'Velocity-Dominant' end"
    )
