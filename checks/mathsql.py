"""SQL text for the tail probabilities and line fits, written independently of Spark."""

from __future__ import annotations


def t_two_sided(t: str, df: str) -> str:
    """Series with closed-form (gamma function) coefficients."""
    v, tt = f"CAST({df} AS DOUBLE)", f"abs({t})"
    c2 = f"({v} / ({v} + {tt} * {tt}))"
    sin = f"({tt} / sqrt({v} + {tt} * {tt}))"
    even = (
        f"{sin} * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: "
        f"exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + k * ln({c2}))))"
    )
    odd = (
        f"2 / pi() * (atan({tt} / sqrt({v})) + {sin} * sqrt({c2}) * coalesce(list_sum(list_transform("
        f"range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda k: "
        f"exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5) + k * ln({c2})))), 0))"
    )
    return (
        f"(CASE WHEN {df} >= 1 AND {t} IS NOT NULL THEN greatest(0.0, 1 - "
        f"CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END) END)"
    )


def normal_two_sided(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    u = f"(1 / (1 + 0.3275911 * {x}))"
    poly = (
        f"(0.254829592 * {u} - 0.284496736 * pow({u}, 2) + 1.421413741 * pow({u}, 3)"
        f" - 1.453152027 * pow({u}, 4) + 1.061405429 * pow({u}, 5))"
    )
    return f"(1 - (1 - {poly} * exp(-{x} * {x})))"


def line(y: str, x: str) -> str:
    """Aggregates named cnt, sxx, syy, sxy, mx, my for a later :func:`slope` etc."""
    return (
        f"regr_count({y}, {x}) AS cnt, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, "
        f"regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my"
    )


SLOPE = "(sxy / nullif(sxx, 0))"
R2 = "(CASE WHEN sxx > 0 THEN least(1.0, coalesce(sxy * sxy / nullif(sxx * syy, 0), 0)) END)"
STD_ERROR = f"(CASE WHEN cnt > 2 THEN sqrt((1 - {R2}) * syy / nullif(sxx * (cnt - 2), 0)) END)"
_T = f"(sqrt({R2}) * sqrt((cnt - 2) / ((1 - sqrt({R2}) + 1e-20) * (1 + sqrt({R2}) + 1e-20))))"
P_VALUE = f"(CASE WHEN cnt > 2 AND sxx > 0 THEN {t_two_sided(_T, '(cnt - 2)')} END)"


def strength(slope: str, std: str) -> str:
    rel = f"(abs({slope}) / nullif({std}, 0))"
    return (
        f"(CASE WHEN {std} = 0 THEN 'undefined' WHEN {rel} > 0.2 THEN 'very_strong' WHEN {rel} > 0.1 THEN 'strong' "
        f"WHEN {rel} > 0.05 THEN 'moderate' WHEN {rel} > 0.01 THEN 'weak' ELSE 'negligible' END)"
    )


def zone(lat: str) -> str:
    return (
        f"(CASE WHEN abs({lat}) < 10 THEN 'equatorial' WHEN abs({lat}) < 23.5 THEN 'tropical' "
        f"WHEN abs({lat}) < 35 THEN 'subtropical' WHEN abs({lat}) < 60 THEN 'temperate' ELSE 'polar' END)"
    )


def season(month: str) -> str:
    return (
        f"(CASE WHEN {month} IN (12, 1, 2) THEN 'winter' WHEN {month} IN (3, 4, 5) THEN 'spring' "
        f"WHEN {month} IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END)"
    )


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def mean_cents(x: str) -> str:
    """Mean of 2-decimal values, half-even to 2 decimals, in whole numbers."""
    s, n = f"CAST(sum(round({x} * 100)) AS BIGINT)", f"count({x})"
    up = f"(2 * ({s} % {n}) > {n} OR (2 * ({s} % {n}) = {n} AND ({s} // {n}) % 2 = 1))"
    return f"(CASE WHEN {n} > 0 THEN ({s} // {n} + CASE WHEN {up} THEN 1 ELSE 0 END) / 100.0 END)"
