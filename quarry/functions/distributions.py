"""Tail probabilities for test statistics (t, F, chi-square, normal) as built-in expressions.

A tail is the ratio of two integrals of one density shape, by Simpson's rule on a fixed grid. The
substitutions keep the shape smooth and without gamma functions: for F, theta = atan(sqrt(d1 f / d2))
gives sin^(d1 - 1) cos^(d2 - 1); for chi-square, s = sqrt(x) gives s^(k - 1) exp(-s^2 / 2). Shapes are
divided by their top, and the grid ends where what is left is far below a double's precision. The
t and the normal distribution are the cases t^2 = F(1, d) and z^2 = chi-square(1).

``*_sql`` write the same expression for DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the grid, and how many standard deviations past the centre it reaches.
STEPS = 2000
REACH = 12.0


def _simpson(shape, a: Column, b: Column) -> Column:
    h = (b - a) / STEPS

    def step(acc: Column, i: Column) -> Column:
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return acc + weight * shape(a + i * h)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), step) * h / 3


def _log_power(base: Column, power: Column) -> Column:
    return F.when(power == 0, 0.0).when(base <= 0, F.lit(float("-inf"))).otherwise(power * F.ln(base))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    """Upper-tail p of an F statistic; NULL without positive degrees of freedom."""
    f, d1, d2 = f.cast("double"), d1.cast("double"), d2.cast("double")
    top = F.least(F.lit(math.pi / 2), (F.sqrt(d1) + REACH) / F.sqrt(d2) * 2)
    mode = F.when((d1 > 1) & (d2 > 1), F.atan(F.sqrt((d1 - 1) / (d2 - 1)))).otherwise(F.lit(math.pi / 4))
    peak = F.when(d1 > 1, _log_power(F.sin(mode), d1 - 1) + _log_power(F.cos(mode), d2 - 1)).otherwise(0.0)
    shape = lambda t: F.exp(_log_power(F.sin(t), d1 - 1) + _log_power(F.cos(t), d2 - 1) - peak)
    at = F.least(top, F.atan(F.sqrt(d1 * F.greatest(f, F.lit(0.0)) / d2)))
    return F.when((d1 > 0) & (d2 > 0) & f.isNotNull(), _simpson(shape, at, top) / _simpson(shape, F.lit(0.0), top))


def chi2_pvalue(x: Column, dof: Column) -> Column:
    """Upper-tail p of a chi-square statistic; NULL without positive degrees of freedom."""
    x, k = x.cast("double"), dof.cast("double")
    low, top = F.greatest(F.lit(0.0), F.sqrt(k) - REACH), F.sqrt(k) + REACH
    peak = F.when(k > 1, (k - 1) / 2 * F.ln(k - 1) - (k - 1) / 2).otherwise(0.0)
    shape = lambda s: F.exp(_log_power(s, k - 1) - s * s / 2 - peak)
    at = F.least(top, F.greatest(low, F.sqrt(F.greatest(x, F.lit(0.0)))))
    return F.when((k > 0) & x.isNotNull(), _simpson(shape, at, top) / _simpson(shape, low, top))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic."""
    return f_pvalue(t.cast("double") * t.cast("double"), F.lit(1.0), dof)


def normal_two_sided_p(z: Column) -> Column:
    return chi2_pvalue(z * z, F.lit(1.0))


# ------------------------------------------------------------------ SQL twins


def _simpson_sql(shape, a: str, b: str) -> str:
    x = f"(({a}) + i * ((({b}) - ({a})) / {STEPS}))"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)::DOUBLE"
    return f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {weight} * {shape(x)})) * ((({b}) - ({a})) / {STEPS}) / 3)"


def _log_power_sql(base: str, power: str) -> str:
    return f"(CASE WHEN {power} = 0 THEN 0.0 WHEN {base} <= 0 THEN '-infinity'::DOUBLE ELSE {power} * ln({base}) END)"


def f_pvalue_sql(f: str, d1: str, d2: str) -> str:
    f, d1, d2 = (f"CAST({x} AS DOUBLE)" for x in (f, d1, d2))
    top = f"least(pi() / 2, (sqrt({d1}) + {REACH}) / sqrt({d2}) * 2)"
    mode = f"(CASE WHEN {d1} > 1 AND {d2} > 1 THEN atan(sqrt(({d1} - 1) / ({d2} - 1))) ELSE pi() / 4 END)"
    both = lambda t: f"({_log_power_sql(f'sin({t})', f'({d1} - 1)')} + {_log_power_sql(f'cos({t})', f'({d2} - 1)')})"
    peak = f"(CASE WHEN {d1} > 1 THEN {both(mode)} ELSE 0.0 END)"
    shape = lambda t: f"exp({both(t)} - {peak})"
    at = f"least({top}, atan(sqrt({d1} * greatest({f}, 0.0) / {d2})))"
    return f"({_simpson_sql(shape, at, top)} / {_simpson_sql(shape, '0.0::DOUBLE', top)})"


def chi2_pvalue_sql(x: str, dof: str) -> str:
    x, k = f"CAST({x} AS DOUBLE)", f"CAST({dof} AS DOUBLE)"
    low, top = f"greatest(0.0, sqrt({k}) - {REACH})", f"(sqrt({k}) + {REACH})"
    peak = f"(CASE WHEN {k} > 1 THEN ({k} - 1) / 2 * ln({k} - 1) - ({k} - 1) / 2 ELSE 0.0 END)"
    shape = lambda s: f"exp({_log_power_sql(s, f'({k} - 1)')} - {s} * {s} / 2 - {peak})"
    at = f"least({top}, greatest({low}, sqrt(greatest({x}, 0.0))))"
    return f"({_simpson_sql(shape, at, top)} / {_simpson_sql(shape, low, top)})"


# The rational approximation of the normal distribution by Hart (1968), as given by
# West (2005); it is exact to double precision.
NORMAL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
              220.206867912376]
NORMAL_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
                 793.826512519948, 440.413735824752]


def normal_cdf(z: Column) -> Column:
    """Share of the standard normal distribution up to z."""
    x = F.abs(z)

    def poly(coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    near = F.exp(-x * x / 2) * poly(NORMAL_TOP) / poly(NORMAL_BOTTOM)
    far = F.exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / math.sqrt(2 * math.pi)
    tail = F.when(x > 37, 0.0).when(x < 5 * math.sqrt(2), near).otherwise(far)
    return F.when(z.isNotNull(), F.when(z > 0, 1 - tail).otherwise(tail))


def normal_cdf_sql(z: str) -> str:
    """``normal_cdf`` for DuckDB; ``z`` is written out several times, so give a column."""
    x = f"abs({z})"

    def poly(coefficients: list[float]) -> str:
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    near = f"exp(-{x} * {x} / 2) * {poly(NORMAL_TOP)} / {poly(NORMAL_BOTTOM)}"
    far = f"exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65))))) / {math.sqrt(2 * math.pi)!r}"
    tail = f"CASE WHEN {x} > 37 THEN 0.0 WHEN {x} < {5 * math.sqrt(2)!r} THEN {near} ELSE {far} END"
    return f"CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE {tail} END"


# Terms of either series of the Kolmogorov distribution; at the point where they take turns the
# fifth is below 1e-15.
KOLMOGOROV_TERMS = 5
KOLMOGOROV_TURN = 1.18


def kolmogorov_tail(x: Column) -> Column:
    """Probability that the Kolmogorov statistic exceeds x (0 or less: 1)."""
    low = sum((F.exp(F.lit(-(2 * k - 1) ** 2 * math.pi ** 2 / 8) / (x * x)) for k in range(1, KOLMOGOROV_TERMS + 1)), F.lit(0.0))
    high = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, KOLMOGOROV_TERMS + 1)), F.lit(0.0))
    return F.when(x <= 0, 1.0).when(x < KOLMOGOROV_TURN, 1 - math.sqrt(2 * math.pi) / x * low).when(x.isNotNull(), 2 * high)


def kolmogorov_tail_sql(x: str) -> str:
    low = " + ".join(f"exp({-(2 * k - 1) ** 2 * math.pi ** 2 / 8!r} / ({x} * {x}))" for k in range(1, KOLMOGOROV_TERMS + 1))
    high = " + ".join(f"({(-1) ** (k - 1)}) * exp(-{2.0 * k * k} * {x} * {x})" for k in range(1, KOLMOGOROV_TERMS + 1))
    return (f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} < {KOLMOGOROV_TURN} THEN 1 - {math.sqrt(2 * math.pi)!r} / {x} * ({low}) "
            f"ELSE 2 * ({high}) END")
