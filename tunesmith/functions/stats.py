"""Column expressions: standard normal cdf/pdf, expected improvement, tie-averaged ranks.

Everything here is a plain Column expression (JVM-side, inside whole-stage codegen).
Neither Spark SQL nor DuckDB has ``erf``, so Phi is built from rational Chebyshev approximations of erfc in
double precision. The same formula is rendered as SQL text (``normal_cdf_sql``) for the DuckDB oracle, so the
oracle checks the plumbing; a unit test checks Phi itself against ``math.erfc``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Coefficients of W. J. Cody, "Rational Chebyshev approximations for the error function", Math. Comp. 23 (1969),
# numerators and denominators from the highest power down.
# erf(x) = x N(x^2) / D(x^2) for |x| <= 0.46875
ERF_N = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_D = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
# erfc(x) = exp(-x^2) N(x) / D(x) for 0.46875 < x <= 4
ERFC_N = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
          8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
          4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
# erfc(x) = exp(-x^2) / x (1 / sqrt(pi) - y N(y) / D(y)), y = 1 / x^2, for x > 4
TAIL_N = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
          6.58749161529837803e-4)
TAIL_D = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
NEAR, FAR = 0.46875, 4.0
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)
SQRT2 = math.sqrt(2.0)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)
DEGENERATE_SIGMA = 1e-5  # sigma at or below this gives EI = -1
DEFAULT_XI = -0.01  # reference lowers the incumbent by 0.01: d = mu - (best - 0.01)


def _horner(t: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * t + F.lit(c)
    return acc


def erfc(x: Column) -> Column:
    z = F.abs(x)
    square = z * z
    near = F.lit(1.0) - x * _horner(square, ERF_N) / _horner(square, ERF_D)
    middle = F.exp(-square) * _horner(z, ERFC_N) / _horner(z, ERFC_D)
    y = F.lit(1.0) / square
    far = F.exp(-square) / z * (F.lit(INV_SQRT_PI) - y * _horner(y, TAIL_N) / _horner(y, TAIL_D))
    right = F.when(z <= FAR, middle).otherwise(far)
    return F.when(z <= NEAR, near).when(x > 0, right).otherwise(F.lit(2.0) - right)


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * erfc(-z / F.lit(SQRT2))


def normal_pdf(z: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * z * z)


def expected_improvement(mu: Column, sigma: Column, best, xi: float = DEFAULT_XI) -> Column:
    """A1/A2: EI = d*Phi(d/sigma) + sigma*phi(d/sigma), d = mu - (best + xi); sigma <= 1e-5 -> -1."""
    best_c = best if isinstance(best, Column) else F.lit(float(best))
    d = mu - (best_c + F.lit(xi))
    z = d / F.when(sigma > F.lit(DEGENERATE_SIGMA), sigma)  # never divide by a degenerate sigma
    ei = d * normal_cdf(z) + sigma * normal_pdf(z)
    return F.when(sigma <= F.lit(DEGENERATE_SIGMA), F.lit(-1.0)).otherwise(ei)


def effective_seconds(seconds: Column, min_time) -> Column:
    """A5: predicted run time <= 0 (or not a number) falls back to the smallest observed evaluation time."""
    m = min_time if isinstance(min_time, Column) else F.lit(float(min_time))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), m).otherwise(seconds)


def ei_per_second(ei: Column, seconds: Column, min_time, root: bool = False) -> Column:
    """A3/A4: EI / seconds or EI / sqrt(seconds) (the -1 sentinel is divided as well)."""
    s = effective_seconds(seconds, min_time)
    s = F.when(s > 0, s)  # a zero smallest-observed time cannot be divided by
    return ei / (F.sqrt(s) if root else s)


def avg_tie_rank(value: str, partition: list[str], ascending: bool = True) -> Column:
    """Rank within ``partition`` with ties given the mean of their positions (pandas 'average')."""
    o = F.col(value).asc() if ascending else F.col(value).desc()
    w = Window.partitionBy(*partition).orderBy(o)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(w).cast("double") + (F.count(F.lit(1)).over(ties) - 1).cast("double") / 2.0


# ---- SQL renderings for the DuckDB oracle -------------------------------------------------

def _horner_sql(t: str, coefficients) -> str:
    acc = repr(coefficients[0])
    for c in coefficients[1:]:
        acc = f"({acc} * {t} + {c!r})"
    return acc


def normal_cdf_sql(z: str) -> str:
    # Phi(z) = erfc(x) / 2 with x = -z / sqrt 2, by the three ranges of |x|
    x = f"(-({z}) / {SQRT2!r})"
    ax = f"abs({x})"
    square, y = f"({x} * {x})", f"(1.0 / ({x} * {x}))"
    near = f"(1.0 - {x} * {_horner_sql(square, ERF_N)} / {_horner_sql(square, ERF_D)})"
    middle = f"(exp(-{square}) * {_horner_sql(ax, ERFC_N)} / {_horner_sql(ax, ERFC_D)})"
    far = f"(exp(-{square}) / {ax} * ({INV_SQRT_PI!r} - {y} * {_horner_sql(y, TAIL_N)} / {_horner_sql(y, TAIL_D)}))"
    right = f"(CASE WHEN {ax} <= {FAR!r} THEN {middle} ELSE {far} END)"
    return f"(0.5 * CASE WHEN {ax} <= {NEAR!r} THEN {near} WHEN {x} > 0 THEN {right} ELSE 2.0 - {right} END)"


def normal_pdf_sql(z: str) -> str:
    return f"({INV_SQRT_2PI!r} * exp(-0.5 * ({z}) * ({z})))"


def expected_improvement_sql(mu: str, sigma: str, best: str, xi: float = DEFAULT_XI) -> str:
    d = f"(({mu}) - (({best}) + ({xi!r})))"
    z = f"({d} / ({sigma}))"
    return (f"CASE WHEN ({sigma}) <= {DEGENERATE_SIGMA!r} THEN -1.0 "
            f"ELSE {d} * {normal_cdf_sql(z)} + ({sigma}) * {normal_pdf_sql(z)} END")
