"""Spark expressions for distributions and numeric helpers; SQL text of the same for oracles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Chebyshev coefficients of the published complementary error function approximation (relative error 1.2e-7), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
ACKLAM_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
ACKLAM_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
PI = 3.141592653589793


def _horner(coefficients, x: str, highest_first: bool) -> str:
    c = list(coefficients) if highest_first else list(reversed(coefficients))
    out = f"cast({c[0]!r} as double)"
    for k in c[1:]:
        out = f"({out}*{x}+cast({k!r} as double))"
    return out


def erfc_sql(x: str) -> str:
    """erfc of an SQL expression; the same text runs in Spark and DuckDB."""
    t = f"(cast(1 as double)/(cast(1 as double)+cast(0.5 as double)*abs({x})))"
    tail = f"({t}*exp(-({x})*({x})+{_horner(ERFC, t, False)}))"
    return f"(case when ({x})>=0 then {tail} else cast(2 as double)-{tail} end)"


def qnorm_sql(p: str) -> str:
    """The normal quantile of an SQL expression; -Infinity and Infinity at 0 and 1."""
    q, low, high = f"(({p})-cast(0.5 as double))", f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-({p})))"
    one = lambda q: f"({_horner(ACKLAM_C, q, True)}/({_horner(ACKLAM_D, q, True)}*{q}+1))"
    mid = f"({_horner(ACKLAM_A, f'({q}*{q})', True)}*{q}/({_horner(ACKLAM_B, f'({q}*{q})', True)}*({q}*{q})+1))"
    return f"(case when ({p})<=0 then cast('-Infinity' as double) when ({p})>=1 then cast('Infinity' as double) when ({p})<0.02425 then {one(low)} when ({p})>0.97575 then -{one(high)} else {mid} end)"


def chisq1_tail_sql(x: str) -> str:
    return erfc_sql(f"sqrt(({x})/2)")


def norm_tail_sql(z: str) -> str:
    return f"(cast(0.5 as double)*{erfc_sql(f'(({z})/sqrt(cast(2 as double)))')})"


def cauchy_tail_sql(t: str) -> str:
    """P(Cauchy > t), precise in the far tail."""
    return f"(case when ({t})>1 then atan(1/({t}))/{PI} else cast(0.5 as double)-atan({t})/{PI} end)"


def acat_term_sql(p: str) -> str:
    return f"(case when ({p})<1e-15 then 1/(({p})*{PI}) else tan((cast(0.5 as double)-({p}))*{PI}) end)"


def acat_p(p: str, w: str | None = None) -> Column:
    """Aggregate: the Cauchy combination of a column of P-values, weighted by another if one is named."""
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    total = F.sum(weight * F.expr(acat_term_sql(p))) / F.sum(weight)
    return F.when(total > 1, F.atan(1 / total) / PI).otherwise(0.5 - F.atan(total) / PI)


def signif(x: Column, digits: int = 6) -> Column:
    """Rounded to significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.rint(x * scale) / scale)


def r6(x: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)
