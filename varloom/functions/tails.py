"""Tail probabilities as expressions, in double precision and without Python workers; what is SQL text runs in Spark and DuckDB alike."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Cody's published rational approximations of erf and erfc (relative error about 1e-16), by range of the argument, in his order.
CODY_A = (3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153)
CODY_B = (23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062)
CODY_C = (0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8)
CODY_D = (15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942)
CODY_P = (0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766, 6.58749161529837803e-4, 0.0163153871373020978)
CODY_Q = (2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 2.33520497626869185e-3)
SQRT_PI = 1.7724538509055160

#: Terms of the series of the incomplete beta function; its argument is at most one half.
TERMS = 64


def _n(x: float) -> str:
    return f"cast({x!r} as double)"


def _ratio(top, bottom, x: str) -> str:
    """The last number of ``top`` leads; the others follow, as in the published scheme, and the leading one of ``bottom`` is 1."""
    up, down = f"({_n(top[-1])}*{x})", x
    for k in range(len(top) - 2):
        up, down = f"(({up}+{_n(top[k])})*{x})", f"(({down}+{_n(bottom[k])})*{x})"
    return f"(({up}+{_n(top[len(top) - 2])})/({down}+{_n(bottom[len(top) - 2])}))"


def erfc_sql(x: str) -> str:
    """erfc of an SQL expression of at least 0, best the name of a column; null of null."""
    y = f"(({x})*({x}))"
    small = f"(1-({x})*{_ratio(CODY_A, CODY_B, y)})"
    mid = f"(exp(-{y})*{_ratio(CODY_C, CODY_D, f'({x})')})"
    z = f"(1/{y})"
    large = f"(exp(-{y})/({x})*({_n(1 / SQRT_PI)}-{z}*{_ratio(CODY_P, CODY_Q, z)}))"
    return f"(case when ({x})<=0.46875 then {small} when ({x})<=4 then {mid} when ({x})<38 then {large} when ({x})>=38 then {_n(0.0)} end)"


def norm_two_sided_sql(z: str) -> str:
    """P of a normal deviate at least as far from 0."""
    return erfc_sql(f"(abs({z})*{_n(0.5**0.5)})")


def _gamma_ratio(a: str) -> str:
    """Gamma(a + 1/2) / Gamma(a): ten steps of recursion, then its asymptotic series."""
    steps = "*".join(f"((({a})+{k})/(({a})+{k + 0.5}))" for k in range(10))
    b = f"(({a})+10)"
    series = f"exp(-1/(8*{b})+1/(192*{b}*{b}*{b})-1/(640*{b}*{b}*{b}*{b}*{b})+{_n(17.0)}/(14336*{b}*{b}*{b}*{b}*{b}*{b}*{b}))"
    return f"({steps}*sqrt({b})*{series})"


def _series(x: Column, a: Column, b: Column) -> Column:
    """1 + (a+b)/(a+1) x + (a+b)(a+b+1)/((a+1)(a+2)) x^2 + ..., ``TERMS`` terms of it."""

    def step(acc, k):
        term = acc["term"] * (a + b + k) / (a + 1 + k) * x
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term")), step, lambda acc: acc["total"])


def hill_sql(t: str, df: str) -> str:
    """Hill's deviate h of a Student's t, so that P of a t at least as far from 0 is erfc(h): for 20 degrees of freedom or more and t*t below them."""
    y = f"(({t})*({t}))"
    n = f"(cast({df} as double)-0.5)"
    b = f"(48*{n}*{n})"
    v = f"({n}*(case when {y}/{df}>1e-6 then ln(1+{y}/{df}) else {y}/{df}-{y}*{y}/{df}/{df}/2 end))"
    return f"((((((-0.4*{v}-3.3)*{v}-24)*{v}-85.5)/(0.8*{v}*{v}+100+{b})+{v}+3)/{b}+1)*sqrt({v}*0.5))"


def t_two_sided(t: str, df: str, h: str) -> Column:
    """P of a Student's t at least as far from 0; ``t``, ``df`` (at least 1) and ``h`` (``hill_sql`` of them) name columns.

    Hill's deviate where it is precise; for few degrees of freedom and in far tails, a fixed number of terms of the power series of
    the incomplete beta function, on the side where its argument is at most one half.
    """
    a, y, n = F.col(df).cast("double") / 2, F.col(t) * F.col(t), F.col(df).cast("double")
    x, u = n / (n + y), y / (n + y)
    front = F.pow(x, a) * F.sqrt(u) * F.expr(_gamma_ratio(f"(cast({df} as double)/2)")) / SQRT_PI
    far = front / a * _series(x, a, F.lit(0.5))
    near = 1 - front * 2 * _series(u, F.lit(0.5), a)
    return F.when(y >= n, far).when(n < 20, near).otherwise(F.expr(erfc_sql(h)))


def lgamma(x: Column) -> Column:
    """ln Gamma of a number of 1 or more: eight steps of recursion, then Stirling's series."""
    x = x.cast("double")
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    steps = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + series - steps


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_upper(a: Column, drawn: Column, marked: Column, n: Column) -> Column:
    """P that at least ``a`` of ``drawn`` of n are marked, where ``marked`` are; terms are added one by one."""
    last = F.least(drawn, marked)
    none = log_choose(n, drawn)
    term = lambda k: F.exp(log_choose(marked, k) + log_choose(n - marked, drawn - k) - none)
    first = F.greatest(a, drawn + marked - n, F.lit(0))
    return F.when(a <= F.greatest(drawn + marked - n, F.lit(0)), 1.0).when(first > last, 0.0).otherwise(F.aggregate(F.sequence(first, last), F.lit(0.0), lambda acc, k: acc + term(k)))


def with_t(df: DataFrame, effect: str, se: str, freedom: Column, upper: bool = False) -> DataFrame:
    """``df`` with P of effect / se, two-sided or (``upper``) of a larger one; null without a positive se."""
    gone = ["_t", "_df", "_h"]
    df = barrier(df.withColumns({"_t": F.when(F.col(se) > 0, F.col(effect) / F.col(se)), "_df": freedom}))
    df = barrier(df.withColumn("_h", F.expr(hill_sql("_t", "_df"))))
    both = t_two_sided("_t", "_df", "_h")
    if not upper:
        return df.withColumn("P", both).drop(*gone)
    df = barrier(df.withColumn("P", both))
    return df.withColumn("P", F.when(F.col("_t") > 0, F.col("P") / 2).otherwise(1 - F.col("P") / 2)).drop(*gone)


def barrier(df: DataFrame) -> DataFrame:
    """``df`` behind a one-row generator, so that long expressions on its columns aren't inlined into each other."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


#: Normal deviates that 2.5 % and 5 % exceed.
Z975, Z950 = 1.959963984540054, 1.6448536269514722


def t_quantile_sql(df: str, z: float = Z975) -> str:
    """The t that as much exceeds as exceeds the normal deviate ``z``, by the Cornish-Fisher series; for checks with 90 degrees of freedom or more."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    out = _n(z)
    for k, c in enumerate(terms, 1):
        out += f"+{_n(c)}/pow(cast({df} as double),{k})"
    return f"({out})"
