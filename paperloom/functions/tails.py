"""Tail probabilities of the t, F, chi-squared and normal distributions, and the normal quantile, as Spark expressions.

The incomplete beta function is a continued fraction, the incomplete gamma function a series or a continued fraction, as in
standard numerical texts; each is summed from its far end, with as many terms as its parameters need, by F.aggregate. The
quantile is found by Newton's steps. Values outside a function's domain give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a sum: these many, and these many times the square root of the largest parameter.
LEAST, BY_ROOT = 24, 5
STEPS = 40


def let(values: dict[str, Column], f: Callable[..., Column]) -> Column:
    """f of values that are computed once."""
    row = F.struct(*(v.cast("double").alias(k) for k, v in values.items()))
    return F.transform(F.array(row), lambda r: f(**{k: r[k] for k in values}))[0]


def _over(a, b) -> Column:
    return F.try_divide(a if isinstance(a, Column) else F.lit(float(a)), b)


def _from_far_end(largest: Column, step: Callable[[Column, Column], Column], start: float = 0.0) -> Column:
    """step(so far, k) for k from the number of terms down to 1."""
    terms = F.least(F.lit(20_000.0), LEAST + BY_ROOT * F.sqrt(largest)).cast("int")
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(start), lambda so_far, k: step(so_far, k.cast("double")))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8."""

    def at(x: Column) -> Column:
        big, below = x + 8, x
        for k in range(1, 8):
            below = below * (x + k)
        r = _over(1, big * big)
        # Stirling's series.
        series = F.lit(-691 / 360360)
        for c in (1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12):
            series = F.lit(c) + r * series
        return (big - 0.5) * F.log(big) - big + 0.5 * math.log(2 * math.pi) + _over(series, big) - F.log(below)

    return let({"x": x}, at)


def beta_inc(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function at x. rest: 1 - x, which the caller may know better."""

    def fraction(p: Column, q: Column, y: Column) -> Column:
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y))

        def pair(so_far: Column, m: Column) -> Column:
            at = p + 2 * m
            odd = _over(-(p + m) * (p + q + m) * y, at * (at + 1))
            return _over(_over(m * (q - m) * y, (at - 1) * at), 1 + _over(odd, 1 + so_far))

        first = _over(-(p + q) * y, p + 1)
        return F.when(y <= 0, 0.0).otherwise(_over(front, p * (1 + _over(first, 1 + _from_far_end(F.greatest(p, q), pair)))))

    def turned(a: Column, b: Column, x: Column, rest: Column) -> Column:
        turn = x > _over(a + 1, a + b + 2)
        value = let({"p": F.when(turn, b).otherwise(a), "q": F.when(turn, a).otherwise(b), "y": F.when(turn, rest).otherwise(x)}, fraction)
        return F.when((a > 0) & (b > 0), F.when(turn, 1 - value).otherwise(value))

    return let({"a": a, "b": b, "x": x, "rest": rest}, turned)


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function."""

    def at(a: Column, x: Column) -> Column:
        front = F.exp(-x + a * F.log(x) - log_gamma(a))
        series = _from_far_end(4 * a, lambda so_far, k: 1 + _over(x, a + k) * so_far, 1.0)
        fraction = _from_far_end(4 * a, lambda so_far, k: _over(k * (a - k), x + 2 * k + 1 - a + so_far))
        value = F.when(x < a + 1, 1 - _over(front, a) * series).otherwise(_over(front, x + 1 - a + fraction))
        return F.when(a > 0, F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))

    return let({"a": a, "x": x}, at)


def t_two_sided(t: Column, df: Column) -> Column:
    return let({"t": t, "df": df}, lambda t, df: beta_inc(df / 2, F.lit(0.5), _over(df, df + t * t), _over(t * t, df + t * t)))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    return let({"f": F.greatest(f, F.lit(0.0)), "df1": df1, "df2": df2}, lambda f, df1, df2: beta_inc(df2 / 2, df1 / 2, _over(df2, df2 + df1 * f), _over(df1 * f, df2 + df1 * f)))


def r_two_sided(r: Column, df: Column) -> Column:
    """Of a correlation, from -1 to 1."""
    return let({"r": r, "df": df}, lambda r, df: beta_inc(df / 2, F.lit(0.5), 1 - r * r, r * r))


def chi2_upper(x: Column, df: Column) -> Column:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: Column) -> Column:
    return let({"z": z}, lambda z: gamma_upper(F.lit(0.5), z * z / 2))


def normal_quantile(p: Column) -> Column:
    """z such that a normal value is below it with probability p, 0 < p < 1."""

    def steps(p: Column) -> Column:
        far = F.greatest(p, 1 - p)  # z >= 0, where each step from 0 on falls short of it
        missing = lambda z: far - 1 + normal_two_sided(z) / 2
        density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        z = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), lambda z, _: z + _over(missing(z), density(z)))
        return F.when((p > 0) & (p < 1), F.when(p < 0.5, -z).otherwise(z))

    return let({"p": p}, steps)
