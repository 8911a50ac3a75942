"""Column expressions shared by the operators. Everything here stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tremora import config as C


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rnd(c, digits: int = 6) -> Column:
    """Rounded value with the sign of zero erased, for reports and comparisons."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def ratio(num, den) -> Column:
    return as_col(num) / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def steps(x, table, otherwise) -> Column:
    """Step function: the value of the first edge strictly above ``x``."""
    out = None
    for edge, value in table:
        cond = as_col(x) < F.lit(float(edge))
        out = F.when(cond, float(value)) if out is None else out.when(cond, float(value))
    return out.otherwise(float(otherwise))


def ebic_gamma(n_over_p) -> Column:
    return steps(n_over_p, C.GAMMA_STEPS, C.GAMMA_ELSE)


def shrinkage_delta(n_over_p) -> Column:
    return steps(n_over_p, C.DELTA_STEPS, C.DELTA_ELSE)


def clip(x, bound: float = C.CLIP) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), as_col(x)))


def negative_part(x) -> Column:
    return F.least(as_col(x), F.lit(0.0))


def finite_or_zero(x) -> Column:
    c = as_col(x)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def log_return(simple) -> Column:
    return F.log1p(as_col(simple))


def whole_number(text) -> Column:
    """Integer out of a quote cell with thousands separators, NULL when malformed."""
    return F.regexp_replace(as_col(text), ",", "").try_cast("bigint")


def decimal_number(text) -> Column:
    return F.regexp_replace(as_col(text), ",", "").try_cast("double")


def fixed(x, places: int = 3) -> Column:
    """Fixed-point text of a number, an em dash when missing."""
    return F.coalesce(F.format_string(f"%.{places}f", as_col(x)), F.lit("--"))


def share_of(x, *keys) -> Column:
    return ratio(x, F.sum(as_col(x)).over(Window.partitionBy(*keys)))
