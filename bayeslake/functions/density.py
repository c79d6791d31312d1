"""Column expressions for the factors, all in the log domain.

Everything stays a built-in Catalyst expression (codegen'd), never a UDF.
A zero factor is encoded as ``-inf``: Spark returns NULL for ``ln(0)``, so
every logarithm is guarded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
LOG_2PI = math.log(2.0 * math.pi)


def col(name: str) -> Column:
    """Column by exact name (names may be digits or contain dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def neg_inf() -> Column:
    return F.lit(NEG_INF)


def safe_log(p: Column) -> Column:
    """ln(p) for p > 0, -inf for p = 0 (or NULL)."""
    return F.when(p > 0, F.ln(p)).otherwise(neg_inf())


def log_const(p: float) -> Column:
    return F.lit(math.log(p) if p > 0 else NEG_INF)


def log_normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    """ln phi(x; mean, sd); assumes sd > 0."""
    z = (x - mean) / sd
    return F.lit(-0.5) * z * z - F.ln(sd) - F.lit(0.5 * LOG_2PI)


def log_bivariate_pdf(x: Column, mx: Column, sx: Column,
                      y: Column, my: Column, sy: Column, rho: Column) -> Column:
    """ln of the bivariate normal density; assumes sx, sy > 0 and |rho| < 1."""
    zx = (x - mx) / sx
    zy = (y - my) / sy
    one_m = F.lit(1.0) - rho * rho
    s = zx * zx + zy * zy - F.lit(2.0) * rho * zx * zy
    return (F.lit(-LOG_2PI) - F.ln(sx) - F.ln(sy) - F.lit(0.5) * F.ln(one_m)
            - s / (F.lit(2.0) * one_m))


def class_density_term(x: Column, mean: Column, sd: Column) -> Column:
    """Log density of a continuous parent given the class of a discrete
    child: sd = 0 makes the factor 0; a NULL value is marginalised (1)."""
    return (F.when(x.isNull(), F.lit(0.0))
            .when(sd.isNull() | (sd <= 0), neg_inf())
            .otherwise(log_normal_pdf(x, mean, sd)))




def pair_density_term(x: Column, mx: Column, sx: Column,
                      y: Column, my: Column, sy: Column, rho: Column) -> Column:
    """Log joint density of (parent x, child y); degenerate parameters
    (sd = 0, rho NULL or |rho| >= 1) make the factor 0; NULL values are
    marginalised."""
    bad = (sx.isNull() | sy.isNull() | (sx <= 0) | (sy <= 0)
           | rho.isNull() | (F.abs(rho) >= 1) | F.isnan(rho))
    return (F.when(x.isNull() | y.isNull(), F.lit(0.0))
            .when(bad, neg_inf())
            .otherwise(log_bivariate_pdf(x, mx, sx, y, my, sy, rho)))


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd; NULL instead of an ANSI error when sd is 0 or NULL."""
    return F.try_divide(x - mean, sd)


# ---- pre-transformed normal log density ---------------------------------------
# The per-row form ``-0.5 ((x - m) r)^2 + c`` (sqltext.pre_density) with the
# constants computed once per parameter row (``r = 1/sd``,
# ``c = -ln sd - ln(2 pi)/2``) keeps the generated code small and moves every
# logarithm out of the per-row path.
def inv_sd(sd: Column) -> Column:
    """1/sd, 0 when sd <= 0 or NULL."""
    return F.coalesce(F.when(sd > 0, F.lit(1.0) / sd), F.lit(0.0))


def log_norm_const(sd: Column, degenerate: Column) -> Column:
    """-ln sd - ln(2 pi)/2; ``degenerate`` when sd <= 0 or NULL."""
    return F.coalesce(F.when(sd > 0, -F.ln(sd) - F.lit(0.5 * LOG_2PI)), degenerate)


def log_p(p: Column) -> Column:
    """ln p for a probability column, -inf for 0 (computed on parameter rows)."""
    return F.when(p > 0, F.ln(p)).otherwise(neg_inf())
