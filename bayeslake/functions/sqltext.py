"""SQL-text forms of the expressions whose number grows with the width of
the network (one per feature, per class, per edge).

Composing a Column costs one py4j round trip per operator on the driver, so
a 250-feature network would spend minutes building its plan; one ``F.expr``
over a long SQL string is parsed in the JVM in milliseconds. The formulas
are the same as the Column forms in ``density``.
"""

from __future__ import annotations

import math

LOG_2PI = math.log(2.0 * math.pi)
NEG_INF = "CAST('-Infinity' AS DOUBLE)"


def q(name: str) -> str:
    """Quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def s(text: str) -> str:
    """Quoted string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num(x: float) -> str:
    """Double literal (a bare decimal would be parsed as DECIMAL)."""
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return NEG_INF if x < 0 else "CAST('Infinity' AS DOUBLE)"
    return f"{x!r}D"


def total(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0.0D"


def inv_sd(sd: str) -> str:
    """1/sd, 0 when sd <= 0 or NULL."""
    return f"coalesce(CASE WHEN {sd} > 0 THEN 1.0D / {sd} END, 0.0D)"


def log_norm_const(sd: str, degenerate: str) -> str:
    """-ln sd - ln(2 pi)/2; ``degenerate`` when sd <= 0 or NULL."""
    return f"coalesce(CASE WHEN {sd} > 0 THEN -ln({sd}) - {num(0.5 * LOG_2PI)} END, {degenerate})"


def pre_density(x: str, mean: str, r: str, c: str) -> str:
    """ln phi(x) from pre-transformed constants; NULL x is marginalised (0)."""
    return f"coalesce(-0.5D * power(({x} - {mean}) * {r}, 2) + {c}, 0.0D)"


def class_density(x: str, mean: str, sd: str) -> str:
    """Log density of a continuous parent given the class of a discrete
    child (sd <= 0 or NULL: factor 0; NULL value: marginalised)."""
    z = f"(({x} - {mean}) / {sd})"
    return (f"CASE WHEN {x} IS NULL THEN 0.0D WHEN {sd} IS NULL OR {sd} <= 0 THEN {NEG_INF} "
            f"ELSE -0.5D * {z} * {z} - ln({sd}) - {num(0.5 * LOG_2PI)} END")
