"""Vector functions on ``array<float>`` columns.

Spark 4.1 has no vector builtins; these are higher-order SQL expressions,
computed in double. Heavy all-against-all scoring does not use them: it goes
through the Arrow/NumPy scorer in ``operators.search``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product in double (cosine for unit vectors)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def sum_squares(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda s, x: s + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(sum_squares(v))


def l2_normalize(v) -> Column:
    """divide by the L2 norm; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: (x.cast("double") / n).cast("float"))) \
        .otherwise(_c(v))


def vector_sum(v, dim: int) -> Column:
    """Aggregate expression: element-wise sum of ``array<float>`` rows as
    ``array<double>`` (partial + final aggregation, skew-safe)."""
    return F.array(*[F.sum(F.try_element_at(_c(v), F.lit(i + 1)).cast("double")) for i in range(dim)])
