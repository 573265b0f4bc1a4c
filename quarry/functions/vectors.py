"""Dense vector expressions over ``array<float|double>`` columns.

Higher-order array functions keep the arithmetic in the JVM; nothing here
calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Dot / (|a| |b|); null (not NaN) when a norm is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d)


def sq_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                                  * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    """V8: Euclidean distance."""
    return F.sqrt(sq_euclidean(a, b))


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x.cast("double") * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def to_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def round_vector_string(a, digits: int = 6, sep: str = " ") -> Column:
    """A vector as a string of rounded components (for comparisons)."""
    return F.array_join(F.transform(_c(a), lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), sep)
