"""Vector helpers over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(idx: Column, n: int | Column) -> Column:
    """Dense one-hot vector of length ``n`` with 1.0 at ``idx`` (0-based)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.transform(F.sequence(F.lit(0), n_col - 1),
                       lambda i: F.when(i == idx, F.lit(1.0)).otherwise(F.lit(0.0)))


def argmax(v: Column) -> Column:
    """0-based index of the first maximum (numpy ``argmax`` semantics)."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column) -> Column:
    """exp(x - max) / sum(exp(x - max)) element-wise."""
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)
