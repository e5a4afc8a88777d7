"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column | str) -> Column:
    vector = as_double(vector)
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column | str) -> Column:
    """Unit vector; a zero vector is an error, as is a null result of it downstream."""
    length = norm(vector)
    checked = F.when(length > 0, length).otherwise(F.raise_error(F.lit("embedding has zero length")).cast("double"))
    return F.transform(as_double(vector), lambda x: x / checked)


def split_by_dimension(df: DataFrame, vector: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the expected size and is not zero, and the rows to quarantine."""
    good = F.coalesce((F.size(vector) == dimensions) & (norm(vector) > 0), F.lit(False))
    return df.where(good), df.where(~good)
