"""Vector columns: which rows can be used, and their values as a matrix inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for a vector that is there, is not empty and has finite entries only."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & inside


def of_usual_width(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has the most frequent length; of several such lengths, the longest."""
    width = rows.groupBy(F.size(vector).alias("width")).count().agg(F.max_by("width", F.struct("count", "width"))).first()[0]
    return rows.where(F.size(vector) == (width or 0))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
