"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.plans.blocks import best_matches


def _matrix(values: pd.Series) -> np.ndarray:
    matrix = np.stack(values.to_numpy()).astype(np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    if not lengths.all():
        raise ValueError("embedding has zero length")
    return matrix / lengths


def score_cosine(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best items per query (ties at the edge kept) from one matrix product; none far below a query's ``floor``, if it has one."""
    if items.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
    scores = _matrix(queries["value"]) @ _matrix(items["value"]).T
    floor = queries["floor"].to_numpy(np.float64) if "floor" in queries else np.full(len(queries), -np.inf)
    if np.isfinite(floor).all():
        rows, cols = np.nonzero(scores >= floor[:, None] - 1e-9)
    elif scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k]
        rows, cols = np.nonzero(scores >= edge[:, None] - 1e-9)
    else:
        rows, cols = (axis.ravel() for axis in np.indices(scores.shape))
    return pd.DataFrame(
        {"query_id": queries["query_id"].to_numpy()[rows], "item_id": items["item_id"].to_numpy()[cols], "score": scores[rows, cols]}
    )


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank)``; both sides have an id and an ``embedding``.

    With ``within`` (``doc_id``) only those documents are candidates.
    """
    if within is not None:
        vectors = vectors.join(within.select("doc_id"), "doc_id", "left_semi")
    left = queries.select("query_id", F.col("embedding").alias("value"))
    right = vectors.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("value"))
    return best_matches(left, right, score_cosine, k, decimals=9).withColumnRenamed("item_id", "doc_id")


def require_index(vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Fail on an empty index or, when ``dimensions`` is given, on a vector of another size."""
    if vectors.isEmpty():
        raise ValueError("the vector index is empty; index the postings first")
    if dimensions is None:
        return vectors
    fits = F.size("embedding") == dimensions
    message = F.concat(F.lit(f"expected {dimensions} dimensions, found "), F.size("embedding"))
    checked = F.when(fits, F.col("embedding")).otherwise(F.raise_error(message).cast(vectors.schema["embedding"].dataType))
    return vectors.withColumn("embedding", checked)
