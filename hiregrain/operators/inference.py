"""Batched model calls over a DataFrame with a function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

# Rows per model call.
EXTRACT_BATCH, EMBED_BATCH, PAIR_BATCH, ALIAS_BATCH = 8, 20, 8, 40

Model = Callable[[pd.DataFrame], pd.DataFrame]


def infer(
    df: DataFrame, make_model: Callable[[], Model], output: str, batch_size: int = EMBED_BATCH, attempts: int = 2
) -> DataFrame:
    """Append the columns ``output`` (a DDL list) that the model computes for each row.

    ``make_model`` runs once per task. A failing batch is tried again, then halved until single rows
    fail alone; such a row gets nulls and can be set aside with ``failed_rows``.
    """
    added = S.StructType.fromDDL(output)
    schema = S.StructType([*df.schema.fields, *added.fields])
    names = added.fieldNames()

    def call(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
        for _ in range(attempts):
            try:
                answer = model(rows)
                if len(answer) != len(rows):
                    raise ValueError("the model must answer every row of a batch")
                return answer[names].set_axis(rows.index)
            except Exception:  # noqa: BLE001 - any model failure is isolated below
                continue
        if len(rows) == 1:
            return pd.DataFrame([[None] * len(names)], columns=names, index=rows.index)
        half = len(rows) // 2
        return pd.concat([call(model, rows.iloc[:half]), call(model, rows.iloc[half:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                rows = batch.iloc[at : at + batch_size].reset_index(drop=True)
                yield pd.concat([rows, call(model, rows)], axis=1)

    return df.mapInPandas(run, schema)


def failed_rows(inferred: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an answer and rows to quarantine."""
    return inferred.where(F.col(column).isNotNull()), inferred.where(F.col(column).isNull())


def reconcile(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the response that names them exactly once in their batch; others get nulls.

    Both have ``batch`` and ``item``; responses that repeat an item, or name one that was not asked
    for, are dropped without harm to the rest of the batch.
    """
    once = (
        responses.where("item is not null")
        .groupBy("batch", "item")
        .agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in responses.columns if c not in ("batch", "item")])
        .where("_n = 1")
        .drop("_n")
    )
    return requests.join(once, ["batch", "item"], "left")


def infer_saved(requests: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str, key: str, batches: int) -> DataFrame:
    """Results of ``run`` over all requests, saved batch by batch below ``folder``.

    Requests are dealt to ``batches`` by the hash of their key and every finished batch is a table of its own, so after a
    failure a second call only runs what has no saved result yet.
    """
    spark = requests.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(at: int) -> bool:
        return files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"batch={at}/_SUCCESS"))

    place = F.pmod(F.xxhash64(key), F.lit(batches))
    for at in range(batches):
        wanted = requests.where(place == at)
        if finished(at):  # the requests may have grown since
            fresh = remaining(wanted, spark.read.parquet(f"{folder}/batch={at}"), key)
            if not fresh.isEmpty():
                run(fresh).write.mode("append").parquet(f"{folder}/batch={at}")
        else:
            run(wanted).write.mode("overwrite").parquet(f"{folder}/batch={at}")
    return spark.read.parquet(*[f"{folder}/batch={at}" for at in range(batches)])


def remaining(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a saved result: the resume point of a run."""
    return requests.join(done.select(key), key, "left_anti")
