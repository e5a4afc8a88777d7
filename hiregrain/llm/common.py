"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hiregrain.session import written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"  # fixed values
WHITE = " \t\n\x0b\f\r"  # fixed value: [\x20\x09-\x0D]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that on pure ASCII and is much faster there."""
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """An object kept by the Python worker across tasks (tokenizers, automata); built once per process."""
    name = "_hiregrain_worker"
    store = sys.modules.setdefault(name, ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in store:
        store[key] = build()
    return store[key]


def map_texts(df: DataFrame, work: Callable[[list, pa.RecordBatch], dict[str, list]], schema: str, text: str, slice_rows: int = 512, keep_text: bool = False) -> DataFrame:
    """Apply ``work(texts, batch)`` to slices of Arrow batches and append its columns to the rows, without the text unless it is to be kept.

    ``work`` returns one list per new column; a new column replaces one of its name. Slices keep few texts alive as Python strings at a time.
    """
    added = StructType.fromDDL(schema).fieldNames()
    kept = [c for c in df.columns if (keep_text or c != text) and c not in added]
    rest = df.select(*kept).schema
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                made = work(part.column(text).to_pylist(), part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()], names=kept + list(made)
                )

    return df.mapInArrow(run, full)
