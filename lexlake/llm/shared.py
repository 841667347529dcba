"""What the operators of this package share: input columns, the folder all machines see, stored intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder, stored

__all__ = ["batches", "cached", "one_thread", "pairs", "partitions", "release_memory", "shared_folder", "stored", "stored_with", "text_key", "texts"]

ROWS_OUT = 4096


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that no other column of the input can clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_key(text: Column | str = "text") -> Column:
    """Tells apart rows that share an id; rows equal in id and text are one document to the operators."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def stored_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The rows as a stored table, and what was measured of them while they were written, without a job of its own."""
    seen = Observation()
    table = stored(df.observe(seen, *(m.alias(name) for name, m in measures.items())))
    return table, seen.get


def partitions(df: DataFrame) -> int:
    """Partitions to deal rows to: as many as the input has, so that each stays as small at any size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS_OUT) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def pairs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of the named columns as tuples."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


_HELD: dict[tuple, object] = {}


def cached(kind: str, key, make):
    """What a Python worker keeps from task to task: of one operator at a time, so that their caches never add up."""
    if (kind, key) not in _HELD:
        if _HELD:
            _HELD.clear()
            release_memory()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def release_memory() -> None:
    """Gives freed memory back to the machine, where the C library can: workers outlive their tasks."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def one_thread() -> None:
    """A task has one core: libraries below must not start a thread for each core of the machine."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
