"""Shared plumbing of the training-data operators: tables, the shared folder, Arrow text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarryline import session
from quarryline.session import shared_dir, stored  # noqa: F401

#: Bytes that a table may have at most before the operators stop broadcasting it.
BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """The package on the workers, and batches that bound what a worker holds."""
    session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return session.table(spark, sf_dir, name)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row; a null text becomes an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            part = batch.slice(begin, end - begin)
            text = pc.fill_null(part.column(at).cast(pa.large_string()), "")
            yield part.set_column(at, pa.field(column, pa.large_string()), text)
            begin = end


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array without nulls, and the offsets of its rows among them."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of characters other than ASCII white space, of all rows in sequence, and the rows' offsets."""
    values, offsets = flat(pc.ascii_split_whitespace(text))
    there = pc.greater(pc.binary_length(values), 0)
    counts = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return values.filter(there), counts[offsets]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def small_enough(rows: int, row_bytes: int, most: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= most
