"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes of one slice that a task turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    """Where the public package keeps the word-level BPE vocabulary."""
    return public_tokenizers.path("word_bpe_49k.json")


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null has none.

    ``bytes.lower`` and ``bytes.split`` touch exactly those ASCII characters.
    """
    return text.encode().lower().split() if text else []


def row_id() -> Column:
    """A number of each row, so that repeated ids stay separate rows.

    It is repeatable for a table that is read from files.
    """
    return F.monotonically_increasing_id()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of few rows and few bytes, which bounds the Python objects alive.

    A row that is larger than the bound is a slice of its own.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            full = int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE_BYTES, side="right"))
            stop = min(start + rows, max(full, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def release_memory() -> None:
    """Give freed memory back at the end of a task; Spark keeps the worker process for later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(
    df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict | None]], rows: int = SLICE_ROWS
) -> DataFrame:
    """``mapInArrow`` with one function per task that turns a slice into columns.

    ``start`` runs once per task and returns the function; it returns a dict of
    columns in the order of ``schema`` (or None for no rows).
    """
    struct = T.StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(struct)
        step = start()
        for piece in slices(batches, rows):
            made = step(piece)
            if made is not None:
                arrays = [pa.array(made[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        release_memory()

    return df.mapInArrow(run, struct)


def grouped_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Complete runs of equal integer keys from a sorted partition.

    Yields the columns of a chunk of whole groups and the group starts (with the
    end appended).  Only the group that is still open is carried over, so memory
    holds one batch and one group.
    """
    carry: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(pair) for pair in zip(carry, cols, strict=True)]
        if not len(cols[0]):
            continue
        starts = _starts(cols[:n_keys])
        last = starts[-1]
        carry = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols], starts
    if carry is not None and len(carry[0]):
        yield carry, np.append(_starts(carry[:n_keys]), len(carry[0]))


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
