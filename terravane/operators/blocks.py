"""Ordered work on long sequences without ever holding one entity in one task.

A sequence (one entity's rows in order of a numeric axis) is cut into blocks of a fixed length on
that axis. Rows are hashed by (entity, block), so an entity that holds a third of all rows is spread
over all tasks, and a block is bounded by the sampling rate times the block length. Kernels run over
Arrow batches: all whole blocks of a batch at once, in NumPy, with block starts as break marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "__block"
HOME = "__home"


def finite(*names: str) -> Column:
    """All of the columns are neither null nor NaN."""
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    return test


def number(name: str) -> Column:
    """The column as double, NaN read as null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def with_blocks(df: DataFrame, axis: str, length: float, halo: float = 0.0) -> DataFrame:
    """Adds ``__block``; with a halo, rows near an edge are repeated into the neighbouring block.

    ``__home`` is true for the one copy of each row that belongs to its block.
    """
    home = F.floor(F.col(axis) / F.lit(float(length)))
    if not halo:
        return df.withColumn(BLOCK, home)
    low = F.floor((F.col(axis) - F.lit(float(halo))) / F.lit(float(length)))
    high = F.floor((F.col(axis) + F.lit(float(halo))) / F.lit(float(length)))
    return df.withColumn(BLOCK, F.explode(F.sequence(low, high))).withColumn(HOME, F.col(BLOCK) == home)


def in_blocks(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """One exchange by (entity, block), each block sorted."""
    return df.repartition(F.col(entity), F.col(BLOCK)).sortWithinPartitions(entity, BLOCK, *order)


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of sorted batches, cut only where the keys change."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = None
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key))
            end = column[len(column) - 1]
            same = pc.equal(column, end) if end.is_valid else pc.is_null(column)
            last = same if last is None else pc.and_(last, same)
        flags = np.asarray(pc.fill_null(last, False).to_numpy(zero_copy_only=False), dtype=bool)
        other = np.flatnonzero(~flags)
        start = int(other[-1]) + 1 if len(other) else 0
        if start:
            yield pa.Table.from_batches([*waiting, batch.slice(0, start)])
            waiting = [batch.slice(start)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def codes(table: pa.Table, entity: str) -> tuple[np.ndarray, list]:
    """Integer codes of the entity column and their values."""
    encoded = table.column(entity).combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    index = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return index, encoded.dictionary.to_pylist()


def array(table: pa.Table, name: str) -> np.ndarray:
    """The column in NumPy; nulls of floating columns become NaN."""
    return table.column(name).to_numpy()


def starts(*columns: np.ndarray) -> np.ndarray:
    """True where any of the columns differs from the row before, and at row 0."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    out[:1] = True
    return out


def run_kernel(df: DataFrame, entity: str, order: list[str], kernel: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Runs ``kernel`` over tables of whole blocks, in order; it returns a table of ``schema``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_blocks(batches, [entity, BLOCK]):
            out = kernel(table)
            if out is not None and out.num_rows:
                yield from out.to_batches(max_chunksize=20_000)

    return in_blocks(df, entity, order).mapInArrow(work, schema)
