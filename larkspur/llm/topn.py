"""Top N rows of every group by a mergeable bounded heap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a task may hold before it truncates them to N a group, and again before a map-side task hands its heaps on.
ABSORB_ROWS = 200_000


class BoundedHeaps:
    """The N best rows of each group seen so far, best first; rows compare by score (descending), then identifier.

    ``absorb`` adds rows; two objects merge by absorbing each other's rows, so the same class serves before and after
    the shuffle. Whatever is ranked N+1 or lower among the rows seen can never return, which is why it may be dropped.
    """

    def __init__(self, keys: list[str], n: int) -> None:
        self.keys, self.n, self.held, self.fresh = keys, n, None, []

    def absorb(self, batch: pa.RecordBatch) -> None:
        self.fresh.append(batch)

    def __len__(self) -> int:
        return sum(map(len, self.fresh)) + (0 if self.held is None else len(self.held))

    def truncate(self) -> pa.Table | None:
        parts = [pa.Table.from_batches(self.fresh)] if self.fresh else []
        if self.held is not None:
            parts.append(self.held)
        self.fresh = []
        if not parts:
            return None
        rows = pa.concat_tables(parts).combine_chunks()
        order = [(k, "ascending") for k in self.keys] + [("score", "descending"), ("tie", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        rows = rows.filter(pa.array(self._changes(rows, [*self.keys, "score", "tie"])))
        self.held = rows.filter(pa.array(self._places(rows) < self.n)).combine_chunks()
        return self.held

    def _changes(self, rows: pa.Table, columns: list[str]) -> np.ndarray:
        """True where a row differs from the one before it in any of the columns; two nulls are alike."""
        size = len(rows)
        starts = np.zeros(size, dtype=bool)
        if size:
            starts[0] = True
        for name in columns:
            column = pa.concat_arrays(rows[name].chunks) if rows[name].num_chunks != 1 else rows[name].chunk(0)
            a, b = column.slice(1), column.slice(0, max(size - 1, 0))
            both_null = pc.and_(pc.is_null(a), pc.is_null(b))
            differs = pc.if_else(both_null, False, pc.fill_null(pc.not_equal(a, b), True))
            starts[1:] |= np.asarray(differs, dtype=bool)
        return starts

    def _places(self, rows: pa.Table) -> np.ndarray:
        index = np.arange(len(rows))
        return index - np.maximum.accumulate(np.where(self._changes(rows, self.keys), index, 0)) if len(rows) else index

    def clear(self) -> None:
        self.held = None


def _runner(keys: list[str], n: int, spill: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = BoundedHeaps(keys, n)
        limit = ABSORB_ROWS
        for batch in batches:
            heaps.absorb(batch)
            if len(heaps) >= limit:
                held = heaps.truncate()
                if spill and len(held) > ABSORB_ROWS // 2:  # many small groups: hand their heaps on, the merge does the rest
                    yield from held.to_batches()
                    heaps.clear()
                limit = len(heaps) + ABSORB_ROWS
        held = heaps.truncate()
        if held is not None:
            yield from held.to_batches()

    return run


def _merge_runner(keys: list[str], n: int):
    """Merges rows that arrive sorted by group: all groups but the last of a block are complete and leave at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = BoundedHeaps(keys, n)
        for batch in batches:
            heaps.absorb(batch)
            if len(heaps) < ABSORB_ROWS:
                continue
            held = heaps.truncate()
            last = len(held) - 1 - int(heaps._places(held)[-1])
            yield from held.slice(0, last).to_batches()
            heaps.held = held.slice(last)
        held = heaps.truncate()
        if held is not None:
            yield from held.to_batches()

    return run


def top_n_per_group(df: DataFrame, keys: list[str], score: str | Column, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``; equal scores by ascending ``tie``.

    Every task keeps a bounded heap per group before the shuffle, so at most ``n`` rows of a group leave a task however
    large the group is; the same heaps merge what arrives. Result columns: ``keys``, ``tie``, ``score`` (double).

    Rows whose score is null or NaN are left out; a null key is a group of its own; a null ``tie`` comes last; a row
    written twice (equal key, score and ``tie``) counts once; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    names = [f"k{i}" for i in range(len(keys))]
    value = (F.col(score) if isinstance(score, str) else score).cast("double")
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), value.alias("score"), F.col(tie).alias("tie"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    partial = rows.mapInArrow(_runner(names, n, spill=True), schema)
    merged = partial.repartition(*names).sortWithinPartitions(*names).mapInArrow(_merge_runner(names, n), schema)
    return merged.select(*(F.col(a).alias(k) for k, a in zip(keys, names, strict=True)), F.col("tie").alias(tie), F.col("score"))
