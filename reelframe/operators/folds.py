"""Ordered folds: a state machine over the rows of each key, in order.

Rows are dealt by key and sorted inside a partition (Spark's sort spills), then
stream through the function batch by batch.  No group is ever held: memory is one
batch and one state, whatever the length of an archive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], tuple], adds: T.StructType, inputs: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with the columns ``adds``, what ``step(state, row)`` returns for each.

    start: makes the state from a key's first row.  inputs: the columns that step
    reads; all if not given.  keep: the columns of ``rows`` in the result; all if not given.
    """
    names, inputs = rows.columns if keep is None else keep, inputs or rows.columns
    types = [to_arrow_type(f.dataType) for f in adds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_pylist() for n in dict.fromkeys([*inputs, *keys])}
            out = []
            for values in zip(*cols.values(), strict=True):
                row = dict(zip(cols, values, strict=True))
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    key, state = own, start(row)
                out.append(step(state, row))
            new = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=[*names, *adds.names])

    # one partition without keys: of the rows as they are, so what makes them runs wide
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    schema = T.StructType([*(rows.schema[n] for n in names), *adds.fields])
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
