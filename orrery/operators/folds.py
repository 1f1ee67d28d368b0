"""Rules that look back at earlier decisions, as one pass over sorted rows with a small state for each key.

Rows of a key stand together in one partition, in order, and stream through in batches: what a task holds is a batch and
one state, however many rows a key has. Costs grow in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """What ``step`` says of each row of ``rows``, in order within each key.

    ``step`` takes the state (None at a key's first row) and the row, and returns the state and the row's result, or None
    for no result. A result has the columns of ``schema``.
    """

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, kinds = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = at = None
        for batch in batches:
            places = [batch.schema.get_field_index(k) for k in keys]
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(row[i] for i in places)
                if key != at:
                    at, state = key, None
                state, said = step(state, row)
                if said is not None:
                    out.append(said)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
