"""Folds over the rows of each key in order, which hold one key's state and never its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_BATCH = 4096


def fold(rows: DataFrame, key: str, order: list[str], begin: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list[tuple]]], finish: Callable[[Any, Any], list[tuple]], schema: str) -> DataFrame:
    """What ``step`` gives for each row and ``finish`` for each key, over the rows of a key in ``order``.

    ``step`` takes the state and a row and gives the next state and output
    rows.  A key's rows are read one after the other in one task, as the fold
    needs their order; keys are spread by hash.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, open_, out = None, None, False, []
        for part in batches:
            for row in part.to_pylist():
                if not open_ or row[key] != name:
                    if open_:
                        out += finish(name, state)
                    name, state, open_ = row[key], begin(), True
                state, more = step(state, row)
                out += more
                if len(out) >= _BATCH:
                    yield batch(out)
                    out = []
        if open_:
            out += finish(name, state)
        if out:
            yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)
