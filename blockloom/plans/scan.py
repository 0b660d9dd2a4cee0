"""Row by row over sorted partitions: for rules that are sequential within a key.

Rows are dealt by key and sorted by Spark, which spills; a task sees them in order and keeps
the state of one key, never its rows. So a key of any size takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_sorted(df: DataFrame, keys: list[str], order: list, step: Callable[[], Callable[[tuple | None], Iterable[tuple]]], schema: str) -> DataFrame:
    """``step()`` makes the rule of one key: it is called with each row in order, then with None; it returns rows out."""
    out_schema = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(out_schema)
        rule, key, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kind]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

        for b in batches:
            columns = [_values(c) for c in b.columns]
            own = list(zip(*columns[: len(keys)], strict=True))
            for k, row in zip(own, zip(*columns, strict=True), strict=True):
                if k != key:
                    if rule is not None:
                        out.extend(rule(None))
                    rule, key = step(), k
                out.extend(rule(row))
                if len(out) >= 8192:
                    yield flush()
        if rule is not None:
            out.extend(rule(None))
        yield flush()

    rest = [c for c in df.columns if c not in keys]
    return dealt(df.select(*keys, *rest), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, whatever comes before.

    Dealt by a hash of the keys, not by the keys: where ``df`` is dealt by these already, Spark drops a repartition by them,
    and adaptive execution may then coalesce the sides of a union apart or read a join's shuffle by its local files, as it
    doesn't know that the task needs whole keys.
    """
    return df.repartition(F.xxhash64(*keys))


def _values(column: pa.Array) -> list:
    if pa.types.is_timestamp(column.type):  # microseconds as they are: no objects, no time zone
        return column.cast(pa.int64()).to_pylist()
    return column.to_pylist()
