"""Arrow batch helpers: one function per row to rows of a schema, the other columns carried by position."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Estimated bytes of a core's share below which an input is dealt over all cores.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where the plan's estimated size is small; a large one is left where it is. Plans only, runs nothing."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = re.match(r"sizeInBytes=([0-9.]+) (B|KiB|MiB)\b", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    small = size is not None and float(size[1]) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20}[size[2]] < cores * SMALL
    return df.repartition(cores) if small else df


def map_rows(df: DataFrame, schema: StructType, rows: Callable[..., Iterable[tuple]], most: int = 2048) -> DataFrame:
    """``rows(*values)`` for each input row gives output rows; a batch has ``most`` of them, also where one document has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for row in rows(*values):
                    out.append(row)
                    if len(out) >= most:
                        yield _batch(out, arrow)
                        out = []
        if out:
            yield _batch(out, arrow)

    return spread(df).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
