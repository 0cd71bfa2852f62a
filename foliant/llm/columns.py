"""Columns of Arrow batches, and names of result columns beside whatever names an input has.

Spark takes names without regard to case, and so does this.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, results: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """``df`` with columns that have a result's name renamed: ``score`` becomes ``score_input``, and so on until it is free.

    Columns of ``keep`` (those that the operator reads) are left as they are.
    """
    reserved, kept = {r.lower() for r in results}, {k.lower() for k in keep}
    taken = {c.lower() for c in df.columns} | reserved
    names = []
    for c in df.columns:
        name = c
        if c.lower() in reserved and c.lower() not in kept:
            while name.lower() in taken:
                name = f"{name}_input"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names) if names != df.columns else df


def each(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that a batch of texts is not held twice."""
    return (v.as_py() for v in column)
