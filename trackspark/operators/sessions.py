"""Grouped functions over whole sessions, in Arrow: only the columns that a rule needs become arrays."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

Arrays = dict[str, np.ndarray]


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Values as doubles, nulls as NaN; whole numbers without nulls stay whole."""
    out = column.to_numpy()
    return out if out.dtype.kind == "i" else out.astype(float)


def by_session(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    needs: Sequence[str],
    made: Mapping[str, DataType],
    rule: Callable[[Arrays], Arrays],
) -> DataFrame:
    """``df`` with the columns ``made`` by a rule over each session's ``needs``, in the order of ``order``.

    The rule's arrays are sorted, and what it gives goes back to the rows as
    they lie. Other columns pass through a worker as Arrow buffers that are
    neither sorted nor turned into Python objects. Columns that are made anew
    replace older ones. One session at a time is in a worker's memory.
    """
    have = [f for f in df.schema if f.name not in made]
    schema = StructType([*have, *[StructField(n, k) for n, k in made.items()]])
    inputs = [c for c in dict.fromkeys(needs) if c in made]
    frame = df.select(*[f.name for f in have], *[df[c].alias(f"__in_{c}") for c in inputs])

    def run(table: pa.Table) -> pa.Table:
        read = {c: numbers(table.column(f"__in_{c}" if c in inputs else c)) for c in dict.fromkeys((*needs, *order))}
        at = np.lexsort([read[c] for c in reversed(order)])
        found = rule({c: v[at] for c, v in read.items()})
        out = table.drop_columns([f"__in_{c}" for c in inputs]) if inputs else table
        for name, kind in made.items():
            back = np.empty(len(at), found[name].dtype)
            back[at] = found[name]
            whole = back.dtype.kind == "i"
            out = out.append_column(name, pa.array(back) if whole else pa.array(back, mask=np.isnan(back)))
        return out

    return frame.groupBy(*keys).applyInArrow(run, schema)
