"""Kernels as Columns: Arrow batches in, Arrow batches out; a null gives a null and a bad row never fails the job."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string


#: Bytes of a batch that are held as Python objects at once.
PART_BYTES = 4 << 20


def kernel(function: Callable, returns: str | DataType, *columns: Column | str) -> Column:
    """``function`` of each row's values. Rows with a null in the first column give null."""
    kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns
    arrow = to_arrow_type(kind)

    def part(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist(maps_as_pydicts="lossy") if pa.types.is_map(a.type) else a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if r[0] is None else function(*r) for r in rows], arrow)

    return parts_kernel(part, kind, *columns)


def parts_kernel(part: Callable[..., pa.Array], returns: str | DataType, *columns: Column | str) -> Column:
    """``part`` of bounded slices of the columns' batches: an array of the type that ``returns`` names."""
    kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns

    def run(*arrays: pa.Array) -> pa.Array:
        collects = gc.isenabled()
        gc.disable()  # nothing that is made here has cycles, and a part is bounded
        try:
            return cut(*arrays)
        finally:
            if collects:
                gc.enable()

    def cut(*arrays: pa.Array) -> pa.Array:
        n, size = len(arrays[0]), sum(a.nbytes for a in arrays)
        step = max(1, n * PART_BYTES // max(PART_BYTES, size))  # rows that are Python objects at once
        if step >= n:
            return part(*arrays)
        return pa.concat_arrays([part(*(a.slice(k, step) for a in arrays)) for k in range(0, n, step)])

    if len(columns) == 1:

        def batch(a: pa.Array) -> pa.Array:
            return run(a)
    elif len(columns) == 2:

        def batch(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:

        def batch(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

    return F.arrow_udf(batch, kind)(*columns)


def structs(columns: list, kind: pa.DataType) -> pa.Array:
    """Structs from their fields' columns."""
    made = [c if isinstance(c, pa.Array) else pa.array(c, kind.field(i).type) for i, c in enumerate(columns)]
    return pa.StructArray.from_arrays(made, fields=list(kind))


def lists(ends: list[int], good: list[bool], columns: list, kind: pa.DataType) -> pa.Array:
    """Lists of structs from their fields' columns: list k ends at ``ends[k]`` and is null unless ``good[k]``."""
    values = structs(columns, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values, type=kind, mask=None if all(good) else pa.array([not g for g in good]))


def ordinals(ends: list[int]) -> pa.Array:
    """Of the elements of lists that end at ``ends``, their places."""
    stops = np.asarray(ends, np.int32)
    starts = np.concatenate((np.zeros(1, np.int32), stops))[:-1]
    return pa.array(np.arange(stops[-1] if len(stops) else 0, dtype=np.int32) - np.repeat(starts, stops - starts))
