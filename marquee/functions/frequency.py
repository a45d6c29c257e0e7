"""Distinct array elements, most frequent first."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks get this module's functions by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ranked(lists: pa.ListArray, most: int | None) -> pa.ListArray:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    owner = np.repeat(np.arange(len(lists)), lengths)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(coded.dictionary) + 1
    values, first, count = np.unique(owner * width + codes, return_index=True, return_counts=True)
    owner = values // width
    order = np.lexsort((first, -count, owner))
    sizes = np.bincount(owner, minlength=len(lists))
    if most is not None:
        order = order[np.arange(len(order)) - (np.cumsum(sizes) - sizes)[owner] < most]
        sizes = np.minimum(sizes, most)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    kept = coded.dictionary.take(pa.array(values[order] % width))
    return pa.ListArray.from_arrays(offsets, kept, mask=lists.is_null())


def by_frequency(values: Column, most: int | None = None) -> Column:
    """Distinct strings by falling count, the first `most` of them if given.

    Ties keep the order of first appearance. Whole batches of arrays are coded and sorted at once,
    which costs a string once; array functions compare each distinct string with all others.
    """

    def ranked(lists: pa.Array) -> pa.Array:
        return _ranked(lists, most)

    return F.arrow_udf(ranked, "array<string>")(values)
