"""Tables that an operator keeps in a Python worker between its tasks.

Spark hands workers on from task to task and from operator to operator. A table made for one
operator would stay in memory under all that follow, so another operator's first batch drops it.
What a task has freed stays with the allocators of its worker, which may wait through whole stages
without Python, so an operator hands it back at the end of its batches or of a group.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any, TypeVar

import pyarrow as pa

T = TypeVar("T")
_kept: dict[Hashable, Any] = {}


def keep(name: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's table of that name, made when first asked for; others go."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drop the tables, and hand their memory back to the system."""
    if not _kept:
        return
    _kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Hand free memory back to the system."""
    pa.default_memory_pool().release_unused()
    hand_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if hand_back is not None:
        hand_back(0)


def trimmed(made: T) -> T:
    """What a function made of a group, after its memory went back."""
    trim()
    return made


def trimming(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, whose memory goes back after a task's last batch."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidy
