"""Memory of Python workers, which Spark uses again for the tasks of later steps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What tasks of an operator leave in a worker for its next tasks: how to tell that there is some, and how to drop it.
_left: dict[str, tuple[Callable[[], bool], Callable[[], None]]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def leaves(name: str, some: Callable[[], bool], drop: Callable[[], None]) -> None:
    _left[name] = some, drop


def give_back() -> None:
    """Hands freed memory back to the system; without this the allocators keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches: drops what tasks of other operators than ``keep`` left, and gives freed memory back at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = [drop for name, (some, drop) in _left.items() if name != keep and some()]
        for drop in old:
            drop()
        if old:
            gc.collect()
            give_back()
        yield from run(batches)
        give_back()

    return tidied
