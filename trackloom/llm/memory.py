"""Memory of Python workers, which stay on between tasks beside an executor's own."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """What a task has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives memory back when its task ends."""

    @wraps(run)
    def wrapped(*args):
        yield from run(*args)
        give_back()

    return wrapped
