"""Arrow functions over columns of texts, of which a worker holds little at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a batch's columns of which Python objects are made at a time, and rows.
BYTES, ROWS = 1 << 20, 1024


def parts(*columns: pa.Array, rows: int = ROWS) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of about BYTES; a row of more comes alone."""
    n = len(columns[0])
    i = 0
    while i < n:
        j = min(n, i + rows)
        while j > i + 1 and sum(c.slice(i, j - i).nbytes for c in columns) > BYTES:
            j = i + (j - i) // 2
        yield tuple(c.slice(i, j - i) for c in columns)
        i = j


def by_parts(run: Callable[..., pa.Array], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """run() of slices, put together; freed memory goes back."""
    found = [run(*p) for p in parts(*columns)]
    out = pa.concat_arrays(found) if found else pa.array([], kind)
    del found
    tidy()
    return out


def tidy() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not of this C library
        pass
    pa.default_memory_pool().release_unused()
