"""Arrow functions whose memory doesn't grow with the rows of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

#: Rows whose Python objects are there at one time.
ROWS = 128


def in_slices(run: Callable[..., pa.Array], *columns: pa.Array, rows: int = ROWS) -> pa.Array:
    """run(*lists) of some rows at a time, as one array; unused memory goes back to the system, as workers go on from task to task."""
    n = len(columns[0])
    made = pa.concat_arrays([run(*[c.slice(i, rows).to_pylist() for c in columns]) for i in range(0, max(n, 1), rows)])
    release()
    return made


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)
