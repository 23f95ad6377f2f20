"""Short slices of Arrow batches, so that Python objects of a few rows exist at a time.

A batch may hold 10,000 rows, and nested cells take many times their size as Python objects.
"""

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

ROWS = 256


def sliced(batches: Iterator, rows: int = ROWS) -> Iterator:
    """Batches of columns (one array, or a tuple of them) in slices of at most ``rows`` rows."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), rows):
            part = tuple(column.slice(at, rows) for column in columns)
            yield part if isinstance(batch, tuple) else part[0]


def by_slices(work: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``work``, a function of columns, over short slices."""

    @wraps(work)
    def run(*columns: pa.Array) -> pa.Array:
        parts = [work(*part) for part in sliced([columns])]
        return pa.concat_arrays(parts) if parts else work(*columns)

    return run
