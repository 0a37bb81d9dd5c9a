"""Helpers for Arrow batches: strings that may be broken, and runs of equal rows in sorted batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changed(columns: Sequence[pa.Array], before: tuple | None) -> np.ndarray:
    """Whether each row differs from the one before it; `before` holds the values that precede the first (None: nothing does). Columns without nulls."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    out[0] = before is None or any(c[0].as_py() != x for c, x in zip(columns, before))
    return out


def strings(column: pa.Array) -> list[str | None]:
    """Values of a string column; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
