"""Comparable rows of results."""

from __future__ import annotations

import pandas


def rows(frame) -> list[tuple]:
    """A pandas frame's rows, columns by name, in a comparable order; floats to 9 digits."""
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pandas.NA or x is pandas.NaT or x != x:
            return "null"
        if isinstance(x, float) and x.is_integer():
            return str(int(x))
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
