"""Staging of costly columns, and slices of bounded size inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain projection is copied into every filter above it, so a costly expression
    would run again there, and a chain of them many times. A one-row generator keeps
    filters above while those on other columns still reach the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def row_slices(lengths: np.ndarray, limit: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``limit`` words or characters, and at most ``rows``; a longer row comes alone."""
    ends, row = np.cumsum(lengths), 0
    while row < len(lengths):
        before = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        end = end if rows is None else min(end, row + rows)
        yield row, end
        row = end
