"""Banding of numbers: the SQL reports close bands on the left, the charts on the right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def bands_left(x: Column, cuts: Sequence, labels: Sequence[str]) -> Column:
    """labels[i] while x < cuts[i]; the last label takes the rest, NULL included."""
    col = F.when(x < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:-1]):
        col = col.when(x < cut, label)
    return col.otherwise(labels[-1])


OUTSIDE = "out of range"


def bands_right(x: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """labels[i] for x in (edges[i], edges[i+1]]; a first or last edge of None is open. What no band holds is counted as
    ``OUTSIDE``; only a missing value has no band."""
    col = F.when(x.isNull(), None)
    for low, high, label in zip(edges, edges[1:], labels):
        above = F.lit(True) if low is None else x > low
        col = col.when(above if high is None else above & (x <= high), label)
    return col.otherwise(OUTSIDE)
