"""Rows of a DataFrame in a form that compares."""

from __future__ import annotations


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    selected = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in selected.collect()), key=repr)
