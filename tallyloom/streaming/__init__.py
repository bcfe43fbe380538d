"""Verbs on streams of matrix rows.

Filtering, normalising with known factors, masking against a stored set and scoring without correction look at one row
at a time, so they run on unbounded input as they are. Column sums are kept as streaming state.
"""

from .verbs import column_sums, read_rows, stream

__all__ = ["column_sums", "read_rows", "stream"]
