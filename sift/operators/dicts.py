"""Bringing caller-supplied dictionary tables into a plan.

Dictionaries are small, but their size is a caller's choice, so every
in-row (literal) use is behind an explicit row-count bound. Above the bound
operators switch to a join form, with the same results, that never ships the
table to the driver (``operators.matching``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# In-row literal dictionaries stay well inside codegen and task-closure limits
# up to about a thousand entries; above that use the join form.
MAX_INLINE_ROWS = 1000


def small_rows(df: DataFrame, order_by: list[str] | None = None) -> list | None:
    """Rows of ``df``, ordered, if it has at most ``MAX_INLINE_ROWS`` rows, else ``None``.

    Reads at most one row more, so the check itself is bounded.
    """
    q = df.orderBy(*order_by) if order_by else df
    rows = q.limit(MAX_INLINE_ROWS + 1).collect()
    return rows if len(rows) <= MAX_INLINE_ROWS else None
