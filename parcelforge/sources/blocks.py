"""A query set read block by block."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def blocks_of_rows(queries: DataFrame, size_col: str, chars: int) -> Iterator[list[tuple]]:
    """Distinct rows of `queries` in lists of at most `chars` characters of `size_col` each (or one row). The rows come to the
    driver partition by partition, never all at once."""
    block, size = [], 0
    at = queries.columns.index(size_col)
    for row in queries.distinct().toLocalIterator():
        n = len(row[at] or "")
        if block and size + n > chars:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block
