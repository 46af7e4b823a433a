"""Work on the rows of a key one after the other, in order, without holding them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame


def in_order(rows: DataFrame, keys: Sequence[str], within: Sequence[str], run: Callable, schema: str, select: Sequence[str | Column] = ("*",), made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """run over Arrow batches in which the rows of a key follow each other, in the order of `within`: one shuffle, a sort that
    spills, and no group in memory. run has to carry a key over from one batch to the next. select: what run is given of the sorted rows. made: what is
    made of the rows after the shuffle and before the sort."""
    dealt = rows.repartition(*keys)
    return (made(dealt) if made else dealt).sortWithinPartitions(*keys, *within).select(*select).mapInArrow(run, schema)
