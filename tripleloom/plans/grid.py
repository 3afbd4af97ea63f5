"""Joins on values that are frequent on both sides, where one value's pairs would all be one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a value's rows are dealt into on each side; its pairs meet in the square of it.
SIDE = 8


def grid_join(a: DataFrame, b: DataFrame, on: list[str], where: Column | None = None, tasks: int | None = None) -> DataFrame:
    """The inner join on ``on``.  A row goes to one line of a grid and a row of the other side to one column, so each pair meets in one cell
    and a value's pairs are spread whatever side has more of them.  ``where``, a condition on columns of ``on``, limits this to some values.
    ``tasks`` holds their number where most values are frequent: by the bytes of its inputs, Spark would make few, whatever the pairs."""
    lines = F.sequence(F.lit(0), F.lit(SIDE - 1))

    def laid(df: DataFrame, own: str, other: str) -> DataFrame:
        dealt, every = F.pmod(F.xxhash64(*df.columns), F.lit(SIDE)).cast("int"), lines
        if where is not None:
            dealt, every = F.when(where, dealt).otherwise(0), F.when(where, lines).otherwise(F.array(F.lit(0)))
        return df.withColumn(own, dealt).withColumn(other, F.explode(every))

    x, y = laid(a, "_line", "_column"), laid(b, "_column", "_line")
    if tasks:
        x, y = (z.repartition(tasks, *on, "_line", "_column") for z in (x, y))
    # not by broadcast: a small input in few files would be joined by as few tasks
    return x.join(y.hint("merge"), [*on, "_line", "_column"]).drop("_line", "_column")
