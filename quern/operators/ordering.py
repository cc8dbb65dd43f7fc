"""Running aggregates and row numbers over orders of any length.

A window without small partitions would be one task.  Here rows are range-partitioned
by group and order instead, so a part is one task's share however large a group is;
what comes before a row is the aggregate of its part's earlier rows and that of the
group's earlier parts, which are as many as there are tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stash, width

#: How two aggregates of the same kind become one.
JOINED: dict[str, tuple[Callable[[str], Column], Callable[..., Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def ordered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """rows dealt to parts by group and order, with their part and their place in it.

    order has to tell rows apart, but for rows that are alike.  Written once, so tasks
    that run again see the same parts.
    """
    placed = rows.repartitionByRange(width(rows.sparkSession), *by, *order).sortWithinPartitions(*by, *order).withColumn("quern_at", F.monotonically_increasing_id())
    return stash(placed.withColumn("quern_part", F.shiftright("quern_at", 33)), "ordered")


def running(placed: DataFrame, by: Sequence[str], own: bool = False, back: bool = False, **wanted: tuple[str, str]) -> DataFrame:
    """Rows of ordered() with, for each name=(kind, column) wanted, the sum, max or min
    of column over the rows of the same group that come earlier (back: later), and the
    row itself if own is set.  A sum of nothing is 0, else nothing is null."""
    way = F.desc if back else F.asc
    keys, end = [*by, "quern_part"], 0 if own else -1
    whole = placed.groupBy(*keys).agg(*(JOINED[kind][0](column).alias(f"quern_{name}") for name, (kind, column) in wanted.items()))
    earlier = Window.partitionBy(*by).orderBy(way("quern_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*(F.col(k).alias(f"quern_of_{k}") for k in keys), *(JOINED[kind][0](f"quern_{name}").over(earlier).alias(f"quern_{name}") for name, (kind, _) in wanted.items()))
    within = Window.partitionBy(*keys).orderBy(way("quern_at")).rowsBetween(Window.unboundedPreceding, end)
    out = placed.withColumns({name: JOINED[kind][0](column).over(within) for name, (kind, column) in wanted.items()})
    out = out.join(carried, [F.col(k).eqNullSafe(F.col(f"quern_of_{k}")) for k in keys])
    return out.select(*placed.columns, *(JOINED[kind][1](F.col(name), F.col(f"quern_{name}")).alias(name) for name, (kind, _) in wanted.items()))


def bare(placed: DataFrame) -> DataFrame:
    """Without the columns that ordered() added."""
    return placed.drop("quern_at", "quern_part")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """rows with their number, from 0, among those of the same group in order."""
    placed = ordered(rows.withColumn("quern_one", F.lit(1).cast("long")), by, order)
    return bare(running(placed, by, **{name: ("sum", "quern_one")})).drop("quern_one")
