"""Running values over groups of any size.

A plain window sorts a whole group in one task. One log, or one target of one log, may hold a
large share of all rows, so every ordered computation here runs in two levels:

1. inside *slices* of the group (a slice is a value that never decreases along the order, such as
   ``ord >> 20``), where a window sees at most one slice;
2. over one summary row per slice, whose running value is handed back to the slice by an
   equi-join on the slice key.

The row level needs one shuffle by ``keys + slice``; the summaries are pre-aggregated before their
own shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``ord`` is unique inside a log, so a slice holds at most 2**20 rows.
SLICE_BITS = 20
#: Slice width for rows by second or microsecond.
SLICE_SECONDS = 3600
#: Slice width for tables with one row per fight, encounter or override: about twelve days, so that slices hold many
#: rows and their summary stays far smaller than the table; a fight a second would fill 2**20 rows.
SPARSE_SLICE_SECONDS = 1 << 20


def ord_slice(ord_col) -> Column:
    return F.shiftright(F.col(ord_col) if isinstance(ord_col, str) else ord_col, SLICE_BITS)


def time_slice(seconds) -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(c / SPARSE_SLICE_SECONDS).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[str],
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    largest: Mapping[str, Column] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add columns computed over all rows *before* the current one in the group's order.

    ``last``: latest non-null value; ``total``: sum (0 when nothing precedes); ``largest``: maximum.
    With ``descending`` the rows *after* the current one count, nearest first.
    """
    last, total, largest = dict(last or {}), dict(total or {}), dict(largest or {})
    names = [*last, *total, *largest]
    values = [c.alias(f"_v_{n}") for n, c in {**last, **total, **largest}.items()]
    src = df.select("*", slice_col.alias("_slice"), *values)

    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    local = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(direction("_slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    # A single LONG keeps the summary a hash aggregation; a struct would make it sort.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    pick = F.min_by if descending else F.max_by
    aggs = []
    for n in last:
        v = F.col(f"_v_{n}")
        aggs.append(pick(v, F.when(v.isNotNull(), position)).alias(f"_s_{n}"))
    aggs += [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in total]
    aggs += [F.max(f"_v_{n}").alias(f"_s_{n}") for n in largest]
    summary = src.groupBy(*keys, "_slice").agg(*aggs)
    carried = [F.last(f"_s_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in last]
    carried += [F.sum(f"_s_{n}").over(across).alias(f"_c_{n}") for n in total]
    carried += [F.max(f"_s_{n}").over(across).alias(f"_c_{n}") for n in largest]
    summary = summary.select(*keys, "_slice", *carried)

    before = [F.last(f"_v_{n}", ignorenulls=True).over(local).alias(f"_l_{n}") for n in last]
    before += [F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in total]
    before += [F.max(f"_v_{n}").over(local).alias(f"_l_{n}") for n in largest]
    out = src.select("*", *before)
    out = out.join(summary, [*keys, "_slice"])
    final = [F.col(c) for c in df.columns]
    for n in names:
        lo, ca = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if n in last:
            final.append(F.coalesce(lo, ca).alias(n))
        elif n in total:
            final.append((F.coalesce(lo, F.lit(0)) + F.coalesce(ca, F.lit(0))).alias(n))
        else:
            final.append(F.greatest(lo, ca).alias(n))
    return out.select(*final)


def numbered(
    df: DataFrame, keys: Sequence[str], slice_col: Column, order: Sequence[str], name: str
) -> DataFrame:
    """1-based row number per group, in the two-level form."""
    out = running(df, keys, slice_col, order, total={"_before": F.lit(1)})
    return out.withColumn(name, F.col("_before") + 1).drop("_before")
