"""Per-group top-k and paging (every ``$sort``+``$limit`` becomes per-group when run set-at-a-time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_k(df: DataFrame, group: Sequence, order: Sequence, k: int | Column,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group under a total order.

    With a literal ``k``, ``row_number() <= k`` plans as a partial ``WindowGroupLimit``
    before the shuffle and a final one after it, so a hot group never carries more than
    k rows per task into the exchange. ``k`` may be a column (a per-group limit), which
    gives up that partial limit; callers with per-request limits pass the largest one as
    a literal and apply each request's own limit when joining back.
    """
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    limit = k if isinstance(k, Column) else F.lit(k)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= limit)


def page(df: DataFrame, group: Sequence, order: Sequence, offset: Column | int,
         limit: Column | int, rank_col: str = "rank") -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of each group (``$skip`` + ``$limit``)."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    w = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where((F.col(rank_col) > off) & (F.col(rank_col) <= off + lim)))
