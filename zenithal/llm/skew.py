"""Joins with a table of one row per key, where few keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one of so many rows. So there are at most as many hot keys: what is broadcast is bounded.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str, copies: str, how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``; ``copies``: how many of ``rows`` have it, which is dropped).

    Hot keys are broadcast, so their rows stay where they are; all others are joined by shuffle, where no key has more than one
    of ``share`` rows. Null keys meet nothing and are not shuffled; ``how`` is "inner" or "left". ``table`` should be a written one.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    is_hot = F.col(copies) * share >= total
    hot, cold = F.broadcast(table.where(is_hot).drop(copies)), table.where(~is_hot).drop(copies)
    some = rows.where(F.col(key).isNotNull())
    out = some.join(hot, key).unionByName(some.join(hot.select(key), key, "left_anti").join(cold, key, how))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
