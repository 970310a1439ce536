"""Changes of tables, each as a function from the old state (and a batch) to the new state.

Nothing is changed in place: the caller writes the result to a new path and swaps, or merges it into a table format that
can. Rows that the batch doesn't name pass through; hot keys are no burden, as each side has a key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.operators.joins import latest_per_key


def _last(batch: DataFrame, keys: list[str], version: str | None) -> DataFrame:
    order = [F.col(version)] if version else []
    return latest_per_key(batch, keys, [*order, F.xxhash64(*batch.columns)])


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], keep: list[str] = (), only: list[str] | None = None, version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``batch`` put in by key. A row that is there gets the batch's values, but for ``keep``; with
    ``only``, those columns alone, where they are not null. Of batch rows with one key, the greatest ``version`` counts."""
    new = _last(batch, keys, version)
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    mine, theirs, is_old, is_new = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}")), F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(mine(c), theirs(c)).alias(c)
        if c not in batch.columns or c in keep:
            return F.when(is_old, mine(c)).otherwise(theirs(c) if c in batch.columns else F.lit(None)).alias(c)
        if only is not None:
            changed = F.coalesce(theirs(c), mine(c)) if c in only else mine(c)
            return F.when(is_old, changed).otherwise(theirs(c)).alias(c)
        return F.when(is_new, theirs(c)).otherwise(mine(c)).alias(c)

    return both.select(*[value(c) for c in old.columns])


def insert_new(old: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``batch`` whose key is neither in ``old`` nor repeated before in the batch (by hash): what an insert adds."""
    return _last(batch, keys, None).join(old.select(*keys), keys, "left_anti")


def change(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Rows for which ``when`` holds get the given values (null conditions don't hold)."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def merge_edges(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges by (src, dst, type): new ones start with version 1, known ones get the batch's confidence and a version more."""
    keys = ["src", "dst", "type"]
    new = batch.groupBy(*keys).agg(F.max("confidence").alias("_c"))
    both = old.join(new, keys, "full_outer")
    version = F.when(F.col("version").isNull(), 1).when(F.col("_c").isNull(), F.col("version")).otherwise(F.col("version") + 1)
    return both.select(*keys, F.coalesce("_c", "confidence").alias("confidence"), version.alias("version"))


def transitions(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """(key, before, after) of the rows whose ``column`` differs: what a trigger would queue."""
    a, b = old.select(key, F.col(column).alias("before")), new.select(key, F.col(column).alias("after"))
    return a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))
