"""A snapshot cache with a time to live, and the chain of sources behind it, by age.

The cache is keyed state of a stream of puts and gets: a put keeps its value until its time to live is over (a timer clears the
state, so keys that nobody writes any more cost nothing), a get is answered with the value and its age, or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.streaming.inorder import Step, in_order


def keep(ttl_ms: int) -> Step:
    """A value of age ``ttl_ms`` is gone; of rows at the same time the one with the smaller id comes first."""

    def step(due, state, now):
        out = []
        for at, number, put, value in due:
            if state is not None and state[1] + ttl_ms <= at:
                state = None
            if put:
                state = (value, at)
            else:
                out.append((number, at, *((None, None) if state is None else (state[0], at - state[1]))))
        if state is not None and state[1] + ttl_ms <= now:
            state = None
        return out, state, None if state is None else state[1] + ttl_ms

    return step


def cached(requests: DataFrame, key: str, time: str, number: str, put: Column, value: Column, ttl_ms: int, late: str) -> DataFrame:
    """(key, id, at_ms, cached, age_ms): the answer to each get of a stream of puts (``put`` true, with a ``value``) and gets;
    null where the cache has nothing as young as ``ttl_ms``. Rows with a null key or time are left out."""
    rows = requests.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(key, time, F.unix_millis(time).alias("at_ms"), F.col(number).cast("long").alias("id"), F.coalesce(put, F.lit(False)).alias("put"), value.cast("double").alias("value"))
    return in_order(rows, key, keep(ttl_ms), "value double, since long", "id long, at_ms long, cached double, age_ms long")


def first_source(sources: list[tuple[str, Column, Column]], most_ms: dict[str, int], otherwise: Column) -> tuple[Column, Column]:
    """(name, value) of the first of ``sources`` (name, value, age in ms) that has a value which is not older than its ``most_ms``
    (no entry: of any age); ``default`` and ``otherwise`` if none has."""
    name, value = F.lit("default"), otherwise
    for source, own, age in reversed(sources):
        fits = own.isNotNull() if source not in most_ms else own.isNotNull() & (age <= most_ms[source])
        name, value = F.when(fits, source).otherwise(name), F.when(fits, own).otherwise(value)
    return name, value
