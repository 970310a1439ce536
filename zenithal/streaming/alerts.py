"""Alert rules with a hold time over a stream of samples: pending, firing, resolved.

A rule's condition that turns true makes its key pending; if it stays true for the hold time, the key fires, whether or not a
sample comes at that moment (a timer on event time tells); a sample that is false again resolves it, or drops a pending one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.streaming.inorder import Step, in_order


def hold(hold_ms: int) -> Step:
    """Of samples at the same time the one with the smaller id comes first, and a false sample at the very moment at which the
    hold time ends comes before it."""

    def step(due, state, now):
        phase, since = state or ("ok", 0)
        out = []
        for at, _, bad in due:
            if phase == "pending" and since + hold_ms < at:
                phase = "firing"
                out.append((phase, since + hold_ms, since))
            if bad and phase == "ok":
                phase, since = "pending", at
                out.append((phase, at, at))
            elif not bad and phase != "ok":
                out.append(("resolved" if phase == "firing" else "dropped", at, since))
                phase, since = "ok", 0
        if phase == "pending" and since + hold_ms <= now:
            phase = "firing"
            out.append((phase, since + hold_ms, since))
        return out, None if phase == "ok" else (phase, since), since + hold_ms if phase == "pending" else None

    return step


def alert_states(samples: DataFrame, key: str, time: str, number: str, bad: Column, hold_ms: int, late: str) -> DataFrame:
    """(key, state, at_ms, since_ms): each change of state of each key of a stream of samples.

    ``number``: a whole number that orders samples of the same time; ``bad``: the rule's condition, null counts as false;
    ``late``: how far behind the latest sample others may come. Rows with a null key or time are left out."""
    rows = samples.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = rows.select(key, time, F.unix_millis(time).alias("at_ms"), F.col(number).cast("long").alias("id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return in_order(rows, key, hold(hold_ms), "phase string, since long", "state string, at_ms long, since_ms long")
