"""Leases for jobs that run at intervals: one owner at a time, expiry, fencing numbers, and late runs folded into one.

Attempts to run a job come as a stream, and so do the ends of runs. An attempt gets the lease if nobody holds it, or the
holder's time is over; each lease has a higher fencing number than all before it, by which a store can refuse what a former
holder still writes. An end releases the lease only if it is that run's own. A job is due once in each interval: an attempt for
an interval that has been run is done already, and one that comes after intervals were missed stands for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zenithal.streaming.inorder import Step, in_order


def lease(ttl_ms: int, every_ms: int) -> Step:
    """The state is (run that holds it, until when, fencing number, last interval)."""

    def step(due, state, now):
        holder, until, fence, last = state or (-1, 0, 0, None)
        out = []
        # A run that takes no time ends behind its own attempt, not before it.
        begun = {(at, number) for at, number, _, ends in due if not ends}
        for at, number, owner, ends in sorted(due, key=lambda x: (x[0], not x[3] or x[:2] in begun, x[1], x[3])):
            if ends:
                if holder == number and at < until:
                    until = at
                    out.append((number, owner, "released", at, fence, 0))
                continue
            slot = at // every_ms
            if at < until:
                out.append((number, owner, "busy", at, fence, 0))
            elif last is not None and slot <= last:
                out.append((number, owner, "done", at, fence, 0))
            else:
                holder, until, fence = number, at + ttl_ms, fence + 1
                out.append((number, owner, "run", at, fence, 1 if last is None else slot - last))
                last = slot
        return out, (holder, until, fence, last), None

    return step


def leases(attempts: DataFrame, job: str, time: str, number: str, owner: str, end: str, ttl_ms: int, every_ms: int, late: str) -> DataFrame:
    """(job, id, owner, outcome, at_ms, fence, folded) for a stream of attempts with the time at which each would ``end``.

    ``outcome``: ``run`` (``folded``: so many due runs in one), ``busy``, ``done``, and ``released`` for ends that come before
    the lease expires. An end at the same time as an attempt of another run comes first. Rows with a null job or time are left out."""
    rows = attempts.where(F.col(job).isNotNull() & F.col(time).isNotNull() & F.col(end).isNotNull())
    both = F.explode(F.array(F.struct(F.col(time).alias("time"), F.lit(False).alias("ends")), F.struct(F.col(end).alias("time"), F.lit(True).alias("ends")))).alias("x")
    rows = rows.select(job, F.col(number).cast("long").alias("number"), F.col(owner).alias("owner"), both).select(job, F.col("x.time").alias("time"), "number", "owner", F.col("x.ends").alias("ends")).withWatermark("time", late)
    rows = rows.select(job, "time", F.unix_millis("time").alias("at_ms"), F.col("number").alias("id"), "owner", "ends")
    return in_order(rows, job, lease(ttl_ms, every_ms), "holder long, until long, fence long, last long", "id long, owner string, outcome string, at_ms long, fence long, folded long")
