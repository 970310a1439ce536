"""Event streams: alerts, live positions, idempotent logs, windows, sessions and state per object.

All take and return streaming or batch frames; a caller starts the query with its own sink, trigger and checkpoint folder.
``run_once`` does this for what is there now, so that a stream can be checked like a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.functions.orbit import risk_band
from zenithal.session import shared_dir, ship


def alerts(conjunctions: DataFrame, as_of: Column) -> DataFrame:
    """Red and yellow conjunctions as messages: hours to the closest approach, never below 0, and the payload as JSON."""
    rows = conjunctions.withColumn("risk", risk_band(F.col("pc"))).where(F.col("risk").isin("red", "yellow"))
    hours = F.round(F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", as_of, F.col("tca")) / 3600.0), 2)
    rows = rows.withColumn("hours_remaining", hours)
    payload = F.to_json(F.struct("conjunction_id", "risk", "pc", "primary_norad", "secondary_norad", "hours_remaining"))
    return rows.select("conjunction_id", "risk", "hours_remaining", payload.alias("payload"))


def parse_alerts(messages: DataFrame, column: str = "payload") -> DataFrame:
    """Messages as columns; what is no JSON of this shape is kept in ``raw``."""
    r = F.from_json(F.col(column), "conjunction_id long, risk string, pc double, hours_remaining double")
    bad = r["conjunction_id"].isNull()
    return messages.select(r["conjunction_id"].alias("conjunction_id"), r["risk"].alias("risk"), r["hours_remaining"].alias("hours_remaining"), F.when(bad, F.col(column)).alias("raw"))


def once_per_key(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """An idempotent log: a key is taken once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, length: str, slide: str | None, late: str, key: str, value: str) -> DataFrame:
    """(window start, key, n, total) of tumbling or sliding windows; rows behind the watermark are late and don't count."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,6)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key with pauses shorter than ``gap``."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_positions(ticks: DataFrame, states: DataFrame, ids: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """The whole snapshot at every tick (``timestamp``), or of the given ids: a stream joined with a table.

    The table is dealt in ``parts`` by its ids, and a tick goes once to each of them, so neither side is broadcast, whatever
    its size."""
    wanted = states if ids is None else states.join(ids.distinct(), "norad_id", "left_semi")
    dealt = wanted.withColumn("_part", F.pmod(F.xxhash64("norad_id"), F.lit(parts)).cast("int"))
    every = ticks.select("timestamp", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("_part"))
    return every.join(dealt, "_part").drop("_part")


ALERT_STATE = "norad_id long, event_id long, value double, previous double, streak int"


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Rising values in a row: state is the last value and the length of the run."""
    last, run = state.get if state.exists else (None, 0)
    # Spark cuts a key's rows into batches anywhere and in any order, so they are put in order over all of them.
    rows = pd.concat([b[["event_id", "value"]] for b in batches], ignore_index=True).sort_values("event_id")
    out = []
    for event_id, value in rows.itertuples(index=False):
        run = run + 1 if last is not None and value > last else 1
        out.append((key[0], event_id, value, last, run))
        last = value
    state.update((last, run))
    yield pd.DataFrame(out, columns=["norad_id", "event_id", "value", "previous", "streak"])


def rising_streaks(events: DataFrame) -> DataFrame:
    """Each event with the length of the run of rising values of its object, across micro-batches."""
    ship(events.sparkSession)
    return events.groupBy("norad_id").applyInPandasWithState(_streak, ALERT_STATE, "last double, run int", "append", "NoTimeout")


def run_once(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None, conf: dict[str, str] | None = None, files: int | None = None) -> DataFrame:
    """Read the files of ``path`` as a stream, transform them, and give what was written when all files are through.

    ``conf``: settings of the session while the query starts; ``files``: at most so many in a micro-batch."""
    out, marks = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")
    stream = (spark.readStream.schema(schema) if files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", files)).parquet(path)
    done = transform(prepare(stream) if prepare else stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = done.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if mode == "complete":
        last = max(q["batchId"] for q in query.recentProgress)
        return spark.read.schema(done.schema).parquet(f"{out}/batch={last}")
    return spark.read.schema(done.schema).parquet(f"{out}/batch=*")
