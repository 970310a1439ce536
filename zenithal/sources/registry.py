"""Named sources: functions from a session and options to records, and a reader for Spark's own ``format(...)``.

``register("satcat", read)`` adds one; ``run`` reads it and gives its rows or, where it fails, one row that says why, so that
one bad source doesn't end the ingestion of all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from zenithal.session import ship
from zenithal.sources.catalogues import id_ranges

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = fn
        return fn

    return add


def add_formats(spark: SparkSession) -> None:
    """Make this module's formats known to ``spark.read.format``."""
    ship(spark)
    spark.dataSource.register(IdRangeSource)


def run(spark: SparkSession, name: str, **options) -> tuple[DataFrame | None, str | None]:
    """(rows, None) or (None, error) of a registered source."""
    try:
        return SOURCES[name](spark, **options), None
    except Exception as e:  # noqa: BLE001 - the error is the result
        return None, f"{type(e).__name__}: {e}"


class IdRangeSource(DataSource):
    """``spark.read.format("id_ranges")``: ids from ``first`` to ``last``, a partition for each range of ``size``: the shape
    of a reader that fetches a catalogue range by range."""

    @classmethod
    def name(cls) -> str:
        return "id_ranges"

    def schema(self) -> str:
        return "norad_id long, range int"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = id_ranges(int(options.get("first", 1)), int(options.get("last", 99_999)), int(options.get("size", 30_000)))

    def partitions(self):
        return [InputPartition((i, a, b)) for i, (a, b) in enumerate(self.ranges)]

    def read(self, partition):
        i, a, b = partition.value
        for norad in range(a, b + 1):
            yield norad, i


@register("un_registry")
def un_registry(spark: SparkSession, rows: list[dict] | None = None) -> DataFrame:
    """Seed rows (name, country, year) as records."""
    df = spark.createDataFrame([(r["name"], r.get("country"), r.get("year")) for r in rows or []], "name string, country string, year int")
    return df.select(F.concat(F.lit("un-"), F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", "-"))).alias("source_id"), "name", "country", "year")
