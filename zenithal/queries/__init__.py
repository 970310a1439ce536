"""All queries of the library (without the optional subpackage) and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from zenithal.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_country_risk"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
