import datetime
import decimal
import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from zenithal.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def plain():
    """Values of either engine in one form, doubles to ten digits."""

    def norm(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, decimal.Decimal | float):
            return None if math.isnan(v) else float(v) if math.isinf(v) else float(f"{float(v):.10g}")
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        if hasattr(v, "asDict"):
            v = v.asDict()
        if isinstance(v, dict):
            return {k: norm(x) for k, x in v.items()}
        return [norm(x) for x in v] if isinstance(v, list | tuple) else v

    return norm
