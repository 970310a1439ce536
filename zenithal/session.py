"""Session helpers: a local session for tests, the shared work folder, and shipping the package to executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()
_MADE: list[list[DataFrame]] = []


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("zenithal")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    path = Path(tempfile.mkdtemp()) / "zenithal_code.zip"  # the driver's own copy; Spark serves it to the executors
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in this application's own folder under the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session with a local master (tests) may lack that setting: it gets a local folder. Anywhere else executors would
    not see each other's files, so it is an error. The application's folder is deleted when the program ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.zenithal.local.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="zenithal-")
        spark.conf.set("spark.zenithal.local.dir", base)
    own = f"{base.rstrip('/')}/zenithal-{sc.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_delete, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, as long as the session is there."""
    with contextlib.suppress(Exception):  # the JVM may be gone; a scratch folder must not fail the program that has ended
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks_of(spark: SparkSession) -> int:
    """How many tasks a step takes whose rows are few and small, but not its results."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, and the files outlive any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._zenithal_path = path
    for made in _MADE[-1:]:
        made.append(out)
    return out


def by_slices(values: Callable[..., list], kind: pa.DataType, *columns: pa.Array, rows: int = 200) -> pa.Array:
    """What ``values`` makes of lists of ``rows`` values of each column in turn, as one array: a worker never holds the Python
    objects of a whole batch."""
    out = [pa.array(values(*(c.slice(at, rows).to_pylist() for c in columns)), kind) for at in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    if path := getattr(df, "_zenithal_path", None):
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Within it, tables made by :func:`materialize` are noted; at its end all but those put in the list are deleted.

    For steps whose result is written within: nothing that is still to be computed may read the deleted tables."""
    keep: list[DataFrame] = []
    _MADE.append([])
    try:
        yield keep
    finally:
        for df in _MADE.pop():
            if not any(df is k for k in keep):
                discard(df)
