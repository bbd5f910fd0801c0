"""Session factory and the shared scratch folder.

Intermediate tables are written as Parquet below the folder the cluster names
in ``spark.checkpoint.dir``; every executor can read them again after another
executor is lost.  Only where that setting is missing and Spark runs within this
process (tests, notebooks) a temporary folder of this machine is used; on a
cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.errors import InvalidRequest

_LOCAL_ROOT: list[str] = []
_WRITTEN: list[str] = []


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return the active session or build one with the settings the engine expects."""
    active = SparkSession.getActiveSession()
    if active is not None and not conf:
        return active
    b = (
        SparkSession.builder.appName("weftline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise InvalidRequest("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="weftline-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], ignore_errors=True)
    return _LOCAL_ROOT[0]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy.

    The result no longer depends on the lineage of ``df``.  An empty frame
    gives an empty table with the same schema.  :func:`release` deletes the copies.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written, once no frame needs them; their number."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def execution(spark: SparkSession, partitions: int | None = None, **conf: str) -> Iterator[SparkSession]:
    """Settings for the actions inside a ``with`` block; they are put back at its end."""
    wanted = {k.replace("__", "."): str(v) for k, v in conf.items()} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor; once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="weftline-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/weftline.zip", "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(f"{folder}/weftline.zip")
        # the driver's own helper processes (streams, data sources) take the package from where it lies
        held = sc.environment.get("PYTHONPATH")
        sc.environment["PYTHONPATH"] = f"{here.parent}:{held}" if held else str(here.parent)
    return spark
