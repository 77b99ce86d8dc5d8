"""Session builder and the few cluster-level helpers every operator shares."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_scratch: dict[str, str] = {}
_temporary: list[list[str]] = []
#: Spark's own setting by which a query's shuffle files are removed when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexmill", **conf: str) -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(Path(_PACKAGE.name) / path.relative_to(_PACKAGE)))
    folder = tempfile.mkdtemp(prefix="lexmill-ship-")  # read by the driver's file server only
    target = os.path.join(folder, f"lexmill_{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = _hadoop_path(spark, path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; what is left lies in the scratch folder only
        pass


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables: below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is missing (tests, a single machine) a local temporary folder is used.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        _scratch[app] = f"{base.rstrip('/')}/lexmill-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _scratch[app])
    return _scratch[app]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and return a scan of it.

    This cuts the lineage like ``checkpoint()`` but keeps columns compressed and prunable, survives the
    loss of any executor, and gives the optimizer the table's real size, so that it broadcasts the table
    only when it is below ``spark.sql.autoBroadcastJoinThreshold``.  The shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _temporary:
        _temporary[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`materialize` makes inside are deleted at the end, except those given to the function
    that this yields.  What is returned from inside must not read the others."""
    _temporary.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        paths, stay = _temporary.pop(), {_folder(path) for df in kept for path in df.inputFiles()}
        for path in paths:
            if Path(path).name not in stay:
                _delete(spark, path)
            elif _temporary:
                _temporary[-1].append(path)


def _folder(file: str) -> str:
    return Path(file).parent.name


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for df in tables:
        for path in df.inputFiles()[:1]:
            if "/lexmill-" in path:
                _delete(df.sparkSession, path.rsplit("/", 1)[0])


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose size Spark can't foresee."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the scan has fewer partitions than the session has cores (a few small files).

    Larger inputs have enough splits of their own and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
