"""Session helpers: reading tables, and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_staged: list[tuple[SparkSession, str]] = []
_own = threading.local()
_shipped: set[str] = set()
_kept: dict = {}
#: Whether Spark deletes the shuffle files of a query at its end, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the Parquet directory ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local master may go without: then a temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by release() or at exit."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    (getattr(_own, "paths", None) or [_staged])[-1].append((spark, path))
    return path


@contextmanager
def scratch(paths: list):
    """What this thread stages meanwhile is noted in ``paths``, to be deleted by discard() once its results have been used."""
    _own.paths = [*getattr(_own, "paths", []), paths]
    try:
        yield paths
    finally:
        _own.paths = _own.paths[:-1]


def discard(paths: list) -> None:
    """Deletes staged paths; results that still read them become invalid."""
    while paths:
        spark, path = paths.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone
            if path.startswith("file://"):
                shutil.rmtree(path[len("file://") :], ignore_errors=True)


def kept(key: tuple, make):
    """What ``make`` returns, made once for each key until release(); it may stage tables, which stay as long."""
    if key not in _kept:
        with scratch(_staged):
            _kept[key] = make()
    return _kept[key]


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    What follows can be recomputed from those files when an executor is lost,
    and work that several branches need is done once.  The shuffle files of the
    write go with it, and don't stay beside the table.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _opened(options: dict[str, str], path: str) -> dict[str, object]:
    import pyarrow.fs as pafs

    if path.startswith(("s3a://", "s3://")) and "access_key" in options:
        fs, root = pafs.S3FileSystem(**options), path.split("://", 1)[1]
    else:
        fs, root = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return {i.path: fs.open_input_file(i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and i.path.endswith(".parquet")}


def shared_files(spark: SparkSession):
    """A function for Python workers that opens the Parquet files below a path of the shared folder.

    It takes the session's credentials for object storage along, as workers have no session.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = {"access_key": "access.key", "secret_key": "secret.key", "session_token": "session.token", "endpoint_override": "endpoint", "region": "endpoint.region"}
    return partial(_opened, {k: v for k, n in names.items() if (v := conf.get(f"fs.s3a.{n}"))})


def release() -> None:
    """Deletes what stage() wrote outside of scratch(); results that still read it become invalid."""
    _kept.clear()
    discard(_staged)


atexit.register(release)


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Exactly the given columns under fixed names, so that extra columns of the input can't clash."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()))

