"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lexispark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stored tables, as spark.checkpoint.dir names it.

    Only a local master, whose executors share the driver's disk, may do without the setting: there a temporary folder
    is set. Elsewhere a missing setting is an error, as executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexispark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by spark.checkpoint.dir. Executors that get lost lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    context = spark.sparkContext
    done = context.applicationId
    if done in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexispark-code-")) / "lexispark.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(done)


_SHIPPED: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder; what is written there is deleted with the application, or by drop_stored()."""
    context = spark.sparkContext
    target = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    _STORED.append((context.applicationId, target))
    return target


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage by a compressed parquet table in the shared folder: columns not needed later aren't read back.

    The shuffle files that made the table are deleted as soon as it is written (CLEANUP), so they don't pile up on the workers'
    disks. The table is deleted when the application ends, or by released() or drop_stored(). ``options`` go to the parquet writer.
    """
    conf = df.sparkSession.conf
    target = scratch(df.sparkSession)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(target)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(target)


#: Whether Spark deletes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def released(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again, before the application ends."""
    for df in tables:
        context = df.sparkSession.sparkContext
        folders = {_plain(f.rsplit("/", 1)[0]) for f in df.inputFiles()}
        for entry in [x for x in _STORED if _plain(x[1]) in folders]:
            path = context._jvm.org.apache.hadoop.fs.Path(entry[1])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            _STORED.remove(entry)


_STORED: list[tuple[str, str]] = []


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables stored so far by this application, once the results built on them are written; how many."""
    context = spark.sparkContext
    own = [x for x in _STORED if x[0] == context.applicationId]
    for entry in own:
        path = context._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.remove(entry)
    return len(own)
