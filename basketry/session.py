"""Session settings and the shared-folder staging used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "basketry",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # per-user modes and medians keep small value maps: let more of them stay hashed
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# One task's input, whatever the tables' size: bytes of a file split, of a shuffle partition, and of tables for each partition
# that a shuffle starts with (AQE merges the small ones).
SPLIT_BYTES = 8 << 20
SHUFFLE_BYTES = 16 << 20
TABLE_BYTES = 4 << 20
_FOLDER_BYTES: dict[tuple[str, str], int] = {}


def bound_tasks(spark: SparkSession, folder: str) -> None:
    """Let the number of tasks grow with the tables in ``folder``, not the rows that one task sorts or hashes.

    Otherwise splits of scans grow with the files up to 128 MB, and a fixed number of shuffle partitions takes ever more rows
    each. Smaller settings of the session stay.
    """
    conf = spark.conf
    for key, most in (("spark.sql.files.maxPartitionBytes", SPLIT_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)):
        if size_of(conf.get(key)) > most:
            conf.set(key, str(most))
    at = (spark.sparkContext.applicationId, folder)
    if at not in _FOLDER_BYTES:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        _FOLDER_BYTES[at] = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    partitions = max(int(conf.get("spark.sql.shuffle.partitions")), _FOLDER_BYTES[at] // TABLE_BYTES)
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))


def size_of(text: str) -> int:
    """Bytes of a size setting such as 64MB, 16m or 1048576b."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


_LOCAL_ROOT: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local-mode session may run without it; then one folder under /tmp is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="basketry-"))
    return _LOCAL_ROOT[0]


#: While a table is staged: its shuffles are deleted at the end, not when the driver's memory is next cleaned up.
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Parts of a union that are one partition each stay as many partitions.
_APART = {"spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, label: str = "stage", partition_by: str | None = None, apart: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs then see one fixed copy (a float sum recomputed in another order could
    move a row across a cut), and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _settings(spark, _STAGING | (_APART if apart else {})):
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; only what stage() itself returned."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Seconds between two looks for shuffles that an iterative fit no longer needs.
RELEASE_SECONDS = 10


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffles of past iterations while a fit runs, not when the driver's memory is next cleaned up.

    With ``keep_lineage_short`` and a checkpoint an iteration nothing refers to them any more.
    """
    done = threading.Event()

    def run() -> None:
        while not done.wait(RELEASE_SECONDS):
            spark.sparkContext._jvm.System.gc()

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    try:
        yield
    finally:
        done.set()
        worker.join()


def keep_lineage_short(spark: SparkSession) -> None:
    """Lets iterative fits write checkpoints to the shared folder, where no folder is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
