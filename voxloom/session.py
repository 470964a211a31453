"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that suit rows with long arrays; set the same on a cluster.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    # Array columns make whole-stage methods long, and the JIT compiles long
    # loops badly.  Stages above this bytecode size run faster as separate
    # projections: a build of 200,000 rows took 12 s instead of 17 s.
    "spark.sql.codegen.hugeMethodLimit": "2000",
    # The Parquet reader holds this many whole rows per task.  The default of
    # 4096 fills the heap with token arrays; raw audio needs far less still.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}

# For tables of long arrays that the library writes.  A reader's batch never crosses a row
# group, so that it holds this many whole rows at most, whatever the session's batch size.
LONG_ROWS = {"parquet.block.row.count.limit": "128"}

# The same, small on disk.  Positions and samples seldom repeat or lie in any order: as
# differences they shrink to a few bits, as numbers in a dictionary hardly at all.
COMPACT_ROWS = {
    **LONG_ROWS,
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#position_ids.list.element": "false",
}


def local_session(cpus: int | str = "*", *, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxloom")
        .config(map=RECOMMENDED)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    if not spark.conf.get(CHECKPOINT_KEY, None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxloom-"))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A path without a scheme lies in the session's default file system, as everywhere
    in Spark: it is returned with that file system's scheme, so that driver, executors
    and other libraries mean the same folder.  Without a folder, a local master gets a
    temporary one; a cluster must name one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not named and local:
        named = tempfile.mkdtemp(prefix="voxloom-")
        spark.sparkContext.setCheckpointDir(named)
    if not named:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if ":" not in named.split("/")[0]:
        place, system = _file_system(spark, named)
        named = system.makeQualified(place).toString()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/voxloom/{name}-{uuid.uuid4().hex}"


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a staged table below the shared folder; any other path is refused."""
    if not path.startswith(f"{shared_dir(spark)}/voxloom/"):
        raise ValueError(f"{path!r} is not a staged table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    place, system = _file_system(spark, path)
    return [found.getPath().getName() for found in system.listStatus(place)] if system.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the library itself has written."""
    place, system = _file_system(spark, path)
    system.delete(place, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder that the library itself has written another name in the same file system."""
    place, system = _file_system(spark, path)
    if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot move {path!r} to {to!r}")
