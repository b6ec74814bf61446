"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestack")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver
    imported it from: Python workers don't have the driver's import path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="lodestack-code-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = os.path.join(folder, "lodestack.zip")
    with zipfile.PyZipFile(at, "w") as z:
        z.writepy(str(package))
        for f in package.rglob("*.json"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that
    is unset on a local master, a new temporary one. On a cluster an unset
    folder is an error, since a machine-local one is lost with its machine."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get(CHECKPOINT_KEY, None) or _own_dir.get(app)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="lodestack-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    _own_dir[app] = f"file://{at}"  # the setting itself can't be changed in a running session
    return _own_dir[app]


def spread(df: DataFrame) -> DataFrame:
    """A scan as it is, unless it has fewer parts than there are cores: then its
    rows are dealt anew, lest a stage of Python run in a few tasks only. Large
    inputs have parts enough and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a re-run,
    and so that two consumers don't run an expensive stage twice.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which ``release`` deletes, or else the driver's end."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if sc.applicationId not in _written:
        # what nobody released goes with the driver's end
        atexit.register(_sweep, sc.applicationId, sc._jvm, sc._jsc.hadoopConfiguration())
    _written.setdefault(sc.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}


def _delete(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _sweep(application: str, jvm, conf) -> None:
    try:
        _delete(jvm, conf, _written.pop(application, []))
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        return


def discard(df: DataFrame) -> None:
    """Delete the tables of ``written`` that ``df`` reads; nothing may be derived from it afterwards."""
    spark = df.sparkSession
    mine = _written.get(spark.sparkContext.applicationId, [])
    gone = [p for p in mine if any(f"{p.split('://')[-1]}/" in f for f in df.inputFiles())]
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), gone)
    mine[:] = [p for p in mine if p not in gone]


def release(spark: SparkSession) -> None:
    """Delete the tables ``written`` made in this application; every frame that
    was derived from them must have been used by then."""
    sc = spark.sparkContext
    _delete(sc._jvm, sc._jsc.hadoopConfiguration(), _written.pop(sc.applicationId, []))
