"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master that names no checkpoint folder (tests, laptops).
LOCAL_CHECKPOINT_DIR = "/tmp/concordat-checkpoints"


def local_session(app: str = "concordat", cpus: str | int = 8, partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; they need no copy of it and no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_concordat_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="concordat-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "concordat.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".yaml"):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(target)
    sc._concordat_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the one set by setCheckpointDir. Only a local master, all
    of whose tasks see the local disk, gets a local folder by default; elsewhere a missing one is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        return current.get()
    if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = found or LOCAL_CHECKPOINT_DIR
    if not current.isDefined():
        sc.setCheckpointDir(found)
    return found


_written: list[str] = []


def track(path: str) -> None:
    """Have release() delete a folder too."""
    _written.append(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that materialize() wrote; call it when no DataFrame made from them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _release_local() -> None:
    for path in _written:
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Column types and order are kept. An empty df gives an empty df.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"concordat-{name}-{uuid.uuid4().hex}")
    _written.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_parts(parts: Iterable[DataFrame], name: str = "step") -> DataFrame:
    """materialize() of the union of at least one table of the same columns, one part after the other, so the driver holds
    the plan of one part at a time; parts may be made when they are asked for."""
    path = schema = spark = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = os.path.join(shared_dir(spark), f"concordat-{name}-{uuid.uuid4().hex}")
            _written.append(path)
        df.select(*schema.names).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, tables: str | dict[str, DataFrame], name: str) -> DataFrame:
    """A table of a folder of Parquet tables, or of tables in hand."""
    return spark.read.parquet(f"{tables}/{name}.parquet") if isinstance(tables, str) else tables[name]


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A table that already has as many partitions is left alone, so large inputs aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize_all(dfs: list[DataFrame], name: str = "step") -> list[DataFrame]:
    """materialize() of several independent tables at once, so that small jobs share the cores."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(lambda df: materialize(df, name), dfs))
