"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that all executors share.

    Where the setting is absent (a local master, as in tests) a folder of this process is made and set;
    on any other master its absence is an error, as a machine-local folder would not survive there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage and survives the loss of executors. :func:`clean` deletes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files of one's own; :func:`clean` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clean, spark)
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes the tables that operators have written in between, and tells how many. To be called when their results aren't
    needed any more; a process that ends without it calls it then, if the session still answers."""
    done = 0
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            done += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
        except Exception:  # the session has ended: what is left lies in the folder the cluster cleans
            break
    return done


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, wherever they start. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_pathloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pathloom-zip-")) / "pathloom.zip"
    atexit.register(shutil.rmtree, target.parent, True)
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._pathloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder, with the package at hand in the workers."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
