"""Spark session settings and what workers need of this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC and ANSI decimals."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, unless their PYTHONPATH already leads to it. Once a context.

    Executors get it as a file. What Spark runs in Python beside the driver (planning of sources, set-up of typed state) gets no such files, but the path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False) or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), sc.environment.get("PYTHONPATH")]))
    at = Path(tempfile.mkdtemp(prefix="tickloom-zip-")) / "tickloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "tickloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    sc.addPyFile(str(at))
    sc._tickloom_shipped = True


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share (spark.checkpoint.dir), deleted when the driver ends. Only a local session may go without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    at = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            pass

    atexit.register(clear)
    return at


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for a while, and then what it was. Streams keep the one they were started with."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that what reads it several times does not run it several times."""
    at = work_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
