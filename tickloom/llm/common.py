"""Helpers shared by the training-data operators: shared scratch space, row keys, word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow.fs
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank and \x09-\x0D. bytes.split() splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words that a worker keeps hashed at most; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Narrow tables are written by tasks of about so many rows, but by LEAST_FILES tasks at least where there are as many.
FILE_ROWS, LEAST_FILES = 500_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session may go without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir: local-cluster executors are processes of their own")
    own = "file://" + tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def trim(spark: SparkSession) -> str:
    """Hand back to the system what the driver's JVM has freed outside its heap: compiling and packing leave glibc some 200 MB. What the JVM says; empty if it has no such command (before 17.0.9)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    name = jvm.java.lang.Class.forName
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = name(kind)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by reflection, as the server's own class is not exported
        return str(name("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


class Scratch:
    """Written tables in the shared folder that cut the lineage: a lost executor re-reads them instead of starting over."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str, rows: int = 0) -> DataFrame:
        """Write df, with at most `rows` rows a file unless that is 0, and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
        trim(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_narrow(self, df: DataFrame, name: str, most: int) -> DataFrame:
        """Keep a table of narrow rows, whose last step reads `most` rows at most: in files by that bound, not one for each shuffle partition.

        Only the step after the last shuffle is run by fewer tasks; beyond FILE_ROWS a shuffle partition nothing changes.
        """
        return self.keep(df.coalesce(max(LEAST_FILES, -(-most // FILE_ROWS))), name)

    def files(self, name: str) -> list[str]:
        """The data files of a kept table, in order."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        found = p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(p)
        return sorted(f"{self.root}/{name}/{f.getPath().getName()}" for f in found if f.getPath().getName().startswith("part-"))

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")

    def free(self) -> None:
        """Let Spark delete the shuffle files of plans that are no longer in use; else they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim(self.spark)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A kept table dealt out by about `rows` rows a task: for rows that are heavy in work, not in bytes."""
    return df.repartition(max(1, -(-df.count() // rows)))


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a file or folder in the shared folder, for workers."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column of `taken` is called so (case apart)."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def text_key(text: str = "text") -> Column:
    """With doc_id it names a row: rows alike in both are decided alike."""
    return F.xxhash64(F.col(text))


def blank_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    t = blank_trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, BLANK_CLASS))).cast("long")


class _Words(dict):
    """Word -> 64-bit hash, held for repeated words up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def lower_words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at BLANKS, nothing else changed. Null: no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words, in order. Shorter texts: none."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
