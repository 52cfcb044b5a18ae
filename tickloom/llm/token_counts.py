"""Token counts kept as delta-maintained rollups by source, language and tokenizer version.

State is a folder of batches, each a signed log by document (`docs`: +1 what a document counts now, -1 what it counted before)
and its sum by key (`rollup`). Totals are sums over batches, so inserts, deletes and revised counts only add rows. A batch counts once
its rollup has _SUCCESS, which Spark writes last; a batch id that has it is skipped, one that broke off is written anew. What a
document counted before is looked up in the logs by doc_id and tokenizer version, never by reading texts again.

`compact` writes what every document counts into a snapshot that stands for the logs of the batches so far; a commit makes one by
itself after COMPACT batches, so that looking up what documents counted reads one snapshot and a bounded number of logs. Snapshots only spare work: rollups
are untouched, and a snapshot that broke off is ignored.

Changes: doc_id, text, source, lang, op (insert, revise or delete), seq. An insert of a known document revises it; a delete of an unknown one does
nothing; of several changes of a document in a batch the last by seq counts (ties: delete first, then the most tokens, then the last source, lang). Recounting under
another tokenizer version is a batch of its own, beside the old version's counts.

Defined cases: null or empty text counts one document with 0 tokens; null source or lang is a key of its own; null doc_id
is an id of its own; repeated rows are one document; an empty batch is committed and changes nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("source", "lang", "tokenizer_version")
LOG = "doc_id long, source string, lang string, tokenizer_version string, docs long, tokens long"
ROLLUP = "source string, lang string, tokenizer_version string, docs long, tokens long"
PIECE = 1 << 16
#: Batches after which their logs are made one snapshot.
COMPACT = 16
SNAPSHOTS = "_snapshots"
_SAFE = re.compile(r"(?<=\S)(?= [^\s])")


def default_tokenizer() -> tuple[str, str]:
    """Path of a ranks file and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_BUILT: dict[int, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = hash((ranks, pattern))
    if key not in _BUILT:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _BUILT[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _BUILT[key]


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that no token crosses: cut only before a blank between two other characters."""
    at = 0
    while len(text) - at > PIECE and (m := _SAFE.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count(text: str | None, enc: tiktoken.Encoding) -> int:
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text)) if text else 0


class Rollup:
    """The counts in one state folder (on a file system that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str | None = None, pattern: str | None = None, version: str = "byte_bpe_50k/1"):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        if tokenizer is None:
            tokenizer, own = default_tokenizer()
            pattern = pattern or own
        with open(tokenizer, "rb") as f:  # the driver reads it; workers get it by broadcast
            self.shared = spark.sparkContext.broadcast((f.read(), pattern))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_"))
        return [n for n in names if fs.exists(self._fs(f"{self.path}/{n}/rollup/_SUCCESS")[1])]

    def _read(self, part: str, schema: str, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}/{part}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """Path of the snapshot that covers most batches, and these."""
        fs, p = self._fs(f"{self.path}/{SNAPSHOTS}")
        best: tuple[str | None, list[str]] = (None, [])
        for s in fs.listStatus(p) if fs.exists(p) else []:
            at = s.getPath().toString()
            if fs.exists(self._fs(f"{at}/batches/_SUCCESS")[1]):
                covered = sorted(r[0] for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect())
                best = max(best, (at, covered), key=lambda x: (len(x[1]), x[0] or ""))
        return best

    def known(self) -> DataFrame:
        """What each document counts now under each tokenizer version."""
        at, covered = self._snapshot()
        log = self._read("docs", LOG, [n for n in self.committed() if n not in covered])
        if at:
            log = log.unionByName(self.spark.read.schema(LOG).parquet(f"{at}/docs"))
        log = log.groupBy("doc_id", *KEY, (F.col("tokens") * F.col("docs")).alias("tokens")).agg(F.sum("docs").alias("docs"))
        return log.where("docs > 0").select("doc_id", *KEY, "tokens")

    def compact(self) -> None:
        """Make one snapshot of all logs so far. The list of batches is written last, so a snapshot counts only when whole."""
        names = self.committed()
        at = f"{self.path}/{SNAPSHOTS}/{uuid.uuid4().hex}"
        self.known().select("doc_id", *KEY, F.lit(1).cast("long").alias("docs"), "tokens").write.parquet(f"{at}/docs")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{at}/batches")

    def count(self, docs: DataFrame) -> DataFrame:
        """doc_id, source, lang and the tokens of each row's text."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoding(*shared.value)
            for b in batches:
                n = pa.array([count(t, enc) for t in b.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], [*names, "tokens"])

        names = ["doc_id", "source", "lang", "op", "seq"]
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "op", F.col("seq").cast("long").alias("seq"), "text")
        return d.mapInArrow(run, "doc_id long, source string, lang string, op string, seq long, tokens long")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Take in a batch of changes; False if it had been already. Safe to repeat after any failure."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch) or batch.startswith(("_", ".")):
            raise ValueError(f"not a batch id: {batch!r}")
        before = self.committed()
        if batch in before:
            return False
        if len(before) - len(self._snapshot()[1]) >= COMPACT:
            self.compact()
        at = f"{self.path}/{batch}"
        counted = self.count(changes)
        order = F.struct("seq", F.col("op") == "delete", "tokens", "source", "lang")
        last = counted.groupBy("doc_id").agg(F.max_by(F.struct("op", "source", "lang", "tokens"), order).alias("c")).select("doc_id", "c.*")
        new = last.where("op <> 'delete'").select("doc_id", "source", "lang", F.lit(self.version).alias("tokenizer_version"), F.lit(1).cast("long").alias("docs"), "tokens")
        log = new
        if before:
            ids = last.select(F.col("doc_id").alias("_i"))
            old = self.known().where(F.col("tokenizer_version") == self.version)
            old = old.join(ids, old["doc_id"].eqNullSafe(ids["_i"]), "left_semi")
            log = new.unionByName(old.select("doc_id", *KEY, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens")))
        # Signed rows: docs is +1 or -1 and tokens has its sign, so both add up.
        log.write.mode("overwrite").parquet(f"{at}/docs")
        own = self.spark.read.schema(LOG).parquet(f"{at}/docs")
        own.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{at}/rollup")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens over all committed batches; keys without documents left are gone."""
        out = self._read("rollup", ROLLUP, self.committed()).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0")
