"""The raw log as a data source: recorded from a stream in two phases, and read back whole or as a live stream.

Recording. Tasks write an object for each group of records (topic, partition, source, instrument, hour, and stretch of offsets), cut at `maxBytes`.
An object's key and bytes follow from its records alone, so a batch that is killed and repeated leaves the same objects. When all are there, the
driver commits the batch: a file under _commits with the objects and the next offset of each partition. Nothing counts before.

Reading. A stream's offset is the next offset of each topic and partition, taken from the commits, so that it moves by whole batches of the recorder and
by `maxRecords` at most a batch. `startTime` (milliseconds) seeks each partition's first record that is not older. Objects are the unit of work. A batch read
has the same options, and `endTime`. Both give (topic, partition, offset, timestamp, key, value), value being text, or null where it was no JSON.
"""

from __future__ import annotations

import gzip
import io
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from tickloom.plans import sinks
from tickloom.sources import files

NAME = "rawlog"
SCHEMA = "topic string, partition int, offset bigint, timestamp bigint, key string, value string"
#: What the recorder takes: lines with where they go.
LINES = "topic string, partition int, offset bigint, timestamp bigint, line string, source string, instrument string, year int, month string, day string, hour string"
#: An object holds records of one stretch of offsets at most, so that a hot group is the work of many tasks.
STRETCH = 1 << 16
#: Records that a task reads at least, where there are as many, so that small objects are not a task each.
TASK = 50_000
MAX_BYTES = 8 << 20
MAX_AGE = "60 seconds"
COMMITS = "_commits"
_KINDS = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.int64()), ("key", pa.string()), ("value", pa.string())])


def packed(lines: list[bytes]) -> bytes:
    """Lines as a gzip file that depends on them only."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(b"".join(lines))
    return out.getvalue()


def object_key(group: tuple, first: int, last: int) -> str:
    topic, partition, source, instrument, year, month, day, hour = group
    return f"{topic}/{source}/{instrument}/{year}/{month}/{day}/{hour}/p{partition}-{first:020d}-{last:020d}.jsonl.gz"


@dataclass
class Stored(WriterCommitMessage):
    """An object's key, topic, partition, first and last offset, least and greatest time, records, and how many of these were no JSON."""

    objects: list[tuple]


class Recorder(DataSourceStreamWriter):
    def __init__(self, root: str, most: int):
        self.root, self.most = root, most

    def write(self, iterator: Iterator) -> Stored:
        groups: dict[tuple, list[tuple[int, int, bytes]]] = {}
        for r in iterator:
            group = (r.topic, r.partition, r.source, r.instrument, r.year, r.month, r.day, r.hour, r.offset // STRETCH)
            groups.setdefault(group, []).append((r.offset, r.timestamp, r.line.encode() + b"\n"))
        done = []
        for group, rows in sorted(groups.items()):
            rows.sort()
            while rows:
                size = n = 0
                while n < len(rows) and (not n or size + len(rows[n][2]) <= self.most):
                    size, n = size + len(rows[n][2]), n + 1
                part, rows = rows[:n], rows[n:]
                key = object_key(group[:8], part[0][0], part[-1][0])
                files.put(f"{self.root}/{key}", packed([line for _, _, line in part]))
                times = [t for _, t, _ in part]
                done.append((key, group[0], group[1], part[0][0], part[-1][0], min(times), max(times), n, n if group[2] == "_unparsed" else 0))
        return Stored(done)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        objects = sorted(o for m in messages if m is not None for o in m.objects)
        names = [n for n in files.listed(f"{self.root}/{COMMITS}") if n < f"{batchId:020d}"]
        following = json.loads(files.get(f"{self.root}/{COMMITS}/{names[-1]}"))["next"] if names else {}
        for _, topic, partition, _, last, *_ in objects:
            at = f"{topic}/{partition}"
            following[at] = max(following.get(at, 0), last + 1)
        told = {"next": following, "objects": objects, "records": sum(o[7] for o in objects), "unparsed": sum(o[8] for o in objects)}
        files.put(f"{self.root}/{COMMITS}/{batchId:020d}.json", json.dumps(told).encode())

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        """Objects of a batch that failed stay: no commit names them, and its repetition writes them again."""


class ObjectPart(InputPartition):
    """Of some objects of one topic and partition, the records from an offset to before another, and of a range of times."""

    def __init__(self, keys: list[str], first: int, end: int, times: tuple[int, int]):
        super().__init__((keys, first, end, times))


def records(root: str, part: ObjectPart) -> Iterator[pa.RecordBatch]:
    keys, first, end, (since, until) = part.value
    for key in keys:
        out = []
        for line in gzip.decompress(files.get(f"{root}/{key}")).splitlines():
            head, sign, value = line.partition(b',"value":')
            r = json.loads(head + b"}" if sign else line)
            if first <= r["offset"] < end and since <= r["timestamp"] < until:
                # The value's own text, so that numbers keep their digits.
                text = value[:-1].decode() if sign else None
                out.append({**{c: r[c] for c in ("topic", "partition", "offset", "timestamp", "key")}, "value": None if text == "null" else text})
        yield pa.RecordBatch.from_pylist(out, _KINDS)


class Log:
    """The commits of a log, read by the driver."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.since, self.until = int(options.get("startTime", -(2**62))), int(options.get("endTime", 2**62))
        self.seen: dict[str, dict] = {}

    def commits(self) -> list[dict]:
        for n in files.listed(f"{self.root}/{COMMITS}"):
            if n not in self.seen:
                self.seen[n] = json.loads(files.get(f"{self.root}/{COMMITS}/{n}"))
        return [self.seen[n] for n in sorted(self.seen)]

    def end(self) -> dict[str, int]:
        found = self.commits()
        return dict(found[-1]["next"]) if found else {}

    def begin(self) -> dict[str, int]:
        """Each partition's first offset of a record that is not older than the start; only objects in which the start lies are opened."""
        first = dict.fromkeys(self.end(), None)
        for c in self.commits():
            for key, topic, partition, low, high, old, new, *_ in c["objects"]:
                at = f"{topic}/{partition}"
                if new < self.since or (first[at] is not None and first[at] <= low):
                    continue
                if old < self.since:
                    rows = [b.column("offset").to_pylist() for b in records(self.root, ObjectPart([key], low, high + 1, (self.since, 2**62)))]
                    low = min(x for r in rows for x in r)
                first[at] = low if first[at] is None else min(first[at], low)
        end = self.end()
        return {at: end[at] if x is None else x for at, x in first.items()}

    def parts(self, start: dict[str, int], end: dict[str, int]) -> list[ObjectPart]:
        """Objects that hold records between the offsets. Commits before the first that matters are not looked into."""
        out, held, count = [], {}, Counter()

        def dealt(at: str) -> None:
            out.append(ObjectPart(held.pop(at), start.get(at, 0), end[at], (self.since, self.until)))
            count[at] = 0

        for c in reversed(self.commits()):
            if all(c["next"].get(at, 0) <= start.get(at, 0) for at in end):
                break
            for key, topic, partition, low, high, old, new, n, _ in c["objects"]:
                at = f"{topic}/{partition}"
                if low < end.get(at, 0) and high >= start.get(at, 0) and old < self.until and new >= self.since:
                    held.setdefault(at, []).append(key)
                    count[at] += n
                    if count[at] >= TASK:
                        dealt(at)
        for at in list(held):
            dealt(at)
        return out


class Live(DataSourceStreamReader):
    """New records of a log, each once. Where it got is also noted beside the stream's checkpoint (`progress`), for bounded batches to go on from after a restart."""

    def __init__(self, options: dict[str, str]):
        self.log, self.most, self.note = Log(options), int(options.get("maxRecords", 0)), options.get("progress")
        if self.most and not self.note:
            raise ValueError("maxRecords needs a file to note its progress in")
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return self.log.begin()

    def latestOffset(self) -> dict:  # noqa: N802
        end = self.log.end()
        if not self.most:
            return end
        if self.at is None:
            folder, name = self.note.rsplit("/", 1)
            self.at = json.loads(files.get(self.note)) if name in files.listed(folder) else self.log.begin()
        # An equal share of the records to every partition, so that none runs ahead of the others for long.
        behind = {p: end[p] - self.at.get(p, 0) for p in end}
        share = max(1, self.most // max(1, sum(b > 0 for b in behind.values())))
        return {p: self.at.get(p, 0) + min(b, share) for p, b in behind.items()}

    def partitions(self, start: dict, end: dict) -> list[ObjectPart]:
        # Spark has written this end down before it asks, and asks again for a batch that it repeats.
        self.at = dict(end)
        if self.note:
            files.put(self.note, json.dumps(end).encode())
        return self.log.parts(start, end)

    def read(self, partition: ObjectPart) -> Iterator[pa.RecordBatch]:
        return records(self.log.root, partition)


class Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.log = Log(options)

    def partitions(self) -> list[ObjectPart]:
        # Times are looked at record by record, since they need not be in the order of offsets.
        return self.log.parts({}, self.log.end())

    def read(self, partition: ObjectPart) -> Iterator[pa.RecordBatch]:
        return records(self.log.root, partition)


class RawLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Whole:
        return Whole(self.options)

    def streamReader(self, schema) -> Live:  # noqa: N802
        return Live(self.options)

    def streamWriter(self, schema, overwrite: bool) -> Recorder:  # noqa: N802
        return Recorder(self.options["path"].rstrip("/"), int(self.options.get("maxBytes", MAX_BYTES)))


def _known(spark: SparkSession) -> None:
    spark.dataSource.register(RawLog)


def record(stream: DataFrame, root: str, checkpoint: str, most: int = MAX_BYTES) -> DataStreamWriter:
    """Raw records (RAW) to objects of at most `most` bytes of lines; trigger it every MAX_AGE, so that nothing waits longer."""
    _known(stream.sparkSession)
    lines = sinks.raw_lines(stream)
    lines = lines.repartition("topic", "partition", "source", "instrument", *sinks.HOUR[1:], F.expr(f"offset div {STRETCH}"))
    return lines.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LINES.split(", ")]).writeStream.format(NAME).option("path", root).option("maxBytes", most).option("checkpointLocation", checkpoint)


def live(spark: SparkSession, root: str, checkpoint: str | None = None, most: int = 0, since: int | None = None) -> DataFrame:
    """The log as a stream, `most` records a batch (0: all there are), from a time in milliseconds on."""
    _known(spark)
    r = spark.readStream.format(NAME).option("path", root)
    if most:
        r = r.option("maxRecords", most).option("progress", f"{checkpoint}-progress.json")
    return (r if since is None else r.option("startTime", since)).load()


def whole(spark: SparkSession, root: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The log as a table, of records from one time to before another."""
    _known(spark)
    r = spark.read.format(NAME).option("path", root)
    r = r if since is None else r.option("startTime", since)
    return (r if until is None else r.option("endTime", until)).load()
