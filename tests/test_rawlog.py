"""The raw log: objects that follow from their records, commits, and what a reader gets over restarts."""

import gzip
import json
import os
import random

from tickloom import schemas
from tickloom.sources import rawlog, readers

HOUR = 3_600_000


def records(spark, n=600, seed=3):
    """Three partitions, a few sources and hours, some values that are no JSON, some null."""
    r, rows = random.Random(seed), []
    at = [0, 0, 0]
    for i in range(n):
        p = i % 3
        value = r.choice([b'{"source":"s1","instrument":{"symbol":"A-B"},"n":1.50}', b'{"source":"s2","instrument":{"symbol":"C"}}', b"\xff", None])
        rows.append(("events.trade", p, at[p], 1_704_067_200_000 + i * 60_000 + r.randint(0, 9), f"k{i}" if i % 4 else None, value))
        at[p] += 1
    return rows, spark.createDataFrame(rows, schemas.RAW)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if not f.startswith(".")}


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_a_repeated_batch_leaves_the_same_objects(spark, tmp_path):
    at = str(tmp_path)
    rows, df = records(spark)
    df.repartition(4).write.parquet(f"{at}/in")
    make = lambda: rawlog.record(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/log", f"{at}/state", most=2000)
    run(make())
    once = tree(f"{at}/log")
    lines = [json.loads(x) for k, v in once.items() if k.endswith(".gz") for x in gzip.decompress(v).splitlines()]
    assert sorted((x["partition"], x["offset"]) for x in lines) == sorted((r[1], r[2]) for r in rows)
    assert all(len(gzip.decompress(v)) <= 2000 for k, v in once.items() if k.endswith(".gz")) and sum("/s1/" in k for k in once) > 3
    key = sorted(k for k in once if "/s1/A-B/" in k)[0]
    assert key.startswith("events.trade/s1/A-B/2024/01/01/00/p0-") and key.endswith(".jsonl.gz")
    # As if the batch was killed after its objects were there, and once more after its commit: Spark takes it up again.
    for gone in (f"{at}/state/commits/0", f"{at}/log/_commits/{0:020d}.json"):
        assert os.path.exists(gone)
        for f in (gone, f"{at}/state/commits/0"):
            if os.path.exists(f):
                os.remove(f)
            crc = f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc"
            if os.path.exists(crc):
                os.remove(crc)
        run(make())
        assert tree(f"{at}/log") == once


def test_what_no_commit_names_is_not_read(spark, tmp_path):
    at = str(tmp_path)
    rows, df = records(spark, 60)
    df.write.parquet(f"{at}/in")
    run(rawlog.record(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/log", f"{at}/state"))
    w = rawlog.Recorder(f"{at}/log", 1000)
    from pyspark.sql import Row

    later = [Row(topic="events.trade", partition=0, offset=900 + k, timestamp=0, line='{"topic":"events.trade","partition":0,"offset":%d,"timestamp":0,"key":null,"value":{}}' % (900 + k), source="s", instrument="i", year=1970, month="01", day="01", hour="00") for k in range(5)]
    message = w.write(iter(later))
    assert rawlog.whole(spark, f"{at}/log").count() == 60
    w.commit([message, None], 1)
    got = rawlog.whole(spark, f"{at}/log")
    assert got.count() == 65 and {r.value for r in got.where("offset >= 900").collect()} == {"{}"}


def test_values_come_back_as_they_were(spark, tmp_path):
    at = str(tmp_path)
    rows, df = records(spark)
    df.repartition(3).write.parquet(f"{at}/in")
    run(rawlog.record(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/log", f"{at}/state"))
    want = sorted((r[0], r[1], r[2], r[3], r[4], r[5].decode() if r[5] and r[5] != b"\xff" else None) for r in rows)
    assert sorted(map(tuple, rawlog.whole(spark, f"{at}/log").collect())) == want
    a, z = rows[100][3], rows[300][3]
    assert sorted(map(tuple, rawlog.whole(spark, f"{at}/log", a, z).collect())) == [x for x in want if a <= x[3] < z]


def test_a_live_stream_gets_each_record_once(spark, tmp_path):
    """In bounded batches, over restarts, while the log grows; one that seeks a time begins there in each partition."""
    at = str(tmp_path)
    rows, df = records(spark)
    since, seen = rows[200][3], []
    for k in range(3):
        df.where(f"offset div 70 = {k}").write.mode("append").parquet(f"{at}/in")
        run(rawlog.record(spark.readStream.schema(df.schema).parquet(f"{at}/in"), f"{at}/log", f"{at}/state"))
        for name, more in (("all", {"most": 90}), ("late", {"since": since})):
            for _ in range(3 if name == "all" else 1):
                s = rawlog.live(spark, f"{at}/log", f"{at}/{name}", **more)
                run(s.writeStream.format("parquet").option("path", f"{at}/out-{name}").option("checkpointLocation", f"{at}/{name}"))
                if name == "all":
                    seen.append(spark.read.schema(rawlog.SCHEMA).parquet(f"{at}/out-{name}").count())
    steps = [b - a for a, b in zip([0, *seen], seen, strict=False)]
    assert max(steps) <= 90 and seen[-1] == 600
    got = spark.read.schema(rawlog.SCHEMA).parquet(f"{at}/out-all")
    assert sorted((r.partition, r.offset) for r in got.collect()) == sorted((r[1], r[2]) for r in rows)
    late = spark.read.schema(rawlog.SCHEMA).parquet(f"{at}/out-late").collect()
    first = {p: min(r[2] for r in rows if r[1] == p and r[3] >= since) for p in range(3)}
    assert sorted((r.partition, r.offset) for r in late) == sorted((r[1], r[2]) for r in rows if r[2] >= first[r[1]] and r[3] >= since)


def test_ticks_of_records(spark):
    rows = [("t", 1, 0, 0, None, '{"instrument":{"symbol":"A"},"event_id":7,"event_us":5000000,"price":"1.5","size":"2","side":"BUY"}'), ("t", 1, 1, 0, None, '{"source":"x"}'), ("t", 1, 2, 0, None, None), ("t", 0, 3, 0, None, '{"instrument":{"symbol":"A"},"event_id":-1,"seq":9}')]
    got = readers.ticks(spark.createDataFrame(rows, rawlog.SCHEMA)).orderBy("seq").collect()
    assert [(r.instrument, r.event_id, r.event_time is None, r.partition, r.seq) for r in got] == [("A", -1, True, 0, 9), ("A", 7, False, 1, 5_000_000)]
