"""WARC archives, index first: an index row (file, offset, length, URL, digest) per record, then coalesced range reads.

Writing: payloads are digested, the least page_id of equal payloads (SHA-1 and length) of `least_bytes` or more is the
response, others are revisits of it. Each task writes gzip members, one a record, to files of its own in the shared folder and
returns index rows; a repeated or speculative task writes other files, and only rows of the task that Spark commits name files.

Reading: the index rows selected are sorted by file and offset, ranges at most `gap` bytes apart are joined up to
`most` bytes, and each range is one read. Ranges, not files, are the unit of work.

Defined cases: null html is an empty payload; null url is written empty and read back as null; page_id null counts as larger
than any other and is kept as null; rows alike in page_id and payload are decided alike (each a response if its page_id is the least; ids of responses follow from page and payload, for revisits to name
them in WARC-Refers-To, so of rows alike in one task the first gets it and in several tasks one each);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, open_fs

FILE_BYTES = 1 << 28
#: A payload with more than this part of the rows is met without a shuffle.
HOT = 1000
#: Responses of a task that are remembered, so that rows alike do not get one id.
SEEN = 1_000_000
GAP, MOST, TASK_BYTES = 1 << 16, 1 << 22, 1 << 23
INDEX = "file string, offset long, length long, page_id long, url string, digest string"
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def named(page_id: int | None, digest: str) -> uuid.UUID:
    """The id of the response of a page, which its revisits can tell."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: bool, refers_to: int | None, again: bool = False) -> bytes:
    """One gzip member. page_id and the whole payload's length are carried in headers of our own; again: a response like it was written before."""
    name = named(page_id, digest) if first and not again else uuid.uuid4()
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (payload if first else b"")
    # A line break in a URL would end the header.
    safe = "" if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if not first:
        head.insert(6, f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:uuid:{named(refers_to, digest)}>\r\nX-Refers-To-Page: {'' if refers_to is None else refers_to}")
    if url is None:
        head.remove("WARC-Target-URI: ")
    raw = ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=3, mtime=0) as z:
        z.write(raw)
    return out.getvalue()


def parse(member: bytes) -> dict:
    """What `record` wrote; the payload's digest is checked where the payload is there."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(h["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest, first = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "response"
    if first and digest32(payload) != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: payload does not match its digest")
    url = h.get("WARC-Target-URI")
    number = lambda k: int(h[k]) if h.get(k) else None
    return {
        "page_id": number("X-Page-Id"), "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": h["WARC-Type"],
        "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "refers_to": None if first else number("X-Refers-To-Page"), "payload": payload if first else None,
    }


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the archives of pages (page_id, url, html) under folder; the index, not yet run. Write it out once, then use that."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("_body"))
    pages = pages.withColumns({"_sha": F.unhex(F.sha1("_body")), "_len": F.octet_length("_body")})
    # Decided on narrow rows: one for each (page_id, payload), of payloads that occur again only.
    who = pages.where(F.col("_len") >= least_bytes).select("page_id", "_sha", "_len").distinct()
    who = Scratch(pages.sparkSession, "warc-payloads").keep_narrow(who, "who", pages.count())
    least = who.groupBy("_sha", "_len").agg(F.min("page_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1 and _least is not null")
    # A payload with a share of over 1 / HOT of the rows (HOT of them at most, so they may be broadcast) is met without a shuffle; the rest by key.
    rows = who.count()
    hot = F.broadcast(least.where(F.col("_n") * HOT > rows))
    cold = least.where(F.col("_n") * HOT <= rows)
    rest = who.join(hot.select("_sha", "_len"), ["_sha", "_len"], "left_anti")
    told = who.join(hot, ["_sha", "_len"]).unionByName(rest.join(cold, ["_sha", "_len"])).where(~F.col("page_id").eqNullSafe(F.col("_least")))
    told = told.select(F.col("page_id").alias("_p"), F.col("_sha").alias("_s"), F.lit(False).alias("_first"), "_least")
    full = pages.join(told, pages["page_id"].eqNullSafe(told["_p"]) & (pages["_sha"] == told["_s"]), "left")
    full = full.select("page_id", "url", "_body", F.coalesce("_first", F.lit(True)).alias("_first"), "_least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        fs.create_dir(at, recursive=True)
        out, name, pos, seen = None, "", 0, set()
        try:
            for b in batches:
                rows = []
                for p, u, body, first, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "_body", "_first", "_least")), strict=True):
                    if out is None or pos >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, pos = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    d = digest32(body)
                    again = first and (p, d) in seen
                    if first and len(seen) < SEEN:
                        seen.add((p, d))
                    member = record(p, u, body, d, first, refers, again)
                    out.write(member)
                    rows.append((f"{folder}/{name}", pos, len(member), p, u, d))
                    pos += len(member)
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "offset", "length", "page_id", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return full.mapInArrow(run, INDEX)


def ranges(index: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """(file, start, stop, offsets, lengths): selected records' byte ranges, near ones joined, none over `most` unless one record is."""
    # Files are cut into cells of `most` bytes by a record's offset, so what is gathered for a read is bounded.
    cell = index.select("file", "offset", "length", F.floor(F.col("offset") / most).alias("cell")).distinct()
    runs = cell.groupBy("file", "cell").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("r"))
    cut = f"""aggregate(r, cast(array() as array<array<struct<offset:bigint,length:bigint>>>), (a, x) ->
        if(size(a) > 0 and x.offset - (element_at(element_at(a, -1), -1).offset + element_at(element_at(a, -1), -1).length) <= {gap},
           concat(slice(a, 1, size(a) - 1), array(concat(element_at(a, -1), array(x)))), concat(a, array(array(x)))))"""
    # Where everything of a cell is selected (the usual full read) there is nothing to cut.
    whole = F.expr("element_at(r, -1).offset + element_at(r, -1).length - r[0].offset - aggregate(r, 0L, (s, x) -> s + x.length)") <= gap
    runs = runs.select("file", F.explode(F.when(whole, F.array("r")).otherwise(F.expr(cut))).alias("r"))
    return runs.select("file", F.expr("r[0].offset").alias("start"), F.expr("element_at(r, -1).offset + element_at(r, -1).length").alias("stop"), F.expr("r.offset").alias("offsets"), F.expr("r.length").alias("lengths"))


def read(index: DataFrame, payload: bool = False, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The records that the index rows name, one row each, without the payload unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, a, z, offs, lens in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop", "offsets", "lengths")), strict=True):
                fs, at = open_fs(f)
                with fs.open_input_file(at) as src:
                    got = src.read_at(z - a, a)
                rows = [parse(got[o - a : o - a + n]) for o, n in zip(offs, lens, strict=True)]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in kinds.names} for r in rows], kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    # Ranges are short rows that stand for many bytes, so their number of tasks comes from the bytes.
    total = index.agg(F.sum("length")).first()[0] or 0
    return ranges(index, gap, most).repartition(max(1, total // TASK_BYTES)).mapInArrow(run, ddl)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, keep the index there, read all back through it."""
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.keep(write(pages, f"{scratch.root}/archives", least_bytes), "index")
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
