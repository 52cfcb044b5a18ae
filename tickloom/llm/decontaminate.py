"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Words are lower-cased (A-Z) and split at blanks. A document and a benchmark item meet when they share a SEED-word
shingle. Then, from the longest matches down, non-overlapping common runs of SEED words or more are marked in both (ties: first in the item, then in the
document), so passages in another order are found too. An item's coverage is the share of its words marked; a
document with coverage >= MIN_COVERAGE of any item is contaminated. Items of fewer than SEED words say too little to condemn a document:
those it holds as a whole run are told apart (n_short).

While the benchmark has at most BROADCAST_WORDS words in BROADCAST_BYTES bytes, measured first, it goes to all workers and
documents are read once. Beyond, seeds are joined by shuffle, salted by document; pairs whose shared seeds can't make up the coverage are dropped, and
each document left meets its items once. Both give the same rows.

Defined cases: null or blank documents and items match nothing; repeated documents are each returned; items alike in id and text
are one item; repeated item ids with other texts are items of their own; the first by coverage, then id (null last), is named; empty tables give every document as clean or no rows;
only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import fresh, lower_words, mix64, shingle_hashes, signed, text_key, word_count, word_hashes

SEED = 5
MIN_COVERAGE = 0.5
BROADCAST_WORDS, BROADCAST_BYTES = 2_000_000, 1 << 25
#: Ways over which the documents of a seed are dealt.
SALTS = 16
#: Meetings of windows, by the words of both texts, from which on they are not listed.
MEETINGS = 8
#: Fixed value: an odd multiplier for sums of word hashes, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def _place(s: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, x in enumerate(s.tolist()):
        out.setdefault(x, []).append(i)
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of the marked runs. Both are lists of word hashes.

    Where windows of `least` words meet few others, their runs are listed. Where words repeat, so that meetings are a product, lengths are run through
    with Karp-Rabin sums instead. Both mark the same runs.
    """
    least = max(1, min(least, len(item)))
    if len(item) < least or len(doc) < least:
        return []
    own, far = shingle_hashes(item, least), shingle_hashes(doc, least)
    where = _place(own)
    hits = np.flatnonzero(np.isin(far, own))
    if sum(len(where[x]) for x in far[hits].tolist()) > MEETINGS * (len(own) + len(far)):
        return _by_length(item, doc, least)
    return _by_runs(len(item), len(doc), where, far, hits, least)


def _by_runs(n_item: int, n_doc: int, where: dict[int, list[int]], far: np.ndarray, hits: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs of equal words are found through the hashes of least-word windows. A run is taken longest first; when a part of it has been
    marked meanwhile, what is left unmarked goes back among the shorter runs, as a pass with a smaller length would find it.
    """
    heap: dict[int, list[tuple[int, int]]] = {}

    def put(i: int, j: int, n: int) -> None:
        if n >= least:
            heap.setdefault(n, []).append((i, j))

    open_runs: dict[int, tuple[int, int]] = {}  # diagonal -> (start in item, end in item)
    for j in hits.tolist():
        for i in where[int(far[j])]:
            d = j - i
            run = open_runs.get(d)
            if run and run[1] == i + least - 1:
                open_runs[d] = (run[0], i + least)
            else:
                if run:
                    put(run[0], run[0] + d, run[1] - run[0])
                open_runs[d] = (i, i + least)
    for d, (a, b) in open_runs.items():
        put(a, a + d, b - a)
    in_item, in_doc, out = np.zeros(n_item, bool), np.zeros(n_doc, bool), []
    while heap and not in_item.all():
        n = max(heap)
        for i, j in sorted(heap.pop(n)):
            taken = in_item[i : i + n] | in_doc[j : j + n]
            if not taken.any():
                in_item[i : i + n] = in_doc[j : j + n] = True
                out.append((i, j, n))
                continue
            free = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
            for a, b in zip(free[::2], free[1::2], strict=True):
                put(i + int(a), j + int(a), int(b - a))
    return out


def _by_length(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The longest length at which windows without a mark are equal is sought by halving, and all its runs are marked, until none of `least` is left.

    A length costs a sort of both texts' windows; what is marked of m words has less than sqrt(2 m) lengths.
    """
    sums = []
    with np.errstate(over="ignore"):
        for x in (item, doc):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(x), b)]) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
            sums.append((np.r_[np.uint64(0), np.cumsum(x * up[:-1])], down))
    free, out, most = [np.ones(len(item), bool), np.ones(len(doc), bool)], [], min(len(item), len(doc))

    def windows(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the windows of n words that hold no mark."""
        held = np.cumsum(np.r_[0, ~free[k]])
        at = np.flatnonzero(held[n:] == held[:-n])
        with np.errstate(over="ignore"):
            return at, mix64((sums[k][0][at + n] - sums[k][0][at]) * sums[k][1][at])

    while most >= least:
        low, high = least - 1, most  # a common run of `low` is known to be there, one of more than `high` is not
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(windows(0, n)[1], windows(1, n)[1]).any() else (low, n - 1)
        if low < least:
            break
        (own, x), (far, y) = windows(0, low), windows(1, low)
        order = np.lexsort((far, y))
        far, y = far[order], y[order]
        first = dict.fromkeys(x.tolist(), -1)
        for i, h in zip(own.tolist(), x.tolist(), strict=True):
            if not free[0][i] or not free[0][i + low - 1]:
                continue
            k = first[h] if first[h] >= 0 else int(np.searchsorted(y, h))
            # Windows that have met a mark never lose it, so they are passed once.
            while k < len(y) and int(y[k]) == h and not (free[1][far[k]] and free[1][far[k] + low - 1]):
                k += 1
            first[h] = k
            if k < len(y) and int(y[k]) == h and np.array_equal(item[i : i + low], doc[far[k] : far[k] + low]):
                j = int(far[k])
                free[0][i : i + low] = free[1][j : j + low] = False
                out.append((i, j, low))
        most = low - 1
    return out


class Benchmark:
    """Items ready for tiling, found through their shingles."""

    def __init__(self, rows: list[tuple[object, str]], least: int):
        self.least = least
        self.items = [(i, word_hashes(lower_words(t))) for i, t in rows]
        self.items = [(i, w) for i, w in self.items if len(w)]
        seeds: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for n, (_, w) in enumerate(self.items):
            k = min(least, len(w))
            to = seeds if k == least else short.setdefault(k, {})
            for x in shingle_hashes(w, k).tolist():
                to.setdefault(x, set()).add(n)
        self.by_len = {least: seeds, **short}
        self.known = {k: np.array(sorted(v), np.uint64) for k, v in self.by_len.items() if v}

    def look(self, text: str | None, coverage: float) -> tuple[list[tuple[float, object]], int]:
        """(coverage, item) of the items covered enough, most first, and how many shorter ones are held whole."""
        w = word_hashes(lower_words(text))
        met: set[int] = set()
        for k, known in self.known.items():
            s = shingle_hashes(w, k)
            if len(s):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                for x in np.unique(s[known[at] == s]).tolist():
                    met |= self.by_len[k][x]
        out, short = [], 0
        for n in met:
            item, words = self.items[n]
            if len(words) < self.least:
                short += 1
            elif (c := sum(t[2] for t in tiles(words, w, self.least)) / len(words)) >= coverage:
                out.append((c, item))
        return sorted(out, key=_first), short


_INDEX: dict[str, Benchmark] = {}


def _indexed(name: str, rows: list[tuple[object, str]], least: int) -> Benchmark:
    """The index of a worker's last benchmark, made once and not for each task."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Benchmark(rows, least)
    return _INDEX[name]


def _first(x: tuple[float, object]) -> tuple:
    return -x[0], x[1] is None, x[1] or 0


OUT = "max_coverage double, item_id long, n_items long, items array<long>, n_short long"
NAMES = ["max_coverage", "item_id", "n_items", "items", "n_short"]


def _columns(found: list[tuple[list[tuple[float, object]], int]]) -> list[pa.Array]:
    return [
        pa.array([f[0][0] if f else 0.0 for f, _ in found], pa.float64()),
        pa.array([f[0][1] if f else None for f, _ in found], pa.int64()),
        pa.array([len(f) for f, _ in found], pa.int64()),
        pa.array([[x for _, x in f] for f, _ in found], pa.list_(pa.int64())),
        pa.array([n for _, n in found], pa.int64()),
    ]


def _by_broadcast(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    rows = sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # at most BROADCAST_BYTES
    shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _indexed(name, shared.value, least)
        for b in batches:
            found = [bench.look(t, coverage) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *_columns(found)], [*b.schema.names, *NAMES])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(OUT).fields]))


def _by_shuffle(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    sizes_row = items.select(F.least(F.col("n"), F.lit(least)).alias("k")).distinct().collect()  # at most `least` numbers
    sizes = sorted(r[0] for r in sizes_row)

    def seeds(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        got, times = np.unique(shingle_hashes(w, k), return_counts=True)
        with np.errstate(over="ignore"):
            return signed(mix64(got + np.uint64(k))), times

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, row = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r, t in enumerate(b.column("text").to_pylist()):
                w = word_hashes(lower_words(t))
                for k in sizes:
                    got, _ = seeds(w, k)
                    seed.append(got)
                    row.append(np.full(len(got), r))
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed)), b.column("doc_id").take(at), b.column("_h").take(at)], ["seed", "doc_id", "_h"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed, row, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r, t in enumerate(b.column("text").to_pylist()):
                w = word_hashes(lower_words(t))
                got, n = seeds(w, min(least, len(w)))
                seed.append(got)
                row.append(np.full(len(got), r))
                times.append(n)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed)), *(b.column(c).take(at) for c in ("item_id", "_ih", "n")), pa.array(np.concatenate(times))], ["seed", "item_id", "_ih", "n", "times"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, near in zip(b.column("text").to_pylist(), b.column("near").to_pylist(), strict=True):
                w, out, short = word_hashes(lower_words(text)), [], 0
                for x in near:
                    own = word_hashes(lower_words(x["item"]))
                    if len(own) < least:
                        short += 1
                    elif (c := sum(t[2] for t in tiles(own, w, least)) / len(own)) >= coverage:
                        out.append((c, x["item_id"]))
                found.append((sorted(out, key=_first), short))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_h"), *_columns(found)], ["doc_id", "_h", *NAMES])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_h")).where("text is not null")
    own = d.mapInArrow(of_docs, "seed long, doc_id long, _h long").withColumn("salt", F.pmod(F.col("_h"), F.lit(SALTS)))
    far = items.select("item_id", "text", "_ih", "n").mapInArrow(of_items, "seed long, item_id long, _ih long, n long, times long").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # A run of L >= least words holds L - least + 1 >= L / least of the item's seeds, so fewer can't make up the coverage.
    pairs = own.distinct().join(far, ["seed", "salt"]).groupBy("doc_id", "_h", "item_id", "_ih", "n").agg(F.sum("times").alias("got"))
    pairs = pairs.where((F.col("n") < least) | (F.col("got") * least >= F.col("n") * coverage - 1e-9)).select("doc_id", "_h", "item_id", "_ih")
    i = items.select(F.col("item_id").alias("_i"), F.col("_ih").alias("_g"), F.col("text").alias("item"))
    met = pairs.join(i, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("_ih") == F.col("_g")))
    met = met.groupBy("doc_id", "_h").agg(F.collect_list(F.struct("item_id", "item")).alias("near")).withColumnsRenamed({"doc_id": "_d", "_h": "_g"})
    one = d.dropDuplicates(["doc_id", "_h"]).join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")))
    best = one.select("doc_id", "_h", "text", "near").mapInArrow(measure, f"doc_id long, _h long, {OUT}")
    i, h, *names = fresh(docs.columns, "_i", "_h", *(f"_{c}" for c in NAMES))
    best = best.toDF(i, h, *names)
    out = docs.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (text_key() == F.col(h)), "left")
    none = {"max_coverage": F.lit(0.0), "n_items": F.lit(0).cast("long"), "items": F.expr("cast(array() as array<long>)"), "n_short": F.lit(0).cast("long")}
    return out.select(*docs.columns, *[(F.coalesce(F.col(x), none[c]) if c in none else F.col(x)).alias(c) for c, x in zip(NAMES, names, strict=True)])


def covered(docs: DataFrame, benchmark: DataFrame, least: int = SEED, coverage: float = MIN_COVERAGE, broadcast_words: int = BROADCAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with max_coverage, item_id (the item most covered), n_items, items (those covered enough, most first) and n_short."""
    clash = [c for c in docs.columns if c.lower() in NAMES]
    if clash:
        raise ValueError(f"documents already have {clash}")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    items = items.dropDuplicates(["item_id", "text"]).withColumns({"_ih": text_key(), "n": word_count(F.col("text"))})
    words, octets = items.agg(F.sum("n"), F.sum(F.octet_length("text"))).first()
    small = (words or 0) <= broadcast_words and (octets or 0) <= broadcast_bytes
    return _by_broadcast(docs, items.select("item_id", "text"), least, coverage) if small else _by_shuffle(docs, items, least, coverage)


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, contaminated, max_coverage, item_id, n_items, items and n_short of each document."""
    return covered(docs.select("doc_id", "text"), benchmark, **how).select("doc_id", (F.col("n_items") > 0).alias("contaminated"), *NAMES)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that cover no item enough, columns as they were (columns of the same names as NAMES included)."""
    own = docs.toDF(*[f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)])
    kept = covered(own, benchmark, **how).where("n_items = 0").drop(*NAMES)
    return kept.toDF(*docs.columns)
