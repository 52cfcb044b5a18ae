"""N-gram Jaccard join by vertical partitioning, with its links' connected components.

A document's set holds its distinct k-word shingles (64-bit hashes); sets alike in all are one class, named by a 128-bit
hash of the set. Global order: a bounded count sketch of 2^CELL_BITS cells ranks the cells, rare ones first; a shingle's key
is its cell's rank, then its other bits, so keys are one-to-one with hashes and sort in the global order. Fragments are
ranges of this order between pivots of about equal mass.

Candidates share a key among the first n - ceil(t n) + 1 of both sets, at places and lengths that allow the threshold
(prefix, position and length filters). One shuffle deals narrow rows (key, 64-bit class id, size and place) by key; sorted,
they stream by, at most HOT of a key held. Where at most HOT classes share a key, pairs are listed and those whose 512-bit
parity sketches differ in more bits than the two sets may differ in elements are dropped (that many elements do differ).
Such a sketch tells nothing of sets much larger than it, and long texts share a rare-looking key by chance in pairs that grow with the square of their number.
So sets of over 512 shingles have a second sketch, of a bit a shingle or more, and pairs of two such sets are held against these before any words are sent.
What is left is counted by fragments: the sets of pairs that are left are cut at the pivots, a pair's parts meet fragment by fragment, dealt by (fragment, set), and the
partial overlaps are summed per pair. So the two sets of a pair need not meet in one task, and a set of many pairs is dealt over the fragments.
Where more classes share a key, no pairs are listed. Such a key's classes are dealt over WAYS ways; each is verified against the first and the last
class of its way, and these against the first and last of the key: pairs in proportion to rows, which join copies of one text into one component. Keys
whose classes hang together by then are done, for only components are asked for. Classes that hang together by the keys left form clusters, whose classes
meet by their full sketches first, in bounded blocks; only those that may link to one of another component stay, and form smaller clusters by that. One that fits
a block is met whole on sets; in others the classes not yet in the cluster's largest component are met with all (those in it need not meet each other), in blocks bounded in
classes and shingles; two blocks of one or of neighbouring length bands meet in a task, which counts overlaps fragment by fragment and returns a spanning forest of
the links: at most one row a class. Sets travel as compressed words, made with the sets in the one pass over texts, and are hashed again where they meet. No link's
components are lost, whatever the size of a group; pairs of different texts that share a busy key and do not link are the part whose work is a product.

Defined cases: null, empty or blank texts have an empty set and link with nothing; fewer words than k make the whole
sequence one shingle; equal sets link; repeated rows are each returned; rows of a null doc_id neither name a component
nor link others, and get that of the rows with an equal set, else null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from weakref import finalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, lower_words, mix64, open_fs, shingle_hashes, signed, text_key, word_hashes
from tickloom.llm.components import components

#: Cells of the count sketch. A cell's count varies by the root of its mean, and only keys that are more frequent than that are told from rare ones.
#: A key of over HOT classes taken for a rare one makes clusters of texts that do not link, whose work is a product; with so many cells 6 GB of text still have a mean of about 300.
CELL_BITS = 22
FRAGMENTS = 8
HOT = 48
BLOCK_SETS, BLOCK_SHINGLES = 1024, 800_000
#: The same for blocks of full sketches, which take a bit or two a shingle: 4 MB.
SKETCH_SETS, SKETCH_SHINGLES = 2048, 16_000_000
#: Ways over which the rows of a key known to be busy are dealt.
WAYS = 64
#: Rows in which the sketch travels, and parts by which the tasks' sketches are added up first.
SKETCH_ROWS, SKETCH_PARTS = 256, 4
WORDS64 = 8
#: A fragment's columns counted at once.
COLUMNS = 4096
#: Bytes of fragments handed on at once.
PART_BYTES = 1 << 22


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's set."""
    return _set_of(lower_words(text), k)


def _set_of(words: list[bytes], k: int) -> np.ndarray:
    h = word_hashes(words)
    if 0 < len(h) < k:
        return shingle_hashes(h, len(h))
    return np.unique(shingle_hashes(h, k))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """For each row its doc_id, text hash, set size, class, parity sketch, full sketch (null: no larger) and packed words; and for each task its part of the count sketch (n = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names = np.zeros(1 << CELL_BITS, np.uint32), ["doc_id", "h", "n", "sig", "par", "fine", "words"]
        for b in batches:
            n, sig, par, fine, packed = [], [], [], [], []
            for t in b.column("text").to_pylist():
                words = lower_words(t)
                s = _set_of(words, k)
                packed.append(zlib.compress(b" ".join(words), 1) if words else None)
                np.add.at(cells, _cell(s), 1)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                par.append(_parity(s).tobytes() if len(s) else None)
                fine.append(_parity(s, _bits(len(s))).tobytes() if len(s) > 64 * WORDS64 else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(par, pa.binary()), pa.array(fine, pa.binary()), pa.array(packed, pa.binary())], names)
        parts = np.split(cells, SKETCH_ROWS)
        some = [i for i, p in enumerate(parts) if p.any()]
        ids = pa.array(some, pa.int64())
        none = pa.array([-1] * len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, none, none, pa.array([_pack(parts[i]) for i in some], pa.binary()), *[pa.nulls(len(some), pa.binary())] * 3], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("h")).mapInArrow(run, "doc_id long, h long, n long, sig binary, par binary, fine binary, words binary")


def _pack(cells: np.ndarray) -> bytes:
    """A row of the sketch: most counts are small, so it packs well."""
    return pa.compress(cells.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpack_cells(row: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(row, (4 << CELL_BITS) // SKETCH_ROWS, codec="zstd", asbytes=True), np.uint32)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of rows of the sketch; a count beyond 32 bits stays there, last in the order."""
    total = np.zeros((1 << CELL_BITS) // SKETCH_ROWS, np.uint64)
    for x in pdf["sig"]:
        total += _unpack_cells(x)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "sig": [_pack(np.minimum(total, np.uint64(0xFFFFFFFF)))]})


class _Order:
    """Rank of each cell, rare first, and the fragments' pivots: tasks read them from the shared folder, the driver holds neither."""

    def __init__(self, files: list[str]):
        self.files = tuple(files)

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter(_read_order(self.files))


@lru_cache(maxsize=1)
def _read_order(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    size, rank, pivots = (1 << CELL_BITS) // SKETCH_ROWS, np.arange(1 << CELL_BITS, dtype=np.uint32), np.empty(0, np.uint64)
    for f in files:
        fs, at = open_fs(f)
        with pq.ParquetFile(at, filesystem=fs) as file:
            for b in file.iter_batches(SKETCH_ROWS // 8):
                for part, x in zip(b.column("part").to_pylist(), b.column("sig"), strict=True):
                    if part < 0:
                        pivots = np.frombuffer(x.as_py(), np.uint64)
                    else:
                        rank[part * size : (part + 1) * size] = np.frombuffer(x.as_buffer(), np.uint32)
    return rank, pivots


def _order(parts: DataFrame) -> _Order:
    """The order of the cells, ranked by one task: the sketch has a fixed size. It is deleted once nothing here holds it."""
    # Two steps, so that no task adds up more than a few of the tasks' sketches.
    spread = parts.select(F.col("doc_id").alias("part"), "sig", (F.abs(F.xxhash64("sig")) % SKETCH_PARTS).alias("salt"))
    once = spread.groupBy("part", "salt").applyInPandas(_add, "part long, sig binary")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << CELL_BITS) // SKETCH_ROWS
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("sig").to_pylist(), strict=True):
                counts[part * size : (part + 1) * size] = _unpack_cells(x)
        rank, pivots = _ranked(counts)
        for lo in range(0, SKETCH_ROWS, SKETCH_ROWS // 8):
            own = range(lo, lo + SKETCH_ROWS // 8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([rank[i * size : (i + 1) * size].tobytes() for i in own], pa.binary())], ["part", "sig"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([pivots.tobytes()], pa.binary())], ["part", "sig"])

    scratch = Scratch(parts.sparkSession, "ngram-order")
    total = once.groupBy("part").applyInPandas(_add, "part long, sig binary").coalesce(1)
    scratch.keep(total.mapInArrow(ranked, "part long, sig binary"), "order")
    order = _Order(scratch.files("order"))
    finalize(order, scratch.close)
    return order


def _ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each cell by its count, and the pivots."""
    by = np.argsort(counts, kind="stable")
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    mass = np.cumsum(counts[by], dtype=np.float64)
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)
    return rank, np.unique(cuts).astype(np.uint64) << np.uint64(64 - CELL_BITS)


def _keys(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << (64 - CELL_BITS)) - 1)
    return np.sort((rank[_cell(s)].astype(np.uint64) << np.uint64(64 - CELL_BITS)) | (s & low))


def _bits(n: int) -> int:
    """Bits of a full sketch: a power of two, one a shingle at least."""
    return max(64 * WORDS64, 1 << (n - 1).bit_length())


def _parity(s: np.ndarray, size: int = 64 * WORDS64) -> np.ndarray:
    """The parity of how many shingles fall to each of size bits, a power of two."""
    at = mix64(s + np.uint64(0x9E3779B97F4A7C15))
    bits = np.bincount((at >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _fold(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of fewer bits that the same set has: neighbouring bits fall together."""
    x = np.frombuffer(sketch, np.uint8)
    while 8 * len(x) > size:
        bits = np.unpackbits(x)
        x = np.packbits(bits[::2] ^ bits[1::2])
    return x.view(np.uint64)


def _id(sig: str) -> Column:
    """The class id that candidates carry: the first half of the class's hash.

    Classes that share an id are all looked up by it; only a link between those very classes would not be proposed.
    """
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")


def _prefixes(rows: DataFrame, k: int, num: int, den: int, hot: int, order) -> DataFrame:
    """Rows (tok, way, id, np) of the prefixes, np holding set size and place.

    A key that more than hot classes of one batch share is busy for certain: its rows are dealt over WAYS ways, and one row
    (id = least, np = -1) tells way 0, where all others go. So way 0 gets at most hot + 1 rows of a key from a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, _ = order
        seen: set[bytes] = set()
        for b in batches:
            tok, ids, np_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for g, words in zip(b.column("sig").to_pylist(), b.column("words").to_pylist(), strict=True):
                if g in seen:  # only to spare rows; the rest are made distinct later
                    continue
                if len(seen) < 200_000:
                    seen.add(g)
                s = _set_of(zlib.decompress(words).split(), k)
                m = len(s)
                p = m - -(-num * m // den) + 1
                keys = _keys(s, rank)[:p]
                tok.append(signed(keys))
                ids.append(np.full(p, int.from_bytes(g[:8], "big", signed=True), np.int64))
                np_.append((np.int64(m) << np.int64(32)) | np.arange(p, dtype=np.int64))
            tok, ids, np_ = np.concatenate(tok), np.concatenate(ids), np.concatenate(np_)
            own, at, times = np.unique(tok, return_inverse=True, return_counts=True)
            way = np.where(times[at] > hot, 1 + ids % WAYS, 0)
            busy = own[times > hot]
            tok, way = np.concatenate([tok, busy]), np.concatenate([way, np.zeros(len(busy), np.int64)])
            ids, np_ = np.concatenate([ids, np.full(len(busy), np.iinfo(np.int64).min)]), np.concatenate([np_, np.full(len(busy), -1)])
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(way.astype(np.int32)), pa.array(ids), pa.array(np_)], ["tok", "way", "id", "np"])

    return rows.select("sig", "words").mapInArrow(run, "tok long, way int, id long, np long")


def _candidates(pre: DataFrame, num: int, den: int, hot: int) -> DataFrame:
    """Rows (tok, a, b, na, nb): pairs of the keys that at most hot classes share (tok null), and (tok, a, null, na, null) of the others.

    Sorted rows stream by; of a key no more than hot rows are held.
    """

    def pairs(tok, ids, n, pos) -> list[np.ndarray]:
        out = [[], [], [], []]
        for d in range(1, hot):
            i = np.flatnonzero(tok[d:] == tok[:-d])
            if not len(i):
                break
            j = i + d
            lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            # Up to the first shared key nothing overlaps, so at most the rest of the shorter tail does.
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            ok = (ids[i] != ids[j]) & (lo * den >= hi * num) & (most * (num + den) >= num * (lo + hi))
            i, j = i[ok], j[ok]
            first = np.where(ids[i] < ids[j], i, j)
            last = i + j - first
            for to, x in zip(out, (ids[first], ids[last], n[first], n[last]), strict=True):
                to.append(x)
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tok", "a", "b", "na", "nb"]
        held = [np.empty(0, np.int64)] * 4  # the last key's rows so far
        busy_tok = None  # the last key, if known to be busy

        def cut(rows: list[np.ndarray], end: bool):
            nonlocal held, busy_tok
            tok, way, ids, np_ = rows
            if not len(tok):
                return
            same = np.zeros(len(tok), bool)
            same[1:] = (tok[1:] == tok[:-1]) & (ids[1:] == ids[:-1]) & (np_[1:] == np_[:-1]) & (way[1:] == way[:-1])
            tok, way, ids, np_ = (x[~same] for x in (tok, way, ids, np_))
            start = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1])])
            size = np.diff(np.r_[start, len(tok)])
            group = np.repeat(np.arange(len(start)), size)
            mark = np.maximum.reduceat((way > 0) | (np_ < 0), start) | (size > hot)
            if busy_tok is not None and tok[0] == busy_tok:
                mark[0] = True
            busy = mark[group]
            open_ = np.zeros(len(tok), bool)
            if not end and not mark[-1]:
                open_[start[-1] :] = True
            held = [x[open_] for x in (tok, way, ids, np_)]
            busy_tok = tok[-1] if mark[-1] else None
            n, pos = np_ >> np.int64(32), np_ & np.int64(0xFFFFFFFF)
            row = busy & (np_ >= 0)
            c = int(row.sum())
            yield pa.RecordBatch.from_arrays([pa.array(tok[row]), pa.array(ids[row]), pa.nulls(c, pa.int64()), pa.array(n[row]), pa.nulls(c, pa.int64())], names)
            cold = ~busy & ~open_
            a, b, na, nb = pairs(tok[cold], ids[cold], n[cold], pos[cold])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), *map(pa.array, (a, b, na, nb))], names)

        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tok", "way", "id", "np")]
            yield from cut([np.concatenate([h, x]) for h, x in zip(held, new, strict=True)], False)
        yield from cut(held, True)

    dealt = pre.repartition("tok", "way").sortWithinPartitions("tok", "way", "id", "np")
    return dealt.mapInArrow(run, "tok long, a long, b long, na long, nb long")


def _unpack(words: bytes, k: int, rank: np.ndarray) -> np.ndarray:
    """The sorted keys of a set from its packed words."""
    return _keys(_set_of(zlib.decompress(words).split(), k), rank)


def _fine_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb) without those of two large sets that differ in more bits of their full sketches than they may in elements. Only sketches are sent."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q, n, m in zip(*(b.column(c).to_pylist() for c in ("x", "y", "na", "nb")), strict=True):
                size = 8 * min(len(p), len(q))
                unlike = int(np.bitwise_count(_fold(p, size) ^ _fold(q, size)).sum())
                ok.append(unlike * (num + den) <= (den - num) * (n + m))
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    large = F.least("na", "nb") > 64 * WORDS64
    side = lambda c, x: sets.select(F.col("sig").alias(c), F.col("fine").alias(x))
    met = pairs.where(large).join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    return pairs.where(~large).unionByName(met.mapInArrow(keep, "a binary, b binary, na long, nb long"))


def _fragments(sets: DataFrame, order, k: int) -> DataFrame:
    """(sig, frag, part): each set cut by the pivots of the global order, a row for each fragment in which it has shingles; part holds these, sorted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, pivots = order
        for b in batches:
            sig, frag, part, size = [], [], [], 0
            for g, words in zip(b.column("sig").to_pylist(), b.column("words").to_pylist(), strict=True):
                s = _unpack(words, k, rank)
                at = np.r_[0, np.searchsorted(s, pivots), len(s)]
                for f in np.flatnonzero(np.diff(at)):
                    sig.append(g)
                    frag.append(int(f))
                    part.append(s[at[f] : at[f + 1]].tobytes())
                size += s.nbytes
                if size >= PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(frag, pa.int32()), pa.array(part, pa.binary())], ["sig", "frag", "part"])
                    sig, frag, part, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(frag, pa.int32()), pa.array(part, pa.binary())], ["sig", "frag", "part"])

    return sets.select("sig", "words").mapInArrow(cut, "sig binary, frag int, part binary")


def _count_pairs(pairs: DataFrame, fragments: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that link: a pair meets in each fragment by itself, dealt by fragment and set, and its partial overlaps are summed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, q in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                got.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(got, pa.int64())], ["a", "b", "na", "nb", "got"])

    met = pairs.join(fragments.select(F.col("sig").alias("a"), "frag", F.col("part").alias("x")), "a").join(fragments.select(F.col("sig").alias("b"), "frag", F.col("part").alias("y")), ["frag", "b"])
    part = met.select("a", "b", "na", "nb", "x", "y").mapInArrow(partial, "a binary, b binary, na long, nb long, got long")
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("got").alias("got"))
    return total.where(F.col("got") * den >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("got"))).select("a", "b")


def _forest(pdf: pd.DataFrame, k: int, num: int, den: int, rank: np.ndarray, pivots: np.ndarray) -> pd.DataFrame:
    """Links among the sets of two blocks: a spanning forest of them, overlaps counted fragment by fragment."""
    pdf = pdf.drop_duplicates("sig").sort_values("sig")
    sets = [_unpack(x, k, rank) for x in pdf["words"]]
    n = np.array([len(s) for s in sets], np.float64)
    who = np.repeat(np.arange(len(sets)), n.astype(int))
    keys = np.concatenate(sets)
    got = np.zeros((len(sets), len(sets)), np.float32)
    frag = np.searchsorted(pivots, keys, side="right")
    for f in np.unique(frag):
        at = frag == f
        own, col, times = np.unique(keys[at], return_inverse=True, return_counts=True)
        both = times[col] > 1  # a shingle of one set adds to no overlap
        new = np.cumsum(times > 1) - 1
        rows, cols = who[at][both], new[col[both]]
        for lo in range(0, int((times > 1).sum()), COLUMNS):
            now = (cols >= lo) & (cols < lo + COLUMNS)
            m = np.zeros((len(sets), min(COLUMNS, int((times > 1).sum()) - lo)), np.float32)
            m[rows[now], cols[now] - lo] = 1
            got += m @ m.T
    link = got.astype(np.float64) * den >= num * (n[:, None] + n[None, :] - got)
    np.fill_diagonal(link, False)
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(link[x] & left)
            left[near] = False
            out += [(root, y) for y in near]
            todo += list(near)
    sig = pdf["sig"].tolist()
    return pd.DataFrame({"a": [sig[x] for x, _ in out], "b": [sig[y] for _, y in out]}, columns=["a", "b"])


def _alike(x: str, y: str, num: int, den: int) -> Column:
    """May two classes link? x and y are structs of n and par. Sets differ at least where their sketches do."""
    word = lambda c, i: F.conv(F.hex(F.substring(f"{c}.par", 8 * i + 1, 8)), 16, -10).cast("long")
    unlike = sum((F.bit_count(word(x, i).bitwiseXOR(word(y, i))) for i in range(WORDS64)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (unlike * (num + den) <= F.lit(den - num) * (n + m))


def _star_pairs(busy: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each class of a busy key with the first and last class of its way, and of these with the key's."""
    x = F.struct("sig", "n", "par")
    ends = lambda c: [F.min(c).alias("lo"), F.max(c).alias("hi")]
    ways = busy.groupBy("tok", "way").agg(*ends(x))
    met = busy.select("tok", "way", x.alias("x")).join(ways, ["tok", "way"])
    keys = ways.groupBy("tok").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))  # at most WAYS rows a key
    both = ways.join(keys, "tok")
    side = lambda d, p, q: d.select(F.col(p).alias("x"), F.col(q).alias("y"))
    pairs = side(met, "x", "lo").unionByName(side(met, "x", "hi"))
    for p in ("lo", "hi"):
        pairs = pairs.unionByName(side(both, p, "first")).unionByName(side(both, p, "last"))
    pairs = pairs.where(F.col("x.sig") != F.col("y.sig")).where(_alike("x", "y", num, den))
    return pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def _open_rows(busy: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(tok, way, sig, n, part, least) of the busy keys whose classes lie in more than one component of the links so far."""
    roots = scratch.keep_narrow(components(links, scratch), "star-roots", 2 * links.count()).withColumnsRenamed({"node": "sig", "root": "part"})
    rows = busy.select("tok", "way", "sig", "n").join(roots, "sig", "left").withColumn("part", F.coalesce("part", "sig"))
    ways = rows.groupBy("tok", "way").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("sig").alias("least"))
    keys = ways.groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least")).where("lo <> hi").select("tok", "least")
    return rows.join(ways.select("tok", "way").join(keys, "tok"), ["tok", "way"])


def _may_link(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of two components whose full sketches allow a link, among the sets of two blocks: a spanning forest of them."""
    pdf = pdf.drop_duplicates("sig").sort_values(["n", "sig"])
    n, part, sketch, sig = pdf["n"].to_numpy(), pd.factorize(pdf["part"])[0], pdf["fine"].tolist(), pdf["sig"].tolist()
    bits = np.array([8 * len(x) for x in sketch])
    up, out = list(range(len(n))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    # Rows come by size, so what may link to a set of a level and is not smaller is a run from there on; it is folded to the level once.
    for size in np.unique(bits):
        own = np.flatnonzero(bits == size)
        end = int(np.searchsorted(n * num, n[own[-1]] * den, side="right"))
        at = np.stack([_fold(x, int(size)) for x in sketch[own[0] : end]])
        for i in own:
            last = int(np.searchsorted(n * num, n[i] * den, side="right"))
            near = np.arange(i + 1, last)
            near = near[part[near] != part[i]]
            if len(near):
                unlike = np.bitwise_count(at[near - own[0]] ^ at[i - own[0]]).sum(axis=1, dtype=np.int64)
                for j in near[unlike * (num + den) <= (den - num) * (n[i] + n[near])]:
                    if (x := top(i)) != (y := top(j)):
                        up[y] = x
                        out.append((i, j))
    return pd.DataFrame({"a": [sig[x] for x, _ in out], "b": [sig[y] for _, y in out]}, columns=["a", "b"])


def _hot_links(rows: DataFrame, sets: DataFrame, order, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links among classes that share a busy key (tok, sig, n, part, least), as spanning forests of bounded blocks; part is the component a class is in already."""
    # A key's classes hang together by its least class: one edge a row. Those that may link hang together by a forest of a row a class and block.
    nodes = rows.select("sig", "n", "part").distinct()
    by_key = rows.select(F.col("sig").alias("a"), F.col("least").alias("b"))
    block = ["root", "lo", "x", "hi", "y"]
    dealt = _blocks(nodes, by_key, num, den, SKETCH_SETS, SKETCH_SHINGLES, scratch).join(sets.select("sig", "fine"), "sig")
    may = dealt.groupBy(*block).applyInPandas(lambda pdf: _may_link(pdf[["sig", "n", "part", "fine"]], num, den), "a binary, b binary")
    may = scratch.keep(may, "may-link")
    scratch.free()
    dealt = _blocks(nodes, may, num, den, BLOCK_SETS, BLOCK_SHINGLES, scratch).join(sets.select("sig", "words"), "sig")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest(pdf[["sig", "words"]], k, num, den, *order)

    return dealt.groupBy(*block).applyInPandas(forest, "a binary, b binary")


def _blocks(nodes: DataFrame, edges: DataFrame, num: int, den: int, most_sets: int, most_shingles: int, scratch: Scratch) -> DataFrame:
    """(root, sig, n, part, lo, x, hi, y): the nodes (sig, n, part) in the clusters that edges (a, b) make, dealt to the pairs of bounded blocks that meet."""
    nodes = nodes.join(components(edges, scratch).withColumnRenamed("node", "sig"), "sig")
    # Classes of the cluster's largest component have no need to meet each other.
    main = nodes.groupBy("root", "part").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    # Sets that can link differ in length by less than one band. A cluster that fits one block is not cut into bands.
    nodes = nodes.join(main, "root").withColumn("rest", F.col("part") != F.col("main")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9))
    need = lambda c, w: F.greatest(F.ceil(F.col(c) / most_sets), F.ceil(F.col(w) / most_shingles))
    of = lambda rest, x: F.coalesce(F.sum(F.when(F.col("rest") == rest, x)), F.lit(0))
    full = nodes.groupBy("root", "band").agg(of(True, 1).alias("rc"), of(True, F.col("n")).alias("rw"), of(False, 1).alias("mc"), of(False, F.col("n")).alias("mw"))
    whole = full.groupBy("root").agg(F.sum(F.col("rc") + F.col("mc")).alias("c"), F.sum(F.col("rw") + F.col("mw")).alias("w")).select("root", (need("c", "w") <= 1).alias("whole"))
    # r blocks of the rest come first, then m of the main component.
    full = full.select("root", "band", need("rc", "rw").alias("r"), need("mc", "mw").alias("m"))
    up = full.select("root", (F.col("band") - 1).alias("band"), F.col("r").alias("ar"), F.col("m").alias("am"))
    down = full.select("root", (F.col("band") + 1).alias("band"), F.col("r").alias("ur"), F.col("m").alias("um"))
    plan = full.join(up, ["root", "band"], "left").join(down, ["root", "band"], "left").join(whole, "root").fillna(0, ["ar", "am", "ur", "um"])
    at = F.abs(F.xxhash64("sig"))
    nodes = nodes.join(plan, ["root", "band"]).withColumn("own", F.when(F.col("rest"), at % F.greatest("r", F.lit(1))).otherwise(F.col("r") + at % F.greatest("m", F.lit(1))))
    # A block's own pairs are met wherever it meets another block, so it meets itself only if it has no other.
    met = lambda r, m: f"filter(sequence(0L, {r} + {m}), i -> i < if(rest, {r} + {m}, {r}))"
    meet = F.expr(
        "if(whole or (rest and r + m = 1 and ar + am = 0 and ur + um = 0), array(struct(if(whole, -1L, band) as lo, 0L as x, -1L as hi, 0L as y)), concat("
        f"transform(filter({met('r', 'm')}, i -> i <> own), i -> struct(band as lo, least(own, i) as x, band as hi, greatest(own, i) as y)),"
        f"transform({met('ar', 'am')}, i -> struct(band as lo, own as x, band + 1 as hi, i as y)),"
        f"transform({met('ur', 'um')}, i -> struct(band - 1 as lo, i as x, band as hi, own as y))))"
    )
    return nodes.select("root", "sig", "n", "part", F.explode(meet).alias("m")).select("root", "sig", "n", "part", "m.*")


def _linked(docs: DataFrame, k: int, num: int, den: int, hot: int) -> DataFrame:
    """doc_id, h, n, root and component_id of each row; root names the component itself, as a repeated doc_id may be the least of several."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    seen = scratch.keep(_sets(docs, k), "sets")
    order = _order(seen.where("n = -1"))
    scratch.free()
    rows = seen.where("n >= 0")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"))

    known = rows.where("n > 0 and doc_id is not null")
    n_rows = rows.count()
    found = scratch.keep(_candidates(_prefixes(known, k, num, den, hot, order), num, den, hot), "found")
    scratch.free()
    # Repeated rows of a class are all alike: one stands for them, so that copies do not multiply pairs.
    one = known.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("par").alias("par")).withColumn("id", _id("sig"))
    one = scratch.keep_narrow(one, "one", n_rows)
    n_found = found.count()
    near = found.where("b is not null").select("a", "b", "na", "nb").distinct()
    x, y = (one.select(F.struct("sig", "n", "par").alias(s), F.col("id").alias(c), F.col("n").alias(f"n{c}")) for s, c in (("x", "a"), ("y", "b")))
    near = near.join(x, ["a", "na"]).join(y, ["b", "nb"]).where(_alike("x", "y", num, den))
    near = scratch.keep_narrow(near.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), "na", "nb"), "pairs", n_found + 2 * n_rows)
    busy = found.where("b is null").select("tok", F.col("a").alias("id"), F.col("na").alias("n"))
    busy = busy.join(one.select("id", "n", "sig", "par"), ["id", "n"]).withColumn("way", F.pmod(F.xxhash64("sig"), F.lit(WAYS)))
    busy = scratch.keep_narrow(busy.select("tok", "way", "sig", "n", "par"), "busy", n_found + n_rows)
    n_pairs = near.count() + 4 * busy.count()
    stars = scratch.keep_narrow(_star_pairs(busy, num, den), "star-pairs", n_pairs)

    # One row of each class wanted stands for it; its packed words are fetched by id and class.
    wanted = busy.select("sig").unionByName(near.select(F.col("a").alias("sig"))).unionByName(near.select(F.col("b").alias("sig"))).distinct()
    ids = one.select("sig", "doc_id").join(wanted, "sig", "left_semi")
    sets = known.select("sig", "doc_id", "words", F.coalesce("fine", "par").alias("fine")).join(ids.hint("shuffle_hash"), ["sig", "doc_id"], "left_semi")
    sets = scratch.keep(sets.dropDuplicates(["sig"]).select("sig", "words", "fine"), "words")
    del wanted, ids, x, y, one
    scratch.free()
    # Pairs with their sketches are heavier than narrow rows, so fewer of them go to a task.
    near = scratch.keep_narrow(_fine_pairs(near, sets, num, den), "near", 16 * n_pairs)
    stars = scratch.keep_narrow(_fine_pairs(stars, sets, num, den), "stars", 16 * n_pairs)
    scratch.free()
    # Only sets of pairs that are left are cut.
    left_in = near.unionByName(stars).select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    cut = scratch.keep(_fragments(sets.join(left_in, "sig", "left_semi"), order, k), "fragments")
    cold = scratch.keep_narrow(_count_pairs(near, cut, num, den).unionByName(_count_pairs(stars, cut, num, den)), "cold", n_pairs)
    scratch.drop("fragments")
    del left_in, cut
    scratch.free()
    left = scratch.keep_narrow(_open_rows(busy, cold, scratch), "open", n_found)
    links = cold.unionByName(_hot_links(left, sets, order, k, num, den, scratch))
    roots = components(scratch.keep(links, "links"), scratch)
    # Classes of a component share its least document.
    rooted = classes.join(roots, classes["sig"] == roots["node"], "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    comp = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = scratch.keep_narrow(rooted.join(comp, "root").select("sig", "root", "component_id"), "classes", n_rows)
    out = rows.join(by_class, "sig", "left")
    for name in ("found", "one", "pairs", "busy", "star-pairs", "words", "near", "stars", "cold", "star-roots", "open", "may-link", "links"):
        scratch.drop(name)
    scratch.free()
    return out.select("doc_id", "h", "n", "root", "component_id")


def groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: documents link at a Jaccard similarity of num / den or more."""
    out = _linked(docs, k, num, den, hot)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, hot: int = HOT) -> DataFrame:
    """(doc_id, h) of one row of each component of rows with words: of least doc_id, null last, then text hash h."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    return _linked(docs, k, num, den, hot).where("n > 0").groupBy("root").agg(least.alias("r")).select("r.doc_id", "r.h")
