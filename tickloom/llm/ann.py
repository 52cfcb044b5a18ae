"""Approximate nearest neighbours by additive quantisation, largest cosine first.

A unit vector is the sum of BOOKS codewords, each from a full-dimensional codebook fitted to the residuals left by the ones before
on a bounded sample (FIT_ROWS vectors of least hash, all other vectors take no part in fitting). A beam of BEAM partial
sums is kept while encoding; the sum's squared norm and its cosine with the vector are stored beside the vector itself. A query's product with
every codeword makes its lookup tables, so a coded vector's score is BOOKS table entries over the stored norm. Of a file the CANDIDATES best by
that score are checked first, by the exact cosine of the original vectors in double precision. How near any other vector can be
follows from two angles, of the query and of the vector to the vector's code: all that can be as near as the nearest checked so far are checked
too. So codes decide what need not be looked at, and the result is exact whatever the rows; where codes tell vectors badly apart
(crowds of nearly equal vectors, vectors unlike the sample), more are checked.

Codes are written to files of at most CODE_BLOCK rows and CODE_NUMBERS numbers in the shared folder, queries to files of at most QUERY_BLOCK rows. A task takes one
block of queries, reads the code files one after another and keeps the nearest of each query, so every query meets every code, codes are
never shuffled or copied by query, and a task holds one file. Only while there are few query blocks the code files are divided into up to RANGES ranges, to have more
tasks: what is shuffled is at most RANGES times the nearest, narrow rows, of a query. Work is the product of codes and queries, as every query is scored
against every code. Equal vectors have equal codes and hashes: of such a group a file gives the least ids, as many as a query can need.

Defined cases: vectors null, zero, or with null or non-finite components take no part, as queries or candidates; vectors
of several lengths are searched length by length, each with codebooks of its own; an id null takes no part; equal scores go by smaller vec_id; rows repeated alike count once;
a query with fewer candidates gets all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tickloom.llm.common import Scratch, open_fs

BOOKS, WORDS, BEAM = 24, 256, 3
FIT_ROWS, FIT_STEPS = 8192, 8
CANDIDATES, NEAREST = 200, 5
CODE_BLOCK, QUERY_BLOCK, RANGES = 65536, 512, 8
CODE_NUMBERS = 1 << 22
#: What single precision may add to a cosine by lookup tables, and double precision to one by a product.
LOOSE, TIGHT = 1e-4, 1e-12


def usable(v: Column) -> Column:
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(d, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by the largest component first so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, steps: int = FIT_STEPS, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dim): k-means on what the codewords before leave over."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32).copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(steps):
            near = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        near = np.argmin((c * c).sum(1)[None, :] - 2 * rest @ c.T, axis=1)
        rest -= c[near]
        out.append(c)
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, books), squared norms of the sums, and the sums' cosines with the unit vectors x. The beam's errors need only products with codewords and among them."""
    m, k, _ = books.shape
    flat = books.reshape(m * k, -1)
    gram = flat @ flat.T
    codes, norms, near = np.empty((len(x), m), np.uint8), np.empty(len(x), np.float64), np.empty(len(x), np.float64)
    for lo in range(0, len(x), 1024):
        dot = x[lo : lo + 1024].astype(np.float32) @ flat.T
        n = len(dot)
        err = np.zeros((n, 1), np.float32)
        path = np.zeros((n, 1, 0), np.int64)
        for b in range(m):
            own = slice(b * k, b * k + k)
            step = gram.diagonal()[own][None, None, :] - 2 * dot[:, None, own]
            step = np.repeat(step, path.shape[1], axis=1)
            for before in range(b):
                step += 2 * gram[before * k + path[:, :, before], own]
            total = (err[:, :, None] + step).reshape(n, -1)
            keep = min(beam, total.shape[1])
            at = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            err = np.take_along_axis(total, at, axis=1)
            path = np.concatenate([np.take_along_axis(path, (at // k)[:, :, None], axis=1), (at % k)[:, :, None]], axis=2)
        best = np.take_along_axis(path, np.argmin(err, axis=1)[:, None, None], axis=1)[:, 0]
        codes[lo : lo + n] = best
        total = sum(books[b][best[:, b]].astype(np.float64) for b in range(m))
        norms[lo : lo + n] = (total * total).sum(1)
        near[lo : lo + n] = (total * x[lo : lo + n]).sum(1) / np.sqrt(np.maximum(norms[lo : lo + n], 1e-12))
    return codes, norms, near


def _read(path: str, columns: list[str]) -> pa.Table:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        return pq.read_table(f, columns=columns)


class Best:
    """The nearest of a block of queries so far: largest cosine, then least id; at most `same` of equal vectors of a file are looked at."""

    def __init__(self, query_ids: np.ndarray, units: np.ndarray, books: np.ndarray, candidates: int, nearest: int):
        self.query_ids, self.units, self.books, self.candidates, self.nearest, self.same = query_ids, units, books, candidates, nearest, nearest + 1
        self.found = [(np.empty(0, np.float64), np.empty(0, np.int64))] * len(query_ids)  # score, vec_id
        self.checked = 0

    def meet(self, ids: np.ndarray, vh: np.ndarray, codes: np.ndarray, norm: np.ndarray, near: np.ndarray, vectors: np.ndarray) -> None:
        """Score one file's codes: lookup tables, summed by code, over the stored norms. Then check what can be among the nearest."""
        by = np.lexsort((ids, vh))
        first = np.flatnonzero(np.r_[True, vh[by][1:] != vh[by][:-1]])
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        use = np.sort(by[nth < self.same])
        ids, codes, x = ids[use], codes[use], _unit(vectors[use])
        scale = (1 / np.sqrt(np.maximum(norm[use], 1e-12))).astype(np.float32)
        # A sum of next to nothing has no direction, and tells nothing.
        near = np.where(norm[use] > 1e-4, np.clip(near[use], -1, 1), -1.0)
        aside = (np.sqrt(1 - near * near) + 1e-7).astype(np.float32)
        near = near.astype(np.float32)
        for lo in range(0, len(self.units), 64):
            tables = np.einsum("qd,mkd->mqk", self.units[lo : lo + 64].astype(np.float32), self.books, optimize=True)
            s = np.zeros((tables.shape[1], len(codes)), np.float32)
            for b in range(len(self.books)):
                s += np.take(tables[b], codes[:, b], axis=1)
            s *= scale
            n = min(self.candidates + 1, s.shape[1])  # one for the query itself
            best = np.argpartition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n :]
            # The most a cosine can be: of the difference of both angles to the code.
            s = np.minimum(s + np.float32(LOOSE), np.float32(1))
            most = np.where(s >= near, np.float32(1), s * near + np.sqrt(np.maximum(1 - s * s, 0)) * aside)
            for r in range(len(s)):
                self._check(lo + r, best[r], ids, x)
                score, _ = self.found[lo + r]
                most[r, best[r]] = -2
                self._check(lo + r, np.flatnonzero(most[r] >= (score[-1] - LOOSE if len(score) == self.nearest else -1.5)), ids, x)

    def _check(self, r: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact cosines of a query and the vectors at these places."""
        at, q = at[ids[at] != self.query_ids[r]], self.units[r]
        if not len(at):
            return
        self.checked += len(at)
        s = (x @ q)[at] if len(at) > len(x) // 4 else x[at] @ q
        score, own = self.found[r]
        n = min(self.nearest, len(at))
        least = np.partition(s, len(s) - n)[len(s) - n]
        at = at[s >= max(least, score[-1] if len(score) == self.nearest else -2) - TIGHT]
        # By one formula, whatever else is in the file, so that equal vectors have equal scores.
        score, own = np.r_[score, (x[at] * q).sum(1)], np.r_[own, ids[at]]
        by = np.lexsort((own, -score))[: self.nearest]
        self.found[r] = score[by], own[by]


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: Column, nearest: int = NEAREST, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: of the rows of vectors (vec_id, embedding) where `queries` holds, the nearest others of their length."""
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = sorted(r[0] for r in v.select(F.size("embedding")).distinct().collect())  # numbers of components, one search each
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for k, dim in enumerate(lengths):
        found = _search(v if len(lengths) == 1 else v.where(F.size("embedding") == dim), dim, nearest, candidates)
        out = found if not k else out.unionByName(found)
    return out


def _search(v: DataFrame, dim: int, nearest: int, candidates: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = v.sparkSession
    scratch = Scratch(spark, "ann")
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(FIT_ROWS).collect()  # at most FIT_ROWS vectors
    v = v.dropDuplicates(["vec_id", "embedding"])
    books = spark.sparkContext.broadcast(fit(_unit(np.array([r[0] for r in sample]))))
    kind = np.float32 if isinstance(v.schema["embedding"].dataType.elementType, FloatType) else np.float64  # either keeps the numbers as they are

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim).astype(kind)
                codes, norms, near = encode(_unit(x), books.value)
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(near), pa.array([c.tobytes() for c in x], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vh"), b.column("asks"), *columns], ["vec_id", "vh", "asks", "codes", "norm", "near", "vector"])

    coded = v.select("vec_id", F.xxhash64("embedding").alias("vh"), "asks", "embedding").mapInArrow(index, "vec_id long, vh long, asks boolean, codes binary, norm double, near double, vector binary")
    coded = scratch.keep(coded, "codes", rows=max(1, min(CODE_BLOCK, CODE_NUMBERS // dim)))
    asked = coded.agg(F.count_if("asks")).first()[0]
    if not asked:
        return spark.createDataFrame([], RESULT)
    scratch.keep(coded.where("asks").select("vec_id", "vector").repartition(-(-asked // QUERY_BLOCK)), "queries", rows=QUERY_BLOCK)
    code_at, query_at = scratch.files("codes"), scratch.files("queries")
    ranges = min(len(code_at), max(1, RANGES // len(query_at)))

    def numbers(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["vector"].to_pylist()), kind).reshape(t.num_rows, -1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                q = _read(query_at[task % len(query_at)], ["vec_id", "vector"])
                if not q.num_rows:
                    continue
                best = Best(q["vec_id"].to_numpy(), _unit(numbers(q)), books.value, candidates, nearest)
                for at in code_at[task // len(query_at) :: ranges]:
                    c = _read(at, ["vec_id", "vh", "codes", "norm", "near", "vector"])
                    if c.num_rows:
                        codes = np.frombuffer(b"".join(c["codes"].to_pylist()), np.uint8).reshape(c.num_rows, -1)
                        best.meet(c["vec_id"].to_numpy(), c["vh"].to_numpy(), codes, c["norm"].to_numpy(), c["near"].to_numpy(), numbers(c))
                for i, (score, ids) in zip(best.query_ids.tolist(), best.found, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    tasks = len(query_at) * ranges
    top = spark.range(0, tasks, 1, tasks).mapInArrow(look, "query_id long, vec_id long, score double")
    top = scratch.keep(top, "found")
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")))  # at most RANGES times `nearest` a query
    ranked = top.groupBy("query_id").agg(F.slice(order, 1, nearest).alias("l")).select("query_id", F.posexplode("l").alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
