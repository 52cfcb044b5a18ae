"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding: lower case, Latin look-alikes of other scripts and accented letters to plain letters, digits and signs that stand for letters to
these, every other sign to one blank. Lexicon terms are whole words or word beginnings. A match inside an exception
phrase does not count; of several terms at one word the heaviest counts. With W the sum of weights and n the words, the
score is the logistic function of a fitted line in log(1 + W) and W / sqrt(n + 16).

The lexicon and the line are learned from a bounded sample of labelled rows (`SAMPLE_ROWS`, those of least hash), of
which the held-out fold, crc32(doc_id as text) mod 5 = 0, is left out. Nothing but the text is an input of a score. Terms that may be learned are
whole words of WORD_CHARS characters (longer runs are no words of a lexicon, shorter ones are particles) and beginnings of words of PREFIXES characters; the MAX_TERMS of them that
weigh most (log odds times the root of the positive texts) are kept. These bounds are of the lexicon, which is a parameter of the operator, not of the texts scored.

Defined cases: null or empty text scores as W = 0; repeated rows are scored alike; doc_id null is held out (no
remainder); with no positive label the seed lexicon alone is used; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000
MAX_TERMS = 512
PREFIXES = (4, 5, 6)
WORD_CHARS = (3, 24)
MAX_WEIGHT = 6.0

#: Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
}
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

#: Seeds used with what is learned, at the weight given.
SEED_TERMS = {"idiot": 3.0, "moron": 3.0, "stupid": 3.0, "scum": 3.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0, "loser": 3.0}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "path of least resistance")


class _Fold(dict):
    """Code point -> folded string, filled as characters come up. Bounded by the number of code points."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        low = ch.lower()
        if low in STANDINS:
            out = STANDINS[low]
        elif low in LOOKALIKES:
            out = LOOKALIKES[low]
        else:
            kept = [x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x)]
            out = "".join(LOOKALIKES.get(x, x) if x.isalnum() else " " for x in kept) if kept else ""
            if unicodedata.category(ch) == "Cf":
                out = ""  # invisible joiners and marks
        self[c] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The folded text, its words with one blank between, before and after."""
    # A sign that stands for a letter does so only before another letter: "stupid!" ends in a sign.
    t = re.sub(r"[!|](?!\w)", " ", text or "")
    return f" {' '.join(t.translate(_FOLD).split())} "


@dataclass(frozen=True)
class Model:
    """terms: folded term (a leading blank; a trailing one too for whole words) -> weight; line: bias and two slopes."""

    terms: Mapping[str, float]
    line: tuple[float, float, float] = (-3.0, 3.0, 1.0)
    exceptions: Sequence[str] = EXCEPTIONS
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {"terms": dict(self.terms), "line": self.line, "exceptions": tuple(self.exceptions), "_built": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._built:
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                t = fold(e)
                if t.strip():
                    a.add_word(t, (len(t), None))
            a.make_automaton()
            self._built.append(a)
        return self._built[0]

    def weight(self, folded: str) -> float:
        """Sum of the weights of matched words, exceptions apart."""
        if not (self.terms or self.exceptions):
            return 0.0
        at: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(folded):
            start = end - n + 1
            if w is None:
                excused.append((start, end))
            elif w > at.get(start, 0.0):
                at[start] = w
        for a, b in excused:
            for s in [s for s in at if a <= s < b]:
                del at[s]
        return sum(at.values())

    def features(self, text: str | None) -> tuple[float, float]:
        f = fold(text)
        w = self.weight(f)
        return math.log1p(w), w / math.sqrt(f.count(" ") + 16)

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        z = self.line[0] + self.line[1] * x + self.line[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms_of(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if WORD_CHARS[0] <= len(w) <= WORD_CHARS[1]} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, seeds: Mapping[str, float] = SEED_TERMS, exceptions: Sequence[str] = EXCEPTIONS) -> Model:
    """Learn from at most sample_rows labelled rows outside the held-out fold; counts are taken in Spark, by term."""
    fold_of = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # Equal texts count once: a group of copies is no evidence of its own.
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("text", "toxic"), F.struct("doc_id", "toxic")).alias("r")).select("r.*")
    texts = texts.persist()
    try:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                terms, pos, neg = [], [], []
                for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                    got = _terms_of(t)
                    terms += got
                    pos += [int(y == 1)] * len(got)
                    neg += [int(y != 1)] * len(got)
                yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "pos": pa.array(pos, pa.int64()), "neg": pa.array(neg, pa.int64())})

        n_pos, n_neg = texts.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") != 1, 1))).first()
        terms: dict[str, float] = {fold(t): w for t, w in seeds.items()}
        if n_pos:
            least = max(4, n_pos // 100)
            odds = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1)))
            counted = texts.mapInArrow(spread, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            best = counted.where(F.col("pos") >= least).withColumn("w", odds).where("w >= 2.0").orderBy((F.col("w") * F.sqrt("pos")).desc(), "term").limit(max_terms)
            terms |= {r["term"]: min(MAX_WEIGHT, float(r["w"])) for r in best.collect()}
        model = Model(terms, exceptions=tuple(exceptions))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [model.features(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"x": pa.array([v[0] for v in x], pa.float64()), "y": pa.array([v[1] for v in x], pa.float64()), "toxic": b.column("toxic").cast(pa.float64())})

        if n_pos and n_neg:
            seen = texts.mapInArrow(look, "x double, y double, toxic double").toPandas()  # at most sample_rows rows of three numbers
            model = Model(model.terms, _line(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy()), model.exceptions)
    finally:
        texts.unpersist()
    return model


def _line(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, slopes kept from falling below 0."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    a, y = np.c_[np.ones(len(x)), x][order], (y[order] == 1).astype(float)
    b, use = np.zeros(3), np.ones(3, bool)
    for _ in range(2):
        b[:] = 0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            g = a.T @ (y - p) - l2 * b * [0, 1, 1]
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, l2, l2])
            step = np.linalg.solve(h[np.ix_(use, use)], g[use])
            b[use] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if (b[1:] >= 0).all():
            break
        use[1:] &= b[1:] >= 0
    return tuple(float(v) for v in b * use)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), s], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    d = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
