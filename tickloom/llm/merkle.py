"""Merkle manifest of a data set: one tree a group, one tree over the groups, proofs for every row.

The method is an associative merge of sparse forests. A forest holds unresolved nodes by (tree, size, level, index); since a tree's size is
known, so is the arity of every run of siblings, and a run is replaced by its parent as soon as it is whole. Tasks turn aligned stretches of
ARITY ** STEP neighbours into forests of one node each, `treeReduce` merges what is left of them into one forest, which is the root.
The root goes to the driver; nodes that proofs need stay in tables, one a round of STEP levels, and paths are handed down the same way.

Leaves are ranked by one range-partitioned sort of narrow rows and counts by (group, partition), so no group is one task.

Defined cases: null fields are hashed as `-`; rows of one doc_id are ordered by their leaf, rows alike in all are alike in any order; a null doc_id
is the least; null languages are a group of their own; an empty table has no rows and no root; columns beyond the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch

ARITY, STEP = 8, 4
#: Rows a batch of results.
ROWS = 4096
#: The tree over the groups; groups are numbered from 0.
TOP = -1
#: Fragments of a range of nodes each that treeReduce merges: what reaches the driver is bounded by them and by the tree's height.
FRAGMENTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<l:string,r:string>>"
_PATH = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))

Key = tuple[int, int, int, int]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree of `size` leaves."""
    return -(-size // ARITY**level)


class Forest:
    """Unresolved nodes by (tree, size, level, index). Merging is associative and commutative, the empty forest is neutral.

    With `groups` given, a resolved tree becomes the leaf of its number in the tree over so many groups. Nodes of level `top` are left as they are.
    """

    def __init__(self, groups: int | None = None, top: int | None = None):
        self.groups, self.top, self.nodes = groups, top, {}

    def add(self, key: Key, value: str) -> Forest:
        nodes = self.nodes
        while True:
            tree, size, level, index = key
            n = width(size, level)
            if n == 1:
                if self.groups is None or tree == TOP:
                    nodes[key] = value
                    return self
                key = (TOP, self.groups, 0, tree)
                continue
            nodes[key] = value
            if level == self.top:
                return self
            start = index - index % ARITY
            run = [(tree, size, level, i) for i in range(start, min(start + ARITY, n))]
            if not all(k in nodes for k in run):
                return self
            key, value = (tree, size, level + 1, index // ARITY), digest("".join([nodes.pop(k) for k in run]))

    def merge(self, other: Forest) -> Forest:
        few, many = sorted((self, other), key=lambda f: len(f.nodes))
        for k, v in few.nodes.items():
            many.add(k, v)
        return many


def field(name: str) -> Column:
    c = F.col(name).cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(text: Column) -> Column:
    """The digest of a row of documents whose text is as given."""
    t = F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*map(field, ("doc_id", "source", "lang", "n_chars")), t), 256)


def ranked(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """leaves (group, doc_id, leaf, ...) with tree (the group's number), size and idx (the leaf's place)."""
    # Rows alike in all three are told apart by where they were read, so that no copy's group is one task.
    order = ["group", "doc_id", "leaf", "_where"]
    at = leaves.withColumn("_where", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_where")
    at = scratch.keep(at.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    cells = at.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = W.partitionBy("group")
    earlier = by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "size": F.sum("_n").over(by), "_starts": F.col("_part") == F.min("_part").over(by)})
    cells = scratch.keep(cells, "cells")
    # Groups are numbered in the order of the sort: those that start in earlier partitions, then those before in this one.
    starts = cells.where("_starts")
    parts = starts.groupBy("_part").agg(F.count("*").alias("_s"))
    parts = parts.withColumn("_s", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # as many rows as partitions
    number = F.row_number().over(W.partitionBy("_part").orderBy(F.asc_nulls_first("group"))) - 1
    trees = starts.withColumn("_k", number).join(parts, "_part").select(F.col("group").alias("_g"), (F.col("_k") + F.col("_s")).cast("long").alias("tree"))
    cells = cells.join(trees, F.col("group").eqNullSafe(F.col("_g"))).drop("_g", "_starts", "_n")
    cells = cells.withColumnsRenamed({"group": "_g", "_part": "_p"})
    out = at.join(cells, (F.col("_part") == F.col("_p")) & F.col("group").eqNullSafe(F.col("_g")))
    return out.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_g", "_p", "_at", "_part", "_first", "_before")


def _stretches(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Rows, sorted so, by (tree, stretch): ARITY ** step nodes and a row that hands a path down at most."""
    held: list[dict] = []
    for r in rows:
        if held and (held[-1]["tree"], held[-1]["stretch"]) != (r["tree"], r["stretch"]):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _mapped(df: DataFrame, make: Callable[[list[dict]], list[dict]], ddl: str, kinds: pa.Schema) -> DataFrame:
    """make() applied to each stretch of df, which has a column for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for part in _stretches(r for b in batches for r in b.to_pylist()):
            out += make(part)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition("tree", "stretch").sortWithinPartitions("tree", "stretch", "idx").mapInArrow(run, ddl)


NODE = "tree long, size long, level int, idx long, node string"
_NODE = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("node", pa.string())])


def _cut(nodes: DataFrame, step: int) -> DataFrame:
    return nodes.withColumn("stretch", F.floor(F.col("idx") / F.lit(ARITY**step)))


def raised(nodes: DataFrame, step: int = STEP) -> DataFrame:
    """The nodes `step` levels up, or a tree's root where that comes first."""

    def make(part: list[dict]) -> list[dict]:
        forest = Forest(top=part[0]["level"] + step)
        for r in part:
            forest.add((r["tree"], r["size"], r["level"], r["idx"]), r["node"])
        ((key, value),) = forest.nodes.items()
        return [dict(zip(_NODE.names, (*key, value), strict=True))]

    return _mapped(_cut(nodes, step), make, NODE, _NODE)


def levels(part: list[str], size: int, level: int, step: int) -> list[list[tuple[str, str]]]:
    """For each level that a stretch resolves, each node's siblings left and right of it."""
    out, top = [], level + step
    while level < top and width(size, level) > 1:
        runs = [part[i : i + ARITY] for i in range(0, len(part), ARITY)]
        out.append([("".join(r[:k]), "".join(r[k + 1 :])) for r in runs for k in range(len(r))])
        part, level = [digest("".join(r)) for r in runs], level + 1
    return out


def _path(found: list[list[tuple[str, str]]], i: int) -> list[tuple[str, str]]:
    return [lv[i // ARITY**k] for k, lv in enumerate(found)]


def lowered(nodes: DataFrame, above: DataFrame, step: int = STEP) -> DataFrame:
    """Paths (tree, idx, path) of nodes, given those of the nodes that `raised` made of them."""

    def make(part: list[dict]) -> list[dict]:
        head, *rest = part
        found = levels([r["node"] for r in rest], rest[0]["size"], rest[0]["level"], step)
        return [{"tree": r["tree"], "idx": r["idx"], "path": [{"l": a, "r": b} for a, b in _path(found, i)] + head["path"]} for i, r in enumerate(rest)]

    kinds = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("path", _PATH)])
    return _mapped(_headed(nodes, above, step), make, f"tree long, idx long, path {PATH}", kinds)


def _headed(nodes: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """nodes, each stretch led by the row of `above` that hands its path down (idx -1)."""
    return _cut(nodes, step).unionByName(above.withColumnRenamed("idx", "stretch").withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)


def rounds(scratch: Scratch, nodes: DataFrame, name: str, step: int = STEP) -> list[DataFrame]:
    """nodes and what they are raised to, until every tree is one node. The last are the trees' roots."""
    most, out = nodes.agg(F.max("size")).first()[0] or 0, [nodes]
    while most > 1:
        out.append(scratch.keep(raised(out[-1], step), f"{name}{len(out)}"))
        most = -(-most // ARITY**step)
    return out


def reduced(nodes: DataFrame, groups: int) -> str | None:
    """The root over all groups, by merging forests of ranges of nodes."""

    def plant(rows: Iterator) -> Iterator[Forest]:
        forest = Forest(groups)
        for r in rows:
            forest.add((r["tree"], r["size"], r["level"], r["idx"]), r["node"])
        yield forest

    left = nodes.repartitionByRange(FRAGMENTS, "tree", "idx").rdd.mapPartitions(plant).treeReduce(Forest.merge).nodes
    if len(left) > 1:
        raise ValueError("leaves are missing")
    return next(iter(left.values()), None)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


class Manifest:
    """Trees over leaves (group, doc_id, leaf, claim): their root, and what verifying each claim (else the leaf) against it gives."""

    def __init__(self, leaves: DataFrame, step: int = STEP):
        self.step = step
        self.scratch = s = Scratch(leaves.sparkSession, "merkle")
        # Hashed once: the sort reads its input twice, to find its bounds and to deal it out.
        self.leaves = s.keep(ranked(s, s.keep(leaves, "leaves")), "ranked")
        base = self.leaves.select("tree", "size", F.lit(0).alias("level"), "idx", F.col("leaf").alias("node"))
        self.up = rounds(s, base, "nodes", step)
        roots = self.up[-1]
        self.groups = roots.count()
        over = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(self.groups).cast("long").alias("size"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "node")
        self.over = rounds(s, over, "over", step)
        self.root = reduced(self.up[min(1, len(self.up) - 1)], self.groups)

    def proved(self) -> DataFrame:
        """One row a leaf: proof_sha256 over its siblings to the root, and the root that its claim folds to."""
        s, root, step = self.scratch, self.root, self.step
        path = self.over[-1].select("tree", "idx", F.from_json(F.lit("[]"), PATH).alias("path"))
        for k, nodes in enumerate(reversed(self.over[:-1])):
            path = s.keep(lowered(nodes, path, step), f"over-path{k}")
        # A group's path in the tree over the groups is what its root hands down.
        path = path.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "path")
        for k, nodes in enumerate(reversed(self.up[1:-1])):
            path = s.keep(lowered(nodes, path, step), f"path{k}")
        path = path.join(self.up[-1].select("tree", F.col("node").alias("subroot")), "tree")

        def make(part: list[dict]) -> list[dict]:
            head, *rest = part
            found = levels([r["leaf"] for r in rest], rest[0]["size"], 0, step)
            above = [(p["l"], p["r"]) for p in head["path"]]
            out = []
            for i, r in enumerate(rest):
                path = _path(found, i) + above
                node = r["claim"] or r["leaf"]
                for a, b in path:
                    node = digest(a + node + b)
                proof = digest("".join([x for p in path for x in p]))
                out.append({"doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": head["subroot"], "root": root, "proof_sha256": proof, "folded_root": node, "verified": node == root})
            return out

        return _mapped(_headed(self.leaves.select("tree", "size", "idx", "doc_id", "leaf", "claim"), path, step), make, RESULT, _RESULT)


def report(docs: DataFrame, step: int = STEP) -> DataFrame:
    """Every document proved, where 3 divides its id's crc32 from a text with A-Z lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claim = F.when(hit, leaf(F.translate("text", UPPER, LOWER)))
    return Manifest(docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("leaf"), claim.alias("claim")), step).proved()
