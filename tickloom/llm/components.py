"""Connected components by alternating large-star and small-star steps, each a groupBy and a join."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step. large: each u tells its larger neighbours of its least one; small: u hangs itself and its smaller ones there."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if not small:
        least = least.select("u", F.least("u", "m").alias("m"))
    told = both.join(least, "u")
    if small:
        return told.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, root) of every node in a link, root being the least node of its component.

    Nulls and self-links are left out. Steps go on until the edges no longer change. Every intermediate edge list is written to the shared folder; no list is collected.
    A step never makes more edges than two for each it was given, which sizes the files written.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, "edges0")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, done = mark(e), False
    for k in count(1):
        if now[0] == 0:
            break
        new = scratch.keep_narrow(_stars(_stars(e, small=False), small=True), f"edges{k}", 2 * now[0])
        then = mark(new)
        scratch.drop(f"edges{k - 1}")
        e, done, now = new, then == now, then
        if done:
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
