"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh `weights` in turn and share `share` of all sizes. A target
   stops at `most` times its source's size; what is over goes to the others by weight until none is above. This is the
   level `lam` at which sum(least(most * size, lam * weight)) meets the total, found with one running sum over sources.
2. Blocks: each source is dealt by a hash of doc_id into shards of about SHARD_WORDS words; within a shard the documents, in
   seeded order, form one line of words cut into ceil(words / block) blocks of equal length.
3. Quotas: Sainte-Laguë (quotients votes / (2k + 1), highest first) gives each source whole blocks, then splits a
   source's blocks over its shards. Only quotients near the cut are ranked (see `sainte_lague`).
4. Selection: in a shard of n blocks every block is taken quota div n times, and quota mod n of them once more: those
   that a seeded permutation j -> (a j + b) mod n, with a prime above n, puts first. So a document finds its blocks'
   part in the mix from its own place on the line, without a list. `taken` is the words of these, repeats counted.

Defined cases: null or blank text has size 0 and takes 0; an empty table gives no rows; repeated rows each count as a
document and stand side by side on the line, so they may take unlike numbers of words, as blocks begin and end among them; ties in hash go by doc_id, then size; rows of a
null doc_id are placed by their text's hash, so that they are dealt over all shards. Other columns are not read. `sources` is taken to be a small dimension: its totals,
not its documents, are ranked together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, word_count

WEIGHTS, SHARE, MOST, BLOCK, SEED = (3, 1, 2), 1.5, 2, 64, "mix-7"
#: Words of a shard on average. It bounds what is sorted together, however large a source is.
SHARD_WORDS = 1_000_000
#: Primes just below 2^31, above any shard's number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with weight and target."""
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumns(
        {
            "total": F.lit(share) * F.sum("source_size").over(W.partitionBy()),
            "below": F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
    lam = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    target = F.coalesce(F.least("cap", lam * F.col("weight")), F.col("cap"))
    return s.withColumn("target", target).select(*sizes.columns, "weight", "target")


def sainte_lague(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Rows (group, key, votes, most, seats) get `quota`: a group's seats go by highest votes / (2k + 1), none above most.

    Votes are scaled to about the seats, so a row's quota is round(f * votes) for one f near 1 in the whole group. Rounding
    shifts a group's sum by half a seat a row, so f differs from 1 by at most (|seats - votes| + rows / 2) / votes, and
    only seats within that of round(votes) need ranking. Ties go to smaller k, then key.
    """
    g = W.partitionBy(*group)
    free = F.sum(F.when(F.col("votes") < F.col("most"), F.col("votes")).otherwise(0.0)).over(g)
    off = F.abs(F.col("seats") - F.sum("votes").over(g)) + F.count("*").over(g) / 2
    df = df.withColumns(
        {
            "_d": F.when(free > 0, F.ceil(F.col("votes") * off / F.greatest(free, F.lit(1.0)))).otherwise(F.ceil(off)) + 1,
            "_r": F.least(F.floor(F.col("votes") + 0.5), F.col("most")),
        }
    )
    df = df.withColumns({"_lo": F.greatest(F.col("_r") - F.col("_d"), F.lit(0)), "_hi": F.least(F.col("_r") + F.col("_d"), F.col("most"))})
    df = df.withColumn("_left", F.col("seats") - F.sum("_lo").over(g))
    near = df.select(*group, key, "votes", "_lo", "_left", F.explode_outer(F.expr("if(_hi > _lo, sequence(_lo, _hi - 1), null)")).alias("_k"))
    rank = F.row_number().over(g.orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc_nulls_last(), "_k", key))
    won = near.withColumn("_n", rank)
    return won.groupBy(*group, key).agg((F.first("_lo") + F.count(F.when((F.col("_n") <= F.col("_left")) & F.col("_k").isNotNull(), 1))).alias("quota"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, source, text). See the module's docstring."""
    hashed = lambda *c: F.md5(F.concat_ws("/", F.lit(seed), *c))
    number = lambda h, at: F.conv(F.substring(h, at, 12), 16, 10).cast("long")
    by_text = F.when(F.col("doc_id").isNull(), F.concat(F.lit("n"), F.md5(F.coalesce("text", F.lit("")))))
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), by_text.alias("_t"))
    # _sk: the source as a key that is never null; _h: a document's seeded place.
    d = d.withColumns({"_sk": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "_h": hashed(F.coalesce(F.col("doc_id").cast("string"), "_t"))}).drop("_t")
    # Texts are read once; what follows works on sizes.
    scratch = Scratch(docs.sparkSession, "mixing")
    d = scratch.keep(d, "sizes")
    plan = targets(d.groupBy("_sk").agg(F.sum("size").alias("source_size"), F.first("source").alias("source")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("_sk", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("_shards"), rate.alias("_rate"))
    plan = scratch.keep(plan, "plan")  # Spark knows its size from here on, and broadcasts it only if that is small
    d = d.drop("source").join(plan, "_sk").withColumn("_shard", number(F.col("_h"), 1) % F.col("_shards"))

    shards = d.groupBy("_sk", "_shard").agg(F.sum("size").alias("_w"), F.first("_rate").alias("_rate")).withColumn("_n", F.ceil(F.col("_w") / block)).where("_n > 0")
    shards = shards.withColumns({"votes": F.col("_n") * F.col("_rate"), "most": F.lit(most) * F.col("_n")})
    src = shards.groupBy("_sk").agg(F.sum("votes").alias("votes"), F.sum("most").alias("most"))
    src = sainte_lague(src.withColumn("seats", F.round(F.sum("votes").over(W.partitionBy())).cast("long")), [], "_sk")
    quota = sainte_lague(shards.join(src.withColumnRenamed("quota", "seats"), "_sk"), ["_sk"], "_shard").join(shards.select("_sk", "_shard", "_w", "_n"), ["_sk", "_shard"])
    b = hashed("_sk", F.col("_shard").cast("string"))
    primes = F.array(*[F.lit(p) for p in PRIMES])
    quota = quota.withColumns({"_a": F.element_at(primes, (number(b, 13) % len(PRIMES) + 1).cast("int")) % F.col("_n"), "_b": number(b, 1) % F.col("_n")})

    line = W.partitionBy("_sk", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(line)).join(quota, ["_sk", "_shard"], "left")
    d = d.withColumn("_start", F.col("_end") - F.col("size"))
    # Block j covers the words [w j div n, w (j + 1) div n), so word p lies in block ((p + 1) n - 1) div w.
    extra = F.expr(
        "aggregate(sequence(((_start + 1) * _n - 1) div _w, (_end * _n - 1) div _w), 0L, (s, j) -> s + "
        "if((_a * j + _b) % _n < quota % _n, least(_end, (_w * (j + 1)) div _n) - greatest(_start, (_w * j) div _n), 0L))"
    )
    taken = F.when((F.col("size") > 0) & F.col("quota").isNotNull(), F.expr("(quota div _n) * size") + extra).otherwise(F.lit(0))
    return d.select("doc_id", "size", "source_size", F.col("target").cast("double"), taken.cast("long").alias("taken"))
