"""Order-level books from deltas: gaps, last action per order, levels, best prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.running import running
from tickloom.session import settled

#: Sequence numbers of a series that one task orders.
STRETCH = 1_000_000


def sequence_gaps(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Rows after a hole, with how many are missing; repeated numbers count once. A series is ordered by stretches, each told where the one before ended."""
    d = df.select(*keys, seq).distinct().withColumn("_s", F.floor(F.col(seq) / STRETCH))
    ends = d.groupBy(*keys, "_s").agg(F.max(seq).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(W.partitionBy(*keys).orderBy("_s")))
    before = F.coalesce(F.lag(seq).over(W.partitionBy(*keys, "_s").orderBy(seq)), F.col("_end"))
    return d.join(ends, [*keys, "_s"]).withColumn("missing", F.col(seq) - before - 1).where("missing > 0").drop("_s", "_end")


def contiguous(deltas: DataFrame, snapshot_seq: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas that a book in sync applies: after the snapshot, each number once, up to the first hole. Each stretch of a series is told both, so that a series is not one task."""
    snap = snapshot_seq.select(*keys, "snapshot_seq")
    d = deltas.withColumn("_s", F.floor(F.col("seq") / STRETCH))
    told = d.select(*keys, "_s").distinct().join(snap, keys)
    after = d.select(*keys, "_s", "seq").join(told, [*keys, "_s"]).where("seq > snapshot_seq")
    series = after.select(*keys, "seq").unionByName(snap.withColumnRenamed("snapshot_seq", "seq"))
    hole = sequence_gaps(series, keys).groupBy(*keys).agg(F.min("seq").alias("_hole"))
    told = told.join(hole, keys, "left")
    d = d.join(told, [*keys, "_s"]).where("seq > snapshot_seq and (_hole is null or seq < _hole)").drop("_hole", "snapshot_seq", "_s")
    return d.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "seq").orderBy("event_time"))).where("_n = 1").drop("_n")


def levels(deltas: DataFrame) -> DataFrame:
    """Quantity by instrument, side and price of the orders that live once all deltas are applied in order of seq.

    An order's life begins with an ADD while it does not live: of its deltas only those after its last DELETE count, from the first ADD on. That ADD gives
    side, price and quantity, the last MODIFY since another quantity; further ADDs of a living order, and MODIFY or DELETE of one that does not live, do nothing.
    """
    w = W.partitionBy("instrument", "order_id")
    is_ = lambda a: F.when(F.col("action") == a, F.col("seq"))
    d = deltas.withColumn("_gone", F.max(is_("DELETE")).over(w)).where("_gone is null or seq > _gone")
    d = d.withColumn("_since", F.min(is_("ADD")).over(w)).where("seq >= _since")
    g = d.groupBy("instrument", "order_id").agg(F.min_by(F.struct("side", "price", "quantity"), is_("ADD")).alias("o"), F.max_by(F.struct("quantity"), is_("MODIFY")).alias("m"))
    side = F.when(F.col("o.side") == "BUY", "BUY").otherwise("SELL")
    quantity = F.when(F.col("m").isNull(), F.col("o.quantity")).otherwise(F.col("m.quantity"))
    return g.groupBy("instrument", side.alias("side"), F.col("o.price").alias("price")).agg(F.sum(quantity).alias("quantity"), F.count("*").alias("orders"))


def best(levels_df: DataFrame) -> DataFrame:
    """Best prices of the levels that hold an order, whatever its quantity."""
    g = levels_df.groupBy("instrument")
    return g.agg(F.max(F.when(F.col("side") == "BUY", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "SELL", F.col("price"))).alias("best_ask"))


#: Deltas that a book may hold back while it waits for a missing number.
HELD = 1000
STATES = ("AWAITING_SNAPSHOT", "SYNCHRONIZED", "DESYNCED")


def followed(deltas: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Each number that came after a snapshot and beyond it, once: keys, _since and _base (that snapshot's arrival and number), seq, at (first arrival), and applied_at (null: never).

    A delta is applied once all numbers from the snapshot on are there: a running maximum of their arrivals tells when, as long as a running count tells of no hole.
    """
    none = F.lit(None).cast("bigint")
    both = snapshots.select(*keys, "arrival", none.alias("seq"), "snapshot_seq").unionByName(deltas.select(*keys, "arrival", F.col("seq").cast("bigint").alias("seq"), none.alias("snapshot_seq")))
    # Of equal arrivals the snapshot comes first.
    both = both.withColumns({"_chunk": F.expr(f"arrival div {STRETCH}"), "_rank": F.col("seq").isNotNull()})
    snap = F.when(~F.col("_rank"), F.struct(F.col("arrival").alias("since"), F.col("snapshot_seq").alias("base")))
    d = running(both, keys, "_chunk", ["arrival", "_rank", "seq"], snap=("last", snap)).where("seq > snap.base")
    d = d.groupBy(*keys, F.col("snap.since").alias("_since"), F.col("snap.base").alias("_base"), "seq").agg(F.min("arrival").alias("at"))
    d = settled(d, "followed").withColumn("_chunk", F.expr(f"seq div {STRETCH}"))
    d = running(d, [*keys, "_since", "_base"], "_chunk", ["seq"], n=("sum", F.lit(1)), top=("max", F.col("at")))
    return d.withColumn("applied_at", F.when(F.col("seq") - F.col("_base") == F.col("n"), F.col("top"))).drop("_chunk", "n", "top")


def synced(deltas: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The deltas that a book applies, each once, with applied_at: what arrives early waits for what is missing, what arrives late or before any snapshot is dropped."""
    f = followed(deltas, snapshots, keys).where("applied_at is not null").select(*keys, "seq", F.col("at").alias("arrival"), "applied_at")
    d = deltas.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "arrival", "seq").orderBy("event_time"))).where("_n = 1").drop("_n")
    return d.join(f, [*keys, "seq", "arrival"])


def sync_state(deltas: DataFrame, snapshots: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """keys, state, waiting, applied and last_seq once all of deltas (keys, arrival, seq) and snapshots (keys, arrival, snapshot_seq) have arrived, in order of arrival.

    Deltas ahead wait, each number once; when more than `held` do, the book is DESYNCED and stays so until its next snapshot, although what then comes in order is applied.
    Snapshots drop what waits. How many wait is a running sum over arrivals: one more for each number that comes, one less when it is applied. No series is one task.
    """
    f = settled(followed(deltas, snapshots, keys), "applied")
    own = [*keys, "_since"]
    moves = f.select(*own, F.explode(F.expr("filter(array(struct(at, 1L as step), struct(applied_at as at, -1L as step)), x -> x.at is not null)")).alias("x")).groupBy(*own, F.col("x.at").alias("at")).agg(F.sum("x.step").alias("step"))
    moves = running(moves.withColumn("_chunk", F.expr(f"at div {STRETCH}")), own, "_chunk", ["at"], ends="left_", waiting=("sum", F.col("step")))
    most = moves.groupBy(*own).agg(F.max("waiting").alias("most"), F.max("left_waiting").alias("waiting"))
    told = f.groupBy(*own).agg(F.count("applied_at").alias("n"), F.max(F.when(F.col("applied_at").isNotNull(), F.col("seq"))).alias("top")).join(most, own)
    base = snapshots.select(*keys, F.col("arrival").alias("_since"), "snapshot_seq")
    last = base.join(told, own, "left").groupBy(*keys).agg(F.max_by(F.struct("most", "waiting", F.coalesce("top", "snapshot_seq").alias("top")), "_since").alias("r"), F.sum("n").alias("n"))
    known = deltas.select(*keys).unionByName(snapshots.select(*keys)).distinct().join(last, keys, "left")
    state = F.when(F.col("r").isNull(), STATES[0]).when(F.coalesce("r.most", F.lit(0)) > held, STATES[2]).otherwise(STATES[1])
    return known.select(*keys, state.alias("state"), F.coalesce("r.waiting", F.lit(0)).alias("waiting"), F.coalesce("n", F.lit(0)).alias("applied"), F.col("r.top").alias("last_seq"))
