"""Running values over a long series without one task a series: totals per chunk are carried forward, then chunks run by themselves.

A chunk is a stretch of the order (a day, say). Chunks of a series are few rows each, so only these are ordered together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], *, ends: str = "", **values: tuple[str, Column]) -> DataFrame:
    """Add name=(kind, column): kind 'sum', 'max' or 'last' (last non-null) of the column up to and including each row.

    With a prefix given as `ends`, prefix + name is the value that the series ends with: it comes from the same chunks, without another pass.
    """
    own = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    series = W.partitionBy(*keys).orderBy(chunk)
    before, all_ = series.rowsBetween(W.unboundedPreceding, -1), series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    carry = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    per = df.groupBy(*keys, chunk).agg(*[total[k](c).alias(f"_t_{n}") for n, (k, c) in values.items()])
    last = [carry[k](F.col(f"_t_{n}")).over(all_).alias(f"{ends}{n}") for n, (k, _) in values.items()] if ends else []
    per = per.select(*keys, chunk, *[carry[k](F.col(f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (k, _) in values.items()], *last)
    out = df.withColumns({f"_o_{n}": carry[k](c).over(own) for n, (k, c) in values.items()}).join(per, [*keys, chunk])
    return out.withColumns({n: join[k](F.col(f"_c_{n}"), F.col(f"_o_{n}")) for n, (k, _) in values.items()}).drop(*[f"_{x}_{n}" for n in values for x in "oc"])
