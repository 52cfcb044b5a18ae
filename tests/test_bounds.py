"""A task of a book's series does not grow with the series."""

from pyspark.sql import functions as F

from tests.test_features import T0
from tickloom.operators import book


def _shuffles(plan):
    if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
        yield plan.outputPartitioning().toString(), plan.output().mkString(",")
    for k in range(plan.children().size()):
        yield from _shuffles(plan.children().apply(k))


def test_a_series_of_deltas_is_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(book, "STRETCH", 10)
    d = spark.createDataFrame([("v", i, T0) for i in range(100)], "venue string, seq bigint, event_time timestamp")
    s = spark.createDataFrame([("v", 5)], "venue string, snapshot_seq bigint")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = book.contiguous(d, s, ["venue"])
        assert out.agg(F.count("*")).first()[0] == 94
        for by, columns in _shuffles(out._jdf.queryExecution().executedPlan()):
            assert "event_time" not in columns or "_s#" in by or "seq#" in by, (by, columns)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
