"""The nearest vectors are found whatever the rows: where codes tell them badly apart, more are checked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann


def rows(kind):
    g = np.random.default_rng(5)
    if kind == "crowds":  # of nearly equal vectors, more than are checked first
        return g.normal(size=(4, 16))[g.integers(0, 4, 2400)] + 1e-3 * g.normal(size=(2400, 16))
    if kind == "alike":  # all of them
        return 5 + 1e-4 * g.normal(size=(1200, 16))
    return g.normal(size=(1500, 300))  # too many components for the codes to tell much


@pytest.mark.parametrize("kind", ["crowds", "alike", "long"])
def test_all_nearest_are_found(spark, kind):
    x = rows(kind).astype(np.float32)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(v, F.col("vec_id") % 50 == 0, candidates=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, len(x), 50))
    for q, found in got.items():
        s = (u * u[q]).sum(1)
        s[q] = -9
        best = np.sort(s)[::-1][:5]
        np.testing.assert_allclose([k for _, _, k in sorted(found)], best, rtol=0, atol=1e-12)
        np.testing.assert_allclose(s[[i for _, i, _ in sorted(found)]], best, rtol=0, atol=1e-12)
