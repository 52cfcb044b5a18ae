"""Components of long chains, and one row of each group in the pipeline's n-gram stage."""

import random

import corpus_pipeline
from tests.llm.test_operators import docs, prose
from tickloom.llm import components
from tickloom.llm.common import Scratch


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 2, raising=False)  # the bound there was
    ids = list(range(100))
    random.Random(4).shuffle(ids)
    d = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    got = components.components(d, Scratch(spark, "chain")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(100)]


def test_one_row_of_each_group_stays(spark):
    r = random.Random(6)
    a, b, c, e, f = (prose(40, r) for _ in range(5))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [
        (1, a), (1, a), (2, near), (3, a.upper()),  # repeated row, near copy, copy but for case
        (4, b), (4, a),  # a copy of another document beside a text of its own
        (5, c), (5, e), (6, e),  # one id, two groups: both stay
        (None, f), (None, f), (None, f.upper()), (None, a),  # copies without ids
        (7, None), (7, None), (None, ""), (None, " \n"), (8, ""),  # no words
    ]
    out = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows).repartition(3), "")
    assert out.columns == docs(spark, rows).columns
    key = lambda x: tuple((y is None, y or "") for y in x)
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=key)
    null = [x for x in got if x[0] is None and (x[1] or "").strip()]
    assert len(null) == 1 and null[0][1].lower() == f
    want = [(1, a), (4, b), (5, c), (5, e), (7, None), (7, None), (None, ""), (None, " \n"), (8, ""), null[0]]
    assert got == sorted(want, key=key)
