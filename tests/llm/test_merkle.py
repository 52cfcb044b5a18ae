"""Merkle manifests against trees built in one place."""

import hashlib
import random
import zlib

import pytest

from tickloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    for lv in levels[:-1]:
        s = i // 8 * 8
        yield "".join(lv[s:i]), "".join(lv[i + 1 : s + 8])
        i //= 8


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[2] for g in sorted(groups[x], key=lambda g: g[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(groups[x], key=lambda g: g[:3])):
            p = [*path(trees[x], i), *path(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, r[1].translate(LOW)) if hit and r[1] is not None else own
            for a, b in p:
                node = h(a + node + b)
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h("".join(a + b for a, b in p)), node, node == top[-1][0]))
    return out


def same(got, rows):
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def docs(n, langs, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "Été", "x", "", "\U0001f600", "A\nB", None])
    return [(rng.choice([i, i, i, None, 7]), word(), rng.choice(langs), rng.choice(["web", None, ""]), rng.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("step", [1, 2, 4])
@pytest.mark.parametrize("n,langs", [(1, ["en"]), (9, ["en"]), (700, ["en", None, "", "é", "zz", "Z"]), (130, [f"l{i}" for i in range(70)])])
def test_proofs(spark, step, n, langs):
    rows = docs(n, langs)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "'y' as leaf", "2 as idx")
    same(merkle.report(df.repartition(3), step).collect(), rows)


def test_rows_all_alike(spark):
    rows = [(5, "Same", "en", "web", 4)] * 300
    same(merkle.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), rows)


def test_no_rows(spark):
    assert merkle.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_merging_is_associative_and_commutative():
    rng = random.Random(2)
    sizes = [1, 8, 9, 64, 65, 530, 3]
    nodes = [((t, n, 0, i), h(f"{t}/{i}")) for t, n in enumerate(sizes) for i in range(n)]
    roots = set()
    for _ in range(6):
        rng.shuffle(nodes)
        parts = []
        for k in range(9):
            f = merkle.Forest(len(sizes))
            for key, v in nodes[k::9]:
                f.add(key, v)
            parts.append(f)
        while len(parts) > 1:
            a = parts.pop(rng.randrange(len(parts)))
            parts.append(parts.pop(rng.randrange(len(parts))).merge(a))
        roots.add(tuple(parts[0].nodes.items()))
    ((found,),) = roots
    assert found[1] == tree([tree([h(f"{t}/{i}") for i in range(n)])[-1][0] for t, n in enumerate(sizes)])[-1][0]


def test_a_range_of_leaves_leaves_few_nodes():
    """What a fragment holds is bounded by the tree's height, not by its leaves."""
    f = merkle.Forest(1)
    for i in range(1001, 60_000):
        f.add((0, 100_000, 0, i), h(str(i)))
    assert len(f.nodes) <= 14 * 6
