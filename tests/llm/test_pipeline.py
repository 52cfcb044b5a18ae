"""run() against a brute-force version of all stages on a small corpus: which documents stay, and how many words each still has."""

import random

import corpus_pipeline
from tests.llm.test_operators import brute_dedup, brute_groups, check_mix, docs, prose
from tickloom.llm import toxicity


def test_pipeline_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    items = [(i, prose(25, r)) for i in range(5)]
    block = "\n".join(prose(9, r) for _ in range(10))
    base = prose(120, r).split()
    rows, labels = [], []
    for i in range(160):
        t = "\n".join(prose(r.randint(3, 20), r) for _ in range(r.randint(1, 6)))
        if i % 8 == 0:
            t += "\nvloxin grubbash " + prose(5, r) + " snarfle"
        elif i % 8 == 1:
            t += "\n" + block
        elif i % 8 == 2:
            w = list(base)
            w[r.randrange(len(w))] = "edit"
            t = "\n".join(" ".join(w[k : k + 30]) for k in range(0, 120, 30))
        elif i % 16 == 3:
            t += "\n" + items[i % 5][1]
        rows.append((i, t, f"s{i % 3}"))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(900, None, "s0"), (901, "", None)]
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    m = toxicity.fit(d, lab)
    left = [(i, t) for i, t, _ in rows if m.score(t) < 0.5]
    assert {i for i, *_ in rows} - {i for i, _ in left} == {i for i, *_ in rows if i < 160 and i % 8 == 0}
    cleaned = brute_dedup(left)
    stay = {i for i, _, top in brute_groups(cleaned, 5, 4, 5) if top == i}

    def share(item, text):
        a, w = item.split(), (text or "").split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        hit = {k + j for k in range(len(a) - 4) if tuple(a[k : k + 5]) in grams for j in range(5)}
        return len(hit) / len(a)

    want = {i: len((t or "").split()) for i, t in cleaned if i in stay and all(share(x, t) < 0.5 for _, x in items)}
    assert {x.doc_id: x.size for x in got} == want
    for target, taken in check_mix(got).values():
        assert abs(taken - target) <= max(64, 0.03 * target)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
