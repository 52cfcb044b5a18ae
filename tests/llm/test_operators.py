"""Each operator against a brute-force version or exact round trip, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import pickle
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, common, decontaminate, license_scan, line_dedup, mixing, ngram_join, pii, token_counts, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so") for b in ("ba", "di", "fo", "gu", "ha", "ti", "vo")]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows], DOC)


ODD = [(None, "no id here at all"), (900, None), (901, ""), (902, " \t\n "), (903, prose(20_000)), (904, "same row twice here ok"), (904, "same row twice here ok"), (905, "x" * 50_000)]


# ---- mixing


def check_mix(rows):
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
    by = {}
    for r in rows:
        t = by.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
    return by


def test_mixing(spark):
    d = docs(spark, [(i, prose(100 + i % 50 + i % 3), f"s{i % 3}") for i in range(300)] + [(*x, None) for x in ODD])
    rows = mixing.mix(d.withColumn("size", F.lit(1)).withColumn("_h", F.lit(2))).collect()
    assert len(rows) == 308
    for target, taken in check_mix(rows).values():
        assert abs(taken - target) <= max(64, 0.01 * target)
    again = mixing.mix(d.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert [(r.doc_id, r.taken) for r in sorted(rows, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    assert mixing.mix(docs(spark, [(1, "a")]).where("false")).count() == 0
    assert {r.taken for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()} == {0}


# ---- n-gram join


def brute_groups(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[q : q + k]) for q in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()))
    par = {i: i for i, _ in sets}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            c = len(x & y)
            if x and y and c * den >= num * (len(x) + len(y) - c):
                p, q = sorted((top(sets[a][0]), top(sets[b][0])))
                par[q] = p
    return sorted((i, len(s), top(i)) for i, s in sets)


@pytest.mark.parametrize("hot", [48, 1])
@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, hot, k, num, den):
    r = random.Random(k)
    rows = [(i, prose(r.randint(1, 80), r)) for i in range(60)]
    for base in range(6):
        words = prose(60 + 20 * base, r).split()
        for j in range(12):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((100 + 20 * base + j, " ".join(w).upper() if j % 2 else "\t".join(w)))
    rows += [x for x in ODD if x[0] is not None]
    got = sorted(tuple(x) for x in ngram_join.groups(docs(spark, rows).withColumn("n", F.lit(1)).withColumn("sig", F.lit("x")), k, num, den, hot).collect())
    assert got == brute_groups(rows, k, num, den)


@pytest.mark.parametrize(("batch", "hot", "sets"), [(7, 4, 1024), (10_000, 4, 3), (7, 1, 5)])
def test_ngram_join_small_batches_and_blocks(spark, monkeypatch, batch, hot, sets):
    """Keys that run on over batches, keys busy in one batch only, and clusters cut into several blocks and length bands."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = random.Random(batch + hot)
        words = prose(90, r).split()
        rows = [(i, prose(r.randint(1, 40), r)) for i in range(20)]
        for j in range(50):  # one cluster of growing length, linked in chains only
            w = words + prose(j, r).split() if j % 3 else words + [f"tail{q}" for q in range(j)]
            rows.append((100 + j, " ".join(w)))
        rows += rows[25:30] + [(900 + j, " ".join(words)) for j in range(6)]
        got = sorted(tuple(x) for x in ngram_join.groups(docs(spark, rows), 5, 4, 5, hot).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_groups(rows, 5, 4, 5)


@pytest.mark.parametrize(("hot", "k", "num", "den"), [(48, 3, 9, 10), (2, 3, 9, 10), (2, 5, 4, 5)])
def test_long_texts_that_share_keys_by_chance_send_no_words(spark, monkeypatch, hot, k, num, den):
    """Sets beyond what a 512-bit sketch tells apart: the pairs and blocks that words are sent for don't grow with the square of such texts."""
    r = random.Random(8)
    shared = [" ".join(f"s{i}x{j}" for j in range(k)) for i in range(1200)]
    parts = [[[f"w{r.randint(0, 10**9)}" for _ in range(2600)]] for _ in range(36)]
    for i, phrase in enumerate(shared):
        for x in r.sample(range(36), 2 if hot > 2 else 6):
            parts[x].append([phrase])
    texts = [" ".join(w for part in p for w in part) for p in parts]
    near = texts[5].split()
    near[7] = near[2000] = "other"
    rows = [(i + 1, x) for i, x in enumerate(texts)] + [(50, " ".join(near))]
    # Without counts to go by, every shingle is as likely to be in a prefix.
    monkeypatch.setattr(ngram_join, "_order", lambda parts: (np.arange(1 << ngram_join.CELL_BITS, dtype=np.uint64), np.empty(0, np.uint64)))
    sent, count, blocks = [], ngram_join._count_pairs, ngram_join._blocks
    monkeypatch.setattr(ngram_join, "_count_pairs", lambda pairs, *a: sent.append(pairs.count()) or count(pairs, *a))

    def spied(nodes, edges, num, den, most_sets, *a):
        out = blocks(nodes, edges, num, den, most_sets, *a)
        if most_sets == ngram_join.BLOCK_SETS:
            sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_blocks", spied)
    got = sorted(tuple(x) for x in ngram_join.groups(docs(spark, rows), k, num, den, hot).collect())
    assert got == brute_groups(rows, k, num, den)
    assert len(sent) == 3 and sum(sent) <= 6


def test_the_order_tells_busy_keys_from_rare_ones_at_6_gb():
    """6 GB of text hold about 1.2e9 shingles (100 million were counted in 0.5 GB): a key of 60 texts must not come among a text's rarest fifth by the noise of its cell."""
    r = np.random.default_rng(4)
    counts = r.poisson(1.2e9 / (1 << ngram_join.CELL_BITS), 1 << ngram_join.CELL_BITS).astype(np.uint32)
    busy = r.choice(len(counts), 4000, replace=False)
    counts[busy] += 60
    rank = ngram_join._ranked(counts)[0]
    assert (rank[busy] < len(rank) // 5).mean() < 0.002


def test_the_sketch_adds_up(spark):
    """The tasks' packed rows of the sketch give the counts of all shingles, however they are dealt."""
    rows = [(i, prose(40, random.Random(i % 30))) for i in range(60)]
    counts = np.zeros(1 << ngram_join.CELL_BITS, np.uint32)
    for _, text in rows:
        np.add.at(counts, ngram_join._cell(ngram_join.shingle_set(text, 3)), 1)
    rank, pivots = ngram_join._order(ngram_join._sets(docs(spark, rows).repartition(5), 3).where("n = -1"))
    want = ngram_join._ranked(counts)
    assert (rank == want[0]).all() and (pivots == want[1]).all()


def test_the_driver_holds_no_order(spark):
    """The cells are ranked by a task and read by tasks: the driver, whose memory a session bounds, neither collects nor sends them."""
    parts = ngram_join._sets(docs(spark, [(i, prose(40, random.Random(i))) for i in range(60)]), 3).where("n = -1")
    tracemalloc.start()
    try:
        order = ngram_join._order(parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < (4 << ngram_join.CELL_BITS) // 8
    assert len(pickle.dumps(order)) < 10_000
    rank, _ = order
    assert (np.sort(rank) == np.arange(1 << ngram_join.CELL_BITS)).all()


def test_the_driver_hands_native_memory_back(spark):
    assert "Trim native heap" in common.trim(spark)


def test_full_sketches_fold_to_smaller_ones():
    r = np.random.default_rng(3)
    for n in (513, 1024, 1025, 9000):
        s = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        bits = ngram_join._bits(len(s))
        assert len(s) <= bits < 2 * len(s) + 2
        for size in (512, bits):
            assert (ngram_join._fold(ngram_join._parity(s, bits).tobytes(), size) == ngram_join._parity(s, size)).all()


def test_ngram_join_null_ids_and_empty(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, "q r s t u v")])).collect()}
    assert got == {(None, 2, 3), (3, 2, 3), (4, 0, 4), (None, 2, None)}
    assert ngram_join.groups(docs(spark, [(1, "a")]).where("false")).count() == 0


# ---- line dedup


def brute_lines(text):
    """[first, last] of each chunk."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    roll = [(x * 31 + y) % 1000003 for x, y in zip(h, h[1:] + [0], strict=True)]
    alone = [len(x.split()) >= 13 for x in lines]
    out, at = [], 0
    for i in range(len(lines)):
        end = i + 1 == len(lines)
        if end or alone[i] or alone[i + 1] or roll[i] < roll[i + 1] or (i and roll[i - 1] >= roll[i]):
            out.append((at, i))
            at = i + 1
    return lines, out


def brute_dedup(rows):
    """(doc_id, text) in order of doc_id: what is left of each text."""
    first, out = {}, []
    for i, text in rows:
        if text is None:
            out.append((i, None))
            continue
        lines, parts = brute_lines(text)
        gone = set()
        for a, z in parts:
            own = tuple(lines[a : z + 1])
            if not any(x.strip() for x in own):
                continue
            side = lambda k: 1 if 0 <= k < len(lines) and len(lines[k].split()) >= 13 else 2
            prev, after = lines[max(0, a - side(a - 1)) : a][::-1], lines[z + 1 : z + 1 + side(z + 1)]
            if own not in first:
                first[own] = (prev, after)
                continue
            grow = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            back, on = grow(prev, first[own][0]), grow(after, first[own][1])
            run = range(a - back, z + on + 1)
            if sum(bool(lines[k].strip()) for k in run) >= 2 or any(len(lines[k].split()) >= 50 for k in run):
                gone |= set(run)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(12)
    block = [prose(8, r) for _ in range(12)]
    rows = []
    for i in range(120):
        own = [prose(r.choice((2, 5, 9, 20, 55)), r) for _ in range(r.randint(1, 7))]
        if i % 3 == 0:
            k = r.randint(0, 8)
            own[1:1] = block[k : k + r.randint(2, 12)]
        if i % 5 == 0:
            own.insert(r.randint(0, len(own)), "one common line")
        if i % 7 == 0:
            own += ["", "  ", ""]
        if i % 11 == 0:
            own = ["again and again"] * r.randint(1, 6) + own
        rows.append((i, "\n".join(own)))
    rows += [(200, "a b\rc\n\td\x0be\n" + rows[3][1]), (201, "f f f"), (202, rows[9][1]), *[x for x in ODD if x[0] not in (None, 904)]]
    d = docs(spark, rows)
    for c in ("__id", "__h", "__places", "_id", "_h", "_gone", "gone", "key", "ls", "x"):
        d = d.withColumn(c, F.lit(1))
    out = line_dedup.dedup(d.repartition(5), "n_chars")
    assert out.columns == d.columns
    got = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert got == {i: (t, len(t or "")) for i, t in brute_dedup(sorted(rows))}
    assert any(x != y for (_, x), (_, y) in zip(sorted(rows), brute_dedup(sorted(rows)), strict=True))


def test_line_dedup_removes_whole_passages(spark):
    """Passages of over 50 words between different neighbours, of 1 to 13 lines; and texts that lie at the least length a passage has."""
    r, rows, want = random.Random(3), [], {}
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    line = lambda n: " ".join(word() for _ in range(n))
    for n in range(1, 14):
        for k in range(40):
            passage = [line(-(-52 // n)) for _ in range(n)]
            for copy in (0, 1):
                own = [[line(8) for _ in range(3)] for _ in range(2)]
                rows.append((2 * (100 * n + k) + copy, "\n".join([*own[0], *passage, *own[1]])))
            want[rows[-1][0]] = "\n".join(own[0] + own[1])
    short = " ".join("abcdefghij"[i % 10] for i in range(50))
    rows += [(9000, short), (9001, short), (9002, short + "k"), (9003, short[:97]), (9004, short[:97])]
    got = {x.doc_id: x.text for x in line_dedup.dedup(docs(spark, rows)).collect()}
    assert all(got[i] == t for i, t in rows if i % 2 == 0 and i < 9000)
    for n in range(1, 14):
        whole = sum(got[i] == want[i] for i in want if i // 200 == n)
        assert whole == 40, n
    assert [got[i] == "" for i in range(9000, 9005)] == [False, True, False, False, False]


@pytest.mark.parametrize("between", [[], [""]])
def test_line_dedup_rule_finds_every_passage(between):
    """The rule itself: passages of 51 words and more, lines of any length, between different neighbours, with or without blank lines."""
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    for _ in range(500):
        most, passage = r.choice((4, 8, 12, 16, 25)), []
        while sum(len(x.split()) for x in passage) <= 50:
            passage += [line(r.randint(1, most)), *between]
        own = [[[line(r.randint(1, most)) for _ in range(3)] for _ in range(2)] for _ in range(2)]
        rows = [(k, "\n".join(a + passage + b)) for k, (a, b) in enumerate(own)]
        first, second = brute_dedup(rows)
        assert first == rows[0] and [x for x in second[1].split("\n") if x] == own[1][0] + own[1][1]


def test_line_dedup_odd_rows(spark):
    passage = prose(60)
    rows = [(20, f"own line one\n{passage}\nown line two"), (21, f"{prose(4)}\n{prose(9)}\n{passage}"), *ODD, (None, f"first of all\n{passage}"), (22, f"x\n{passage}"), (22, f"x\n{passage}")]
    d = docs(spark, rows)
    out = line_dedup.dedup(d)
    assert out.columns == d.columns and out.count() == len(rows)
    got = {}
    for x in out.collect():
        got.setdefault(x.doc_id, []).append(x.text)
    assert sorted(got[None]) == sorted(["no id here at all", f"first of all\n{passage}"]) and got[20] == ["own line one\nown line two"]
    assert passage not in got[21][0] and got[22] == ["x", "x"] and got[904] == ["same row twice here ok"] * 2
    assert all(got[x[0]] == [x[1]] for x in ODD if x[0] not in (None, 904))
    assert line_dedup.report(docs(spark, [(1, "a\nb")]).where("false")).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(800):
        y = i % 5 == 0
        w = prose(r.randint(5, 120), r).split()
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(["vloxin", "vloxer", "grubbash", "snarfle"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    m = toxicity.fit(d, lab)
    got = toxicity.score(d.withColumn("score", F.lit(0)).withColumn("toxic", F.lit(7)), m).join(lab, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.toxic for x in got) >= 0.97 * len(got)
    assert m.score("a vl0xin and a vlохin") == m.score("a vloxin and a vloxin") > 0.5  # digits and look-alikes
    odd = toxicity.score(docs(spark, ODD), m).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score < 0.5 for x in odd)
    assert toxicity.keep_clean(docs(spark, [(1, "grubbash vloxin snarfle"), (2, "lo ba")]), m).select("doc_id").collect()[0][0] == 2
    assert toxicity.fit(d.where("false"), lab.where("false")).score(None) < 0.5


def test_exception_phrases():
    m = toxicity.Model({" trash ": 3.0}, (-2.0, 2.0, 1.0), ("trash can",))
    assert m.weight(toxicity.fold("Put it in the trash can")) == 0 and m.weight(toxicity.fold("trash!")) == 3.0


def naive_weight(model, folded):
    """By looking for each term at each place."""
    at = {}
    for term, w in model.terms.items():
        for i in range(len(folded)):
            if folded.startswith(term, i) and w > at.get(i, 0.0):
                at[i] = w
    for e in model.exceptions:
        x = toxicity.fold(e)
        for i in range(len(folded)):
            if x.strip() and folded.startswith(x, i):
                at = {k: w for k, w in at.items() if not i <= k < i + len(x) - 1}  # the last blank begins the next word
    return sum(at.values())


def test_matcher_equals_naive_scanning():
    r = random.Random(17)
    stems = ["ab", "abc", "abcd", "bc", "bcd", "cab", "dab", "da"]
    for _ in range(400):
        terms = {f" {w}{r.choice(['', ' '])}": float(r.randint(1, 9)) for w in r.sample(stems, r.randint(0, 6))}
        m = toxicity.Model(terms, (-2.0, 2.0, 1.0), tuple(" ".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 3))))
        text = " ".join(r.choice([*stems, "abcde", "@bc", "4bcd", "b\u0441", "d\u00e1", "!", "d!"]) for _ in range(r.randint(0, 20)))
        f = toxicity.fold(text)
        assert m.weight(f) == naive_weight(m, f), (terms, m.exceptions, text)


# ---- personal data

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_equals_plain_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choice("a1@.+-(5 0.@b9é%2") for _ in range(r.randint(0, 40)))
        assert plain_spans(t) == pii.base_spans(t), t


def test_pii_query(spark):
    text = 'mail jo.e@x.example.com password=5aaa9ac60bfe74b24b é 10.0.0.1 card 4111 1111 1111 1111, tel +1 (415) 555-2671'
    d = docs(spark, [(1, text), *ODD]).withColumn("spans", F.lit("x"))
    got = pii.find(d).collect()
    r = next(x for x in got if x.doc_id == 1)
    base = plain_spans(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
    assert "secret:" in r.spans and len(got) == len(ODD) + 1 and r.n_spans == len(r.spans.split(",")) == 4 + r.n_added
    clean = pii.redact(d).where("doc_id = 1").first().text
    assert "4111" not in clean and "<secret>" in clean and "<email>" in clean
    assert pii.find(d.where("false")).count() == 0


def test_field_beats_chance_on_new_sentences():
    hit = total = wrong = 0
    for t, spans in pii._made(random.Random(99), 120):
        base = pii.base_spans(t)
        got = {(a, b) for a, _, b in pii.added_spans(t, base, pii.model())}
        want = {(a, b) for a, b, _ in spans if not any(s < b and a < e for s, _, e in base)}
        hit, total, wrong = hit + len(got & want), total + len(want), wrong + len(got - want)
    assert hit >= 0.85 * total and wrong <= 0.15 * total


PARTS = ["password", "=", ": ", " ", " ", "ssn ", "token", '"', "'", "123", "45", "6789", "77777777", "hunterlongphrase", "the", "of ", "aB3dE6gH", "CamelCaseWord", "x@y.com", "10.0.0.1", "é", "_", "-", "4111 1111 1111 1111", ", ", "\n", "0123456789abcdef0123", "key"]


def test_field_decodes_the_best_of_all_segmentations():
    """Against scoring each segmentation of short token lists."""
    r, w = random.Random(8), dict(pii.model())
    seen = 0
    for case in range(300):
        if case == 150:  # weights that favour entities
            w = {k: v + (0.6 if k[0] and k[1] == "bias" else 0) for k, v in w.items()}
        t = "".join(r.choice(PARTS) for _ in range(r.randint(1, 9)))
        base = pii.base_spans(t)
        toks = pii.tokens(t, base)
        if len(toks) > 10:
            continue
        edges = [(i, j, y, pii._score(w, y, f)) for j, own in enumerate(pii.lattice(t, toks, base)) for i, kind, f in own for y in pii._labels(kind)]

        def all_from(at, last):
            if at == len(toks):
                yield 0.0, ()
                return
            for s, rest in all_from(at + 1, 0):
                yield s, rest
            for i, j, y, own in edges:
                if i == at:
                    for s, rest in all_from(j, y):
                        yield own + pii._step(w, last, y) + s, ((i, j, y), *rest)

        best = max(s for s, _ in all_from(0, 0))
        got = pii.decode(t, toks, w, base)
        starts, ends = {a: k for k, (a, _) in enumerate(toks)}, {b: k + 1 for k, (_, b) in enumerate(toks)}
        said = tuple((starts[a], ends[b], pii.LABELS.index(y, 1)) for a, y, b in got)
        assert any(rest == said and abs(s - best) < 1e-9 for s, rest in all_from(0, 0)), t
        seen += bool(got)
    assert seen > 50


def test_field_windows_change_nothing():
    """Decoding around triggers gives what decoding the whole text does, on long joined tokens too."""
    r, w = random.Random(9), pii.model()
    found = 0
    for _ in range(1500):
        t = "".join(r.choice(["plain", "words ", "here ", "-" * r.randint(1, 30), "z" * r.randint(1, 90), ". ", *PARTS]) for _ in range(r.randint(1, 60)))
        base = pii.base_spans(t)
        whole = [x for x in pii.decode(t, pii.tokens(t, base), w, base) if x[1] > 3 and not any(a < x[2] and x[0] < b for a, _, b in base)]
        assert pii.added_spans(t, base, w) == whole, t
        found += len(whole)
    assert found > 500


def test_field_finds_forms_beyond_hex():
    said = lambda t: [(t[a:b], pii.KINDS[k]) for a, k, b in pii.added_spans(t, pii.base_spans(t), pii.model())]
    assert said("password=correcthorsebattery") == [("correcthorsebattery", "secret")] and said("secret: hunterlongphrase") == [("hunterlongphrase", "secret")]
    assert said("my ssn 123 45 6789 is mine") == [("123 45 6789", "id")]
    assert said("the secret garden was lovely") == said("the key point is remarkable") == said("JavaScript and LaTeX, page 123456") == []
    assert said("write to a.b@example.com or 10.0.0.1") == []


WHOLE = {
    "password=550e8400-e29b-41d4-a716-446655440000 and so": ["550e8400-e29b-41d4-a716-446655440000"],
    "the secret: wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY is out": ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"],
    "token=eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P stays": ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"],
    "my iban MT84 MALT 0110 0001 2345 MTLC AST0 01S please": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
    "password: p@ss": ["p@ss"], "passport number C01234567 was": ["C01234567"], "key = aB3dE6gH9jK2mN5pQ8sT1vW4+yZ7bC0==": ["aB3dE6gH9jK2mN5pQ8sT1vW4+yZ7bC0=="],
    "see https://foo.org/a/b-c/2024-01-10.html, request 550e8400-e29b-41d4-a716-446655440000": [], "state-of-the-art COVID-19-related AT&T R&D": [], "the key/value store, the key-value pairs, password reset": [],
}


def test_entities_go_whole(spark):
    """Words that signs join are one entity, and nothing of it is left behind."""
    texts = list(WHOLE)
    for t in texts:
        assert [t[a:b] for a, _, b in pii.added_spans(t, pii.base_spans(t), pii.model())] == WHOLE[t], t
    got = {r.doc_id: r.text for r in pii.redact(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        for x in WHOLE[t]:
            assert not any(piece in got[k] for piece in re.findall(r"[^\W_]{3,}", x)), got[k]


def test_long_joined_words_take_no_square_of_time():
    t = "password=" + "a1-" * 40_000 + "x " + "b2c " * 20_000
    began = time.perf_counter()
    (first, *_) = pii.added_spans(t, pii.base_spans(t), pii.model())
    assert first[0] == 9 and first[2] == 9 + 120_001 and time.perf_counter() - began < 30


# ---- decontamination


def test_tiles_mark_reordered_runs():
    ids = lambda s: np.array([hash(w) & 0xFFFFFFFF for w in s.split()], np.uint64)
    item, doc = ids("a b c d e f g h i j k l"), ids("x g h i j k l y a b c d e f z")
    assert sorted(decontaminate.tiles(item, doc, 3)) == [(0, 8, 6), (6, 1, 6)]
    assert decontaminate.tiles(item, ids("a b x c d y"), 3) == []


def brute_tiles(a, d, least):
    """Greedy string tiling by definition: the longest free common run, first in the item, then in the document, until none of `least` words is left."""
    least, out, ia, idd = min(least, len(a)), [], set(), set()
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(d)):
                n = 0
                while i + n < len(a) and j + n < len(d) and a[i + n] == d[j + n] and i + n not in ia and j + n not in idd:
                    n += 1
                if n >= max(1, least) and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return sorted(out)
        n, i, j = -best[0], *best[1:]
        ia |= set(range(i, i + n))
        idd |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_equal_quadratic_greedy_tiling():
    r = random.Random(31)
    for case in range(400):
        a = [r.choice("abcd"[: r.randint(2, 4)]) for _ in range(r.randint(1, 24))]
        d = [r.choice("abcd") for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            x = r.randrange(len(a))
            at = r.randint(0, len(d))
            d[at:at] = a[x : x + r.randint(1, 12)]
        least = r.randint(1, 5)
        code = lambda w: np.array([ord(c) for c in w], np.uint64)
        assert sorted(decontaminate.tiles(code(a), code(d), least)) == brute_tiles(a, d, least), (case, a, d, least)


def test_decontamination_both_ways(spark):
    items = [(i, prose(30)) for i in range(8)] + [(50, "short one"), (51, None), (52, ""), (53, "one"), (60, prose(7))]
    items += [(7, items[7][1]), (7, items[2][1]), (None, items[5][1]), (None, items[5][1])]  # an item twice, an id with two texts, no id
    w = items[3][1].split()
    rows = [(1, f"{prose(50)} {items[0][1].upper()} {prose(20)}"), (2, f"{' '.join(w[15:])} {prose(5)} {' '.join(w[:15])}"), (3, prose(200)), (4, f"{' '.join(w[:9])} {prose(60)}"), (5, "a short one here"), *ODD]
    rows += [(6, items[7][1]), (6, items[7][1]), (8, f"{items[2][1]} {items[7][1]}"), (None, items[5][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_items)
    got = sorted(decontaminate.report(d, b).collect(), key=key)
    far = sorted(decontaminate.report(d, b, broadcast_bytes=0).collect(), key=key)
    assert got == far == sorted(decontaminate.report(d, b, broadcast_words=0).collect(), key=key) and len(got) == len(rows)

    def brute(text):
        t, out = (text or "").lower().split(), {}
        for i, x in {(i, x) for i, x in items if x and len(x.split()) >= 5}:
            c = sum(n for _, _, n in brute_tiles(x.split(), t, 5)) / len(x.split())
            if c >= 0.5:
                out.setdefault(i, []).append(c)
        return sorted(((-c, i is None, i or 0) for i, cs in out.items() for c in cs))

    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        if r.doc_id in (903, 905, None):
            continue
        want = brute(texts[r.doc_id][0])
        assert r.contaminated == bool(want) and r.items == [None if z else i for _, z, i in want] and abs(r.max_coverage + (want[0][0] if want else 0)) < 1e-12
    by = {r.doc_id: r for r in got}
    assert not by[5].contaminated and by[5].n_short == 2 and by[6].items == [7] and sorted(by[8].items) == [2, 7, 7]
    assert sorted(r.items for r in got if r.doc_id is None) == [[], [5, None]]
    assert not any(by[x[0]].contaminated for x in ODD if x[0] is not None)
    kept = decontaminate.keep_clean(d.withColumn("items", F.lit(1)).withColumn("_h", F.lit(1)), b)
    assert kept.columns == [*d.columns, "items", "_h"] and kept.count() == len(rows) - 6
    kept = decontaminate.keep_clean(d.withColumn("items", F.lit(1)).withColumn("_h", F.lit(1)), b, broadcast_words=0)
    assert kept.columns == [*d.columns, "items", "_h"] and kept.count() == len(rows) - 6
    assert decontaminate.report(d, b.where("false")).where("contaminated").count() == 0
    assert decontaminate.report(d, b.where("false"), broadcast_words=-1).where("contaminated").count() == 0
    assert decontaminate.report(d.where("false"), b).count() == 0


# ---- nearest neighbours


def test_ann_recall_ties_and_bad_vectors(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(1500, 24)) + g.normal(size=(10, 24))[g.integers(0, 10, 1500)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].astype(np.float32).tolist()) for i in range(300)]
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] * 24), (9150, [None] * 24), (None, rows[0][1]), (9200, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.search(v, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [(i, np.array(e, np.float64)) for i, e in rows if i is not None and i < 9000]
    ids, m = np.array([i for i, _ in ok]), np.array([e / np.linalg.norm(e) for _, e in ok])
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 5 and [k for k, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hit, total = hit + len({*best} & {*found}), total + 5
    assert hit >= 0.9 * total and {*got} == {*ids[ids % 50 == 0].tolist()}
    assert [i for _, i, _ in sorted(got[0])] == [5000, 5001, 5002, 5003, 5004]
    assert ann.search(v.where("false"), F.lit(True)).count() == 0
    assert ann.search(v.where("vec_id in (1, 2)"), F.lit(True)).count() == 2


def test_ann_searches_each_length_by_itself(spark):
    g = np.random.default_rng(2)
    rows = [(i, g.normal(size=n).tolist()) for i, n in enumerate([6] * 60 + [3] * 8 + [2])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    own = {i: np.array(e) / np.linalg.norm(e) for i, e in rows}
    for i, _ in rows:
        want = sorted((-round(float(own[i] @ own[j]), 12), j) for j in own if j != i and len(own[j]) == len(own[i]))[:5]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want]


def test_ann_many_files_and_ranges(spark, monkeypatch):
    """The same result whether codes and queries lie in one file or many; rows repeated alike count once; a hot vector."""
    g = np.random.default_rng(4)
    x = g.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(200)] + [(7, x[7].tolist())] * 3
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = lambda: [tuple(r) for r in ann.search(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    one = ask()
    for code, query, parts in ((64, 3, 8), (1000, 1, 1), (32, 512, 4)):
        monkeypatch.setattr(ann, "CODE_BLOCK", code)
        monkeypatch.setattr(ann, "QUERY_BLOCK", query)
        monkeypatch.setattr(ann, "RANGES", parts)
        assert ask() == one
    own = {i: np.array(e, np.float64) / np.linalg.norm(np.array(e, np.float64)) for i, e in rows}
    for q in {r[0] for r in one}:
        want = sorted(((-round(float(own[q] @ own[i]), 12), i) for i in own if i != q))[:5]
        assert [r[2] for r in one if r[0] == q] == [i for _, i in want]


# ---- licenses


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, f"{prose(300)} {mit.upper()} {prose(100)}"), (2, f"{prose(9)}\nReleased under the MIT License.\n{prose(9)}"), (3, " ".join(mit.split()[:20])), (4, "the license of this work is mine"), *ODD]
    got = {r.doc_id: r.licenses for r in license_scan.report(docs(spark, rows).withColumn("licenses", F.lit("x"))).collect()}
    assert got[1] == "mit" and got[2] == "mit-line" and got[3] == "" and got[4] == "" and got[903] == ""
    assert license_scan.report(docs(spark, [(1, "a")]).where("false")).count() == 0


# ---- WARC


@pytest.mark.parametrize("hot", [1000, 5, 0])  # all payloads broadcast, some, none
def test_warc_round_trip(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    rows = [(i, f"http://x/{i}", f"<p>{i % 4}</p>" * 50) for i in range(40)] + [(100, None, None), (101, "a\r\nb%", ""), (None, "u", "<p>1</p>" * 50), (7, "http://x/7", "<p>3</p>" * 50), (200, "long", "é" * 300_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    index = warc.write(p, str(tmp_path / "a"))
    index.write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    got = warc.read(index, payload=True, gap=10, most=2000).collect()
    assert len(got) == len(rows)
    want = Counter((i, u, len((h or "").encode()), warc.digest32((h or "").encode())) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got) == want
    first = {0: 0, 1: 1, 2: 2, 3: 3}
    for r in got:
        if r.page_id is not None and r.page_id < 40:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 4 else ("revisit", first[r.page_id % 4]))
        if r.page_id is None:
            assert r.refers_to == 1
        if r.record_type == "response" and r.page_id == 200:
            assert r.payload.decode() == "é" * 300_000
    some = warc.read(index.where("page_id in (3, 30, 200)")).collect()
    assert {r.page_id for r in some} == {3, 30, 200}
    assert warc.round_trip(p.where("false")).count() == 0


# ---- token counts


def test_token_counts_deltas(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "s"))
    enc = token_counts.encoding(*r.shared.value)
    ddl = "doc_id long, text string, source string, lang string, op string, seq int, tokens int"
    mk = lambda rows: spark.createDataFrame([(*x, 0) for x in rows], ddl)
    now = {}

    def apply(rows):
        for i, t, s, lang, op, _ in sorted(rows, key=lambda x: x[5]):
            if op == "delete":
                now.pop(i, None)
            else:
                now[i] = (s, lang, token_counts.count(t, enc))

    def same():
        want = Counter()
        n = Counter()
        for s, lang, k in now.values():
            want[s, lang] += k
            n[s, lang] += 1
        assert {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()} == {k: (n[k], want[k]) for k in n}

    one = [(i, prose(30 + i), f"s{i % 2}", "en", "insert", 0) for i in range(20)] + [(50, None, None, "de", "insert", 0), (51, "", "s0", None, "insert", 0), (52, prose(30_000), "s0", "en", "insert", 0)]
    two = [(3, "changed text", "s1", "fr", "revise", 1), (4, None, "s0", "en", "delete", 2), (4, "first", "s0", "en", "revise", 1), (77, "x", "s0", "en", "delete", 1), (5, prose(9), "s1", "en", "insert", 3)]
    for name, rows in (("b1", one), ("b2", two)):
        assert r.commit(name, mk(rows)) and not r.commit(name, mk(rows))
        apply(rows)
        same()
    (tmp_path / "s" / "b3" / "docs").mkdir(parents=True)  # a batch that broke off
    same()
    assert r.commit("b3", mk(two).where("false"))
    same()


def test_token_counts_snapshots(spark, tmp_path, monkeypatch):
    """The same totals with snapshots after every other batch; null ids and repeated rows; a snapshot that broke off is ignored."""
    monkeypatch.setattr(token_counts, "COMPACT", 2)
    r = token_counts.Rollup(spark, str(tmp_path / "s"))
    enc = token_counts.encoding(*r.shared.value)
    ddl = "doc_id long, text string, source string, lang string, op string, seq int"
    rnd, now = random.Random(2), {}
    for batch in range(7):
        rows = []
        for i in rnd.sample([None, *range(12)], 6):
            op = rnd.choice(("insert", "revise", "delete"))
            rows += [(i, prose(rnd.randint(0, 9), rnd), rnd.choice(("a", "b", None)), "en", op, batch)] * rnd.randint(1, 2)
            now.pop(i, None) if op == "delete" else now.__setitem__(i, (rows[-1][2], "en", token_counts.count(rows[-1][1], enc)))
        assert r.commit(f"b{batch}", spark.createDataFrame(rows, ddl))
        want = Counter()
        for s, lang, k in now.values():
            want[s, lang, "docs"] += 1
            want[s, lang, "tokens"] += k
        got = {}
        for x in r.totals().collect():
            got |= {(x.source, x.lang, "docs"): x.docs, (x.source, x.lang, "tokens"): x.tokens}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        if batch == 4:
            (tmp_path / "s" / "_snapshots" / "broken" / "docs").mkdir(parents=True)
    assert len(r._snapshot()[1]) >= 4 and not r.commit("b0", spark.createDataFrame([(1, "x", "a", "en", "insert", 9)], ddl))


def test_token_counts_query_equals_brute_force(spark, tmp_path):
    from tickloom.llm import queries

    rows = [(i, prose(5 + i % 7).replace(" ", "  " if i % 3 else "\n"), f"s{i % 2}") for i in range(40)]
    rows += [(100 + i, rows[i][1], "s9") for i in range(0, 40, 4)] + [(200, None), (201, ""), (202, " \t ")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ranks, pattern = token_counts.default_tokenizer()
    enc = token_counts.encoding(open(ranks, "rb").read(), pattern)
    want, seen = {}, set()
    for r in rows:
        if r[1] is not None and r[1] in seen:
            continue
        seen.add(r[1])
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "").strip(" ")
        key = (r[2] if len(r) > 2 else "a", "en")
        d, n = want.get(key, (0, 0))
        want[key] = (d + 1, n + token_counts.count(t, enc))
    assert {(x.source, x.lang): (x.docs, x.tokens) for x in queries.op1_token_counts(spark, str(tmp_path)).collect()} == want


def test_long_texts_count_alike():
    ranks, pattern = token_counts.default_tokenizer()
    enc = token_counts.encoding(open(ranks, "rb").read(), pattern)
    t = prose(40_000) + "  \n\n  " + prose(100)
    assert token_counts.count(t, enc) == len(enc.encode_ordinary(t))


def test_tiles_of_repeated_words_are_the_same_and_take_no_product():
    r = random.Random(3)
    ids = lambda w: np.array([hash((x, 7)) & 0xFFFFFFFFFFFFFFFF for x in w], np.uint64)
    found = 0
    for _ in range(600):
        few, least = r.choice((1, 2, 3, 8)), r.choice((1, 2, 3, 5))
        a, b = (ids(r.randint(0, few) for _ in range(r.randint(least, n))) for n in (40, 70))
        own, far = (common.shingle_hashes(x, least) for x in (a, b))
        runs = decontaminate._by_runs(len(a), len(b), decontaminate._place(own), far, np.flatnonzero(np.isin(far, own)), least)
        assert sorted(runs) == sorted(decontaminate._by_length(a, b, least))
        found += len(runs)
    assert found > 1000
    a, b = (ids(r.choice("ab") for _ in range(12_000)) for _ in range(2))
    began = time.perf_counter()
    assert sum(t[2] for t in decontaminate.tiles(a, b)) > 9000 and time.perf_counter() - began < 20
