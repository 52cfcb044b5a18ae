"""Conversation repair against a search over all edits, with blocks of a few turns."""

import hashlib
import random
import re
import zlib

import pytest

from tickloom.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if n:
            out += [(c, t, "user" if n == 4 else role, "" if n == 1 else re.sub(r"[.!?]", "", text) if n == 2 else text)] * (2 if n == 3 else 1)
    return out


def best(rows):
    """(cost, edits, lines) by plain recursion over turns: all letters at all states, least by (cost, edits)."""
    seen, marks = set(), []
    for _, _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0d]", text)
        dup = not blank and (role, text) in seen
        seen.add((role, text))
        marks.append((blank, dup, not blank and not dup and re.findall(r"[^\x20\x09-\x0d]", text)[-1] not in ".!?"))
    legal = re.compile(r"(s?(ua)+)?")
    memo = {}

    def go(i, g, spare):
        """g: letters so far that matter (the last two are enough: '', 's', 'u', 'a')."""
        if (i, g, spare) in memo:
            return memo[i, g, spare]
        found = [(0, "", ())] if i == len(rows) and g in ("", "a") else []
        put = "a" if g == "u" else "u"
        name = {"u": "user", "a": "assistant"}[put]
        if spare:
            c, e, x = go(i, put, spare - 1)
            found.append((c + 2, "I" + e, (name + ":", *x)))
        if i < len(rows):
            _, _, role, text = rows[i]
            blank, dup, cut = marks[i]
            c, e, x = go(i + 1, g, 2)
            found.append((c + 3, "D" + e, x))
            if not blank and not dup:
                if role[:1] and (g, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    c, e, x = go(i + 1, role[:1], 2)
                    found.append((c + cut, "K" + e, (f"{role}:{text}", *x)))
                c, e, x = go(i + 1, put, 2)
                found.append((c + 2 + cut, "R" + e, (f"{name}:{text}", *x)))
        memo[i, g, spare] = min(found) if found else (10**9, "", ())
        return memo[i, g, spare]

    cost, edits, lines = go(0, "", 2)
    assert legal.fullmatch("".join(x[0] for x in lines))
    return marks, cost, edits, "\n".join(lines)


def expected(rows):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    out = []
    for c, part in groups.items():
        part.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        marks, cost, edits, text = best(part)
        turns = [r[1] for r in part if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(part, part[1:], strict=False))
        out.append((c, gaps, *(sum(m[k] for m in marks) for k in range(3)), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return out


def made():
    rng = random.Random(5)
    texts = ["Yes.", "no", "Why?", "", " \t\r\n", "ok!", None, "so. ", "\x0b\x0c", "x ", "café.", "a.b"]
    roles = ["user", "assistant", "system", None, "tool", "", "User", "usher"]
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.choice((1, 2, 3, 5, 9, 30))):
            turn = rng.choice((t, t, t, t, t + 3, None, 2))
            rows.append((c, turn, rng.choice(roles[: rng.choice((2, 3, 8))]), rng.choice(texts)))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_edits_are_the_cheapest_and_least(spark, block):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "1 as audit", "2 as h")
    got = conversation.report(df.repartition(5), block).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_turns_are_whole(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Long " * 50_000 + "."), (2, 1, "user", ""), (3, None, "user", "Go.")]
    got = sorted(map(tuple, conversation.Repair(spark.createDataFrame(rows, SCHEMA)).turns().collect()))
    assert got == [(1, 0, "system", "Be kind."), (1, 1, "user", ""), (1, 2, "assistant", "Hello."), (1, 3, "user", "Long " * 50_000 + "."), (1, 4, "assistant", ""), (3, 0, "user", "Go."), (3, 1, "assistant", "")]


def test_empty_tables(spark):
    assert conversation.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_costs_through_blocks_are_those_through_all():
    rng = random.Random(3)
    marks = bytes(conversation.mark(rng.randrange(4), rng.random() < 0.2, rng.random() < 0.3) for _ in range(200))
    v = conversation.END
    for m in reversed(marks):
        v = conversation.back(m, v)
    w = conversation.END
    for a in range(180, -1, -20):
        m = conversation.matrix(marks[a : a + 20])
        w = tuple(min(m[4 * g + e] + w[e] for e in range(4)) for g in range(4))
    assert v == w
