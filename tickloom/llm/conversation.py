"""Conversation structure repair: the cheapest edits that give roles (s?(ua)+)?, of equal ones the ASCII-least, and the turns they leave.

Costs to go are computed backwards over turns and grammar state; then a walk forwards takes at each turn the least letter among edits that
keep to the cost. Turns stand in order by turn (nulls first), role and the text's SHA-256. For long conversations the order is cut into blocks
of BLOCK turns: a block is a min-plus matrix over grammar states (in parallel), the matrices give the costs at each block's end, and each block
is then walked from every state (in parallel); what passes through one task a conversation is a row a block. Texts stay out of this. They are
read once more in order, beside their conversation's edits: a SHA-256 over a conversation's text is one sequence, so this is a stream in one task
for each conversation, of which no more than a batch of rows is held.

Defined cases: null roles and texts are one space; a null conversation is one of its own; rows of one turn are ordered as said, rows alike in all
are alike in any order; a role whose first character is not s, u or a (or that has none) cannot be kept; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, blank_trim

BLOCK = 4096
RESET, DELETE, INSERT, REROLE, CUT = 1 << 30, 3, 2, 2, 1
#: Grammar states: nothing yet, after s, after u, after a. What an insert leads to, and its role; what a role's kind leads to where it may stand.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT, ROLE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U), ("user", "user", "assistant", "user")
KINDS = "sua"
STANDS = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_A, 1): AFTER_U, (AFTER_U, 2): AFTER_A}
#: Costs to go when no turn is left, and the letters.
END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LEGAL = ((0, 1), (1, 2), (2, 1))

Vector = tuple[int, ...]
_BACK: dict[tuple[int, Vector], Vector] = {}
_WALK: dict[tuple[int, int, Vector], tuple[str, int]] = {}


def mark(kind: int, must: bool, cut: bool) -> int:
    """A turn in a byte: kind of role (3: none of them), whether it must be deleted, whether it is truncated."""
    return kind | must << 2 | cut << 3


def _takes(m: int, g: int) -> list[tuple[str, int, int]]:
    """Edits that take the turn in a state: letter, cost, state after; in ASCII order."""
    out = [("D", DELETE, g)]
    if not m & 4:
        cut = CUT * (m >> 3)
        if (g, m & 3) in STANDS:
            out.append(("K", cut, STANDS[g, m & 3]))
        out.append(("R", REROLE + cut, NEXT[g]))
    return out


def back(m: int, v: Vector) -> Vector:
    """Costs to go before a turn, by state, from those after it. Kept by what they differ in, which is bounded."""
    low = min(v)
    key = (m, tuple(min(x - low, RESET) for x in v))
    if key not in _BACK:
        own = [min(c + key[1][h] for _, c, h in _takes(m, g)) for g in range(4)]
        for _ in range(2):
            own = [min(x, INSERT + own[NEXT[g]]) for g, x in enumerate(own)]
        _BACK[key] = tuple(min(x, RESET) for x in own)
    return tuple(min(x + low, RESET) for x in _BACK[key])


def walk(m: int, g: int, v: Vector) -> tuple[str, int]:
    """The edits up to and with the turn, and the state after; v: costs to go after it."""
    low = min(v)
    key = (m, g, tuple(x - low for x in v))
    if key not in _WALK:
        here, out, take = back(m, key[2]), "", None
        while take is None:
            tight = [(x, h) for x, c, h in _takes(m, g) if here[g] == c + key[2][h]]
            if tight and tight[0][0] == "D":
                take = tight[0]
            elif here[g] == INSERT + here[NEXT[g]]:
                out, g = out + "I", NEXT[g]
            else:
                take = tight[0]
        _WALK[key] = (out + take[0], take[1])
    return _WALK[key]


def matrix(marks: bytes) -> list[int]:
    """Least cost through a block from each state to each state, row by row."""
    cols = []
    for e in range(4):
        v: Vector = tuple(0 if g == e else RESET for g in range(4))
        for m in reversed(marks):
            v = back(m, v)
        cols.append(v)
    return [cols[e][g] for g in range(4) for e in range(4)]


def walked(marks: bytes, v: Vector) -> tuple[list[str], list[int]]:
    """From each state: the block's edits and the state after it; v: costs to go after it."""
    after = [v]
    for m in reversed(marks):
        after.append(back(m, after[-1]))
    after.reverse()
    edits, ends = [], []
    for g in range(4):
        out = []
        for i, m in enumerate(marks):
            x, g = walk(m, g, after[i + 1])
            out.append(x)
        edits.append("".join(out))
        ends.append(g)
    return edits, ends


def _stream(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[dict]], ddl: str, kinds: pa.Schema, rows: int = 2000) -> DataFrame:
    """make() over a task's rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for r in make(r for b in batches for s in range(0, b.num_rows, rows) for r in b.slice(s, rows).to_pylist()):
            out.append(r)
            if len(out) >= rows:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    return df.mapInArrow(run, ddl)


def _blocks(rows: Iterator[dict], size: int) -> Iterator[dict]:
    """Rows (conv, turn, role, h, kind, blank, cut, later, m), in order, as blocks; m rows alike are one mark each."""
    held, first, k, illegal = bytearray(), None, 0, 0

    def block() -> dict:
        return {**{c: first[c] for c in ("conv", "turn", "role", "h")}, "k": k, "marks": bytes(held), "matrix": matrix(bytes(held)), "illegal": illegal}

    for r in rows:
        for j in range(r["m"]):
            if held and (first["conv"] != r["conv"] or len(held) >= size):
                yield block()
                held, k, illegal = bytearray(), k + 1, 0
            if not held:
                first = r
            elif (held[-1] & 3, r["kind"]) not in LEGAL:
                illegal += 1
            must = r["blank"] or r["later"] or j > 0
            held.append(mark(r["kind"], must, r["cut"] and not must))
    if held:
        yield block()


def _costs(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks, last first within a conversation, with the costs to go after each and before it."""
    conv, v, seen = None, END, False
    for r in rows:
        if not seen or r["conv"] != conv:
            conv, v, seen = r["conv"], END, True
        m, after = r.pop("matrix"), v
        v = tuple(min(m[4 * g + e] + after[e] for e in range(4)) for g in range(4))
        yield r | {"after": list(after), "cost": v[START]}


def _walks(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        edits, ends = walked(r["marks"], tuple(r.pop("after")))
        marks = r.pop("marks")
        yield r | {"edits": edits, "ends": ends, "first": marks[0] & 3, "last": marks[-1] & 3}


def _audits(rows: Iterator[dict]) -> Iterator[dict]:
    """A row a conversation from its blocks in order."""
    now, g, out, last = None, START, [], 3
    for r in rows:
        if now is None or now["conv"] != r["conv"]:
            if now is not None:
                yield now | {"audit": "".join(out) + TAIL[g]}
            now, g, out, last = {"conv": r["conv"], "cost": r["cost"], "illegal": 0}, START, [], None
        out.append(r["edits"][g])
        now["illegal"] += r["illegal"] + (last is not None and (last, r["first"]) not in LEGAL)
        g, last = r["ends"][g], r["last"]
    if now is not None:
        yield now | {"audit": "".join(out) + TAIL[g]}


def _rebuilt(rows: Iterator[dict]) -> Iterator[dict]:
    """Repaired turns from each conversation's edits followed by its turns in order."""
    conv, audit, at, pos, g = None, "", 0, 0, START

    def added() -> Iterator[dict]:
        nonlocal at, pos, g
        while at < len(audit) and audit[at] == "I":
            yield {"conv_id": conv, "pos": pos, "role": ROLE[g], "text": ""}
            at, pos, g = at + 1, pos + 1, NEXT[g]

    for r in rows:
        if r["audit"] is not None:
            yield from added()
            conv, audit, at, pos, g = r["conv"], r["audit"], 0, 0, START
            continue
        yield from added()
        letter, role = audit[at], r["role"]
        at += 1
        if letter == "D":
            continue
        g, role = (STANDS[g, KINDS.index(role[0])], role) if letter == "K" else (NEXT[g], ROLE[g])
        yield {"conv_id": conv, "pos": pos, "role": role, "text": r["text"]}
        pos += 1
    yield from added()


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of each conversation's `role:text` lines."""
    conv, sha = None, None
    for r in rows:
        if sha is None or r["pos"] == 0:
            if sha is not None:
                yield {"conv": conv, "sha": sha.hexdigest()}
            conv, sha = r["conv_id"], hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
    if sha is not None:
        yield {"conv": conv, "sha": sha.hexdigest()}


_KEY = [("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("h", pa.string()), ("k", pa.int32())]
KEY = "conv long, turn long, role string, h string, k int"
_INTS = pa.list_(pa.int64())


class Repair:
    """The repair of turns (conv_id, turn, role, text): `faults` and `audits`, a row a conversation each, and `turns()`, what is left."""

    def __init__(self, rows: DataFrame, block: int = BLOCK):
        scratch = Scratch(rows.sparkSession, "conversation")
        space = lambda c: F.coalesce(c, F.lit(" "))
        rows = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
        self.rows = rows.withColumn("h", F.sha2("text", 256))
        said = blank_trim(F.col("text"))
        kind = F.when(F.col("role") == "", 3).otherwise(F.coalesce(F.nullif(F.position(F.left("role", F.lit(1)), F.lit(KINDS)), F.lit(0)) - 1, F.lit(3)))
        told = self.rows.select("conv", "turn", "role", "h", kind.cast("int").alias("kind"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(*".!?")).alias("cut"))
        same = ["conv", "turn", "role", "h"]
        told = told.groupBy(*same).agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("kind", "blank", "cut")])
        # The first turn of each (role, text) that comes in several; min over turns with nulls first.
        again = told.groupBy(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("_t"), F.count("*").alias("_n")).where("_n > 1")
        told = told.join(again, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h") == F.col("_h")), "left")
        told = told.withColumn("later", F.col("_n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_t"))).drop("_c", "_r", "_h", "_t", "_n")
        told = scratch.keep(told, "told")
        late = F.when(F.col("later"), F.col("m")).otherwise(F.col("m") - 1)
        count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
        self.faults = told.groupBy("conv").agg(
            count(F.when(F.col("blank"), F.col("m")))("blank"), count(F.when(~F.col("blank"), late))("duplicate"), count(F.when(~F.col("blank") & ~F.col("later") & F.col("cut"), 1))("truncated"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        )
        up = [F.asc_nulls_first(c) for c in same]
        blocks = _stream(told.repartitionByRange(*up).sortWithinPartitions(*up), lambda r: _blocks(r, block), f"{KEY}, marks binary, matrix array<long>, illegal long", pa.schema([*_KEY, ("marks", pa.binary()), ("matrix", _INTS), ("illegal", pa.int64())]))
        down = [F.desc_nulls_last(c) for c in same] + [F.desc("k")]
        costs = _stream(blocks.repartition("conv").sortWithinPartitions(*down), _costs, f"{KEY}, marks binary, illegal long, after array<long>, cost long", pa.schema([*_KEY, ("marks", pa.binary()), ("illegal", pa.int64()), ("after", _INTS), ("cost", pa.int64())]), 200)
        walks = _stream(
            costs.repartition("conv", "turn", "k"), _walks, f"{KEY}, illegal long, cost long, edits array<string>, ends array<long>, first int, last int",
            pa.schema([*_KEY, ("illegal", pa.int64()), ("cost", pa.int64()), ("edits", pa.list_(pa.string())), ("ends", _INTS), ("first", pa.int32()), ("last", pa.int32())]), 200,
        )
        audits = _stream(walks.repartition("conv").sortWithinPartitions(*up, "k"), _audits, "conv long, cost long, illegal long, audit string", pa.schema([("conv", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())]), 200)
        self.audits = scratch.keep(audits, "audits")

    def turns(self) -> DataFrame:
        """Repaired turns (conv_id, pos, role, text); a conversation's are in one task, in order."""
        none = lambda kind: F.lit(None).cast(kind)
        lead = self.audits.select("conv", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("h"), "audit")
        both = lead.unionByName(self.rows.withColumn("audit", none("string")))
        order = ["conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "h"]
        both = both.repartition("conv").sortWithinPartitions(*order).drop("h", "turn")
        return _stream(both, _rebuilt, "conv_id long, pos long, role string, text string", pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def digests(self) -> DataFrame:
        return _stream(self.turns(), _digests, "conv long, sha string", pa.schema([("conv", pa.int64()), ("sha", pa.string())]))


def damaged(rows: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of `conv_id:turn` modulo 20, nulls as one space: 0 gone, 1 empty, 2 without `.!?`, 3 twice, 4 by the user."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn")).cast("binary")) % 20
    text = F.when(n == 1, "").when(n == 2, F.translate(s("text"), ".!?", "")).otherwise(s("text"))
    role = F.when(n == 4, "user").otherwise(s("role"))
    return rows.where(n != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")).drop("_again")


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each conversation of rows: the faults that damaged() left, their repair's cost and edits, and the digest of what is left."""
    done = Repair(damaged(rows), block)
    parts = [rows.select(F.col("conv_id").cast("long").alias("conv")).distinct(), done.faults, done.audits, done.digests()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    most = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs]
    return every.groupBy(F.col("conv").alias("conv_id")).agg(*most, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
