"""Line dedup by content-defined line chunks. DataFrame functions only.

A text is split at line feeds. Each line has a 28-bit hash from its MD5; the rolling hash at a line mixes the hashes of SPAN
lines from it on. Of any two lines in a row the one of the smaller rolling hash (the later, if alike) ends a chunk, so boundaries
depend on nearby lines alone, survive shifts and stand two lines apart at most. A line of ALONE_WORDS words or more is a chunk by
itself: a boundary stands before and after it.

A chunk that occurred before (less doc_id, then text hash, then place) is compared with its first occurrence by its bytes. Where
they are equal, the match grows line by line over SIDE lines on either side, not past one that is alone: what lies beyond is a match
of its own. What then matches is removed if it holds two lines with words or a line of LONG_WORDS words. A removed line always has an equal one
at an earlier place, so the first copy of anything stays.

A repeated passage of over 4 * (ALONE_WORDS - 1) words, so one of 50 words or more, holds a whole chunk whatever its neighbours:
with four lines or fewer one of them is alone; with five or more, the rolling hashes that lie wholly in it set two boundaries. Only
boundaries after its first and its last two lines can depend on neighbours, and SIDE lines reach over those.

Occurrences travel as (hash, document, place) with hashes of the lines beside them, which rule out most short lines that repeat alone; texts move only by document, once to fetch repeated chunks with their neighbours and once to
take lines out (by sort-merge at every size). A chunk in a third of all documents is one row a task after partial aggregation, and its joins can be split.

What is missed: a passage, or an end of it, whose chunks all occurred earlier in other surroundings.

Defined cases: null text stays null, an empty text stays; blank lines are no match by themselves; rows of equal doc_id and text are one
document, decided alike; doc_id null counts as the least id; documents with nothing removed keep their text byte for byte; an empty table gives no rows; other
columns come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, fresh

SPAN, SIDE, ALONE_WORDS, LONG_WORDS = 2, 2, 13, 50
_BLANKS = "' \\t\\r\\n\\u000b\\u000c'"


def _long(line: str, words: int) -> str:
    """SQL: whether a line has that many words. It reads no further than it must."""
    blank = "\\\\x20\\\\x09-\\\\x0D"
    return f"(length({line}) >= {2 * words - 1} and {line} rlike '^[{blank}]*+(?:[^{blank}]++[{blank}]++){{{words - 1}}}[^{blank}]')"


def chunks(text: str = "text") -> str:
    """SQL for struct<ls, ps, cs>: a text's lines, whether each is alone, and its chunks as (s, n): first line and number of lines.

    transform(array(x), v -> ...)[0] binds v to x once. Every step is linear in the text.
    """
    line = f"struct(cast(conv(substring(md5(l), 1, 7), 16, 10) as bigint) as h, {_long('l', ALONE_WORDS)} as p)"
    rolled = " + ".join(f"coalesce(get(hs, i + {k}).h, 0L) * {31 ** (SPAN - 1 - k)}" for k in range(SPAN))
    ends = "hs[i].p or coalesce(get(hs, i + 1).p, true) or rs[i] < rs[i + 1] or coalesce(get(rs, i - 1) >= rs[i], false)"  # no next line: the end
    start = "coalesce(get(es, k - 1) + 1, 0)"
    return (
        f"transform(array(split({text}, '\\n', -1)), ls -> "
        f"transform(array(transform(ls, l -> {line})), hs -> "
        f"transform(array(transform(hs, (x, i) -> ({rolled}) % 1000003)), rs -> "
        f"transform(array(filter(sequence(0, size(hs) - 1), i -> {ends})), es -> "
        f"struct(ls as ls, hs.p as ps, transform(es, (e, k) -> struct({start} as s, e - {start} + 1 as n)) as cs))[0])[0])[0])[0]"
    )


def _lines(c: str) -> str:
    return f"slice(x.ls, {c}.s + 1, {c}.n)"


def _common(a: str, b: str) -> str:
    """SQL: how many lines two arrays have alike from the start."""
    return f"transform(array(array_position(zip_with({a}, {b}, (p, q) -> not (p <=> q)), true)), p -> if(p = 0, size({a}), cast(p - 1 as int)))[0]"


def marked(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """(_id, _h, gone: the lines' numbers, in order) of the documents that lose lines, and the scratch that holds it. _id and _h name a row of docs: (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    d = docs.where(f"text is not null and (instr(text, '\\n') > 0 or length(text) >= {2 * LONG_WORDS - 1})").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    # A chunk that would not go by itself goes only if a line beside it is like that beside its first occurrence: told by hashes of these lines, before any text moves.
    own, line = _lines("c"), lambda i: f"xxhash64(get(x.ls, {i}))"
    big = f"size(filter(v, l -> btrim(l, {_BLANKS}) <> '')) >= 2 or exists(v, l -> {_long('l', LONG_WORDS)})"
    key = f"if(btrim(array_join(v, '\n'), {_BLANKS}) <> '', unhex(md5(array_join(v, '\n'))), null) as key"
    beside = f"if(c.s > 0, {line('c.s - 1')}, null) as above, if(c.s + c.n < size(x.ls), {line('c.s + c.n')}, null) as under"
    keyed = f"transform(array({chunks()}), x -> transform(x.cs, (c, i) -> transform(array({own}), v -> struct(i as at, {key}, {big} as big, {beside}))[0]))[0]"
    occ = d.select("_id", "_h", F.explode(F.expr(keyed)).alias("m")).select("_id", "_h", "m.*").where("key is not null")
    occ = scratch.keep(occ.distinct(), "places")
    first = occ.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_h", "at", "above", "under")).alias("f")).where("n > 1").select("key", "f")
    rep = occ.join(first, "key").where("not (_id <=> f._id and _h = f._h and at = f.at) and (big or above = f.above or under = f.under)")
    rep = scratch.keep(rep.select("_id", "_h", "at", "key", F.col("f._id").alias("fi"), F.col("f._h").alias("fh"), F.col("f.at").alias("fa")), "repeated")
    # Places, with those of the first occurrences they are compared with, gathered by document, fetch the chunks and the lines beside them.
    firsts = rep.select(F.col("fi").alias("_id"), F.col("fh").alias("_h"), F.col("fa").alias("at"), "key").distinct().withColumn("first", F.lit(True))
    places = rep.select("_id", "_h", "at", "key").withColumn("first", F.lit(False)).unionByName(firsts)
    wanted = places.groupBy("_id", "_h").agg(F.collect_list(F.struct("at", "key", "first")).alias("w")).hint("merge").withColumnsRenamed({"_id": "_i", "_h": "_g"})
    one = d.join(wanted, d["_id"].eqNullSafe(wanted["_i"]) & (d["_h"] == wanted["_g"])).drop("_i", "_g")
    far = lambda i: f"if(coalesce(get(x.ps, {i}), false), 1, {SIDE})"
    prev = f"transform(array(least(c.s, {far('c.s - 1')})), k -> reverse(slice(x.ls, c.s - k + 1, k)))[0]"
    near = f"transform(array(x.cs[y.at]), c -> struct({prev} as prev, slice(x.ls, c.s + c.n + 1, {far('c.s + c.n')}) as next))[0] as near"
    got = one.select("_id", "_h", F.explode(F.expr(f"transform(array({chunks()}), x -> transform(w, y -> struct(y.key as key, y.first as first, x.cs[y.at].s as s, {_lines('x.cs[y.at]')} as own, {near})))[0]")).alias("m"))
    got = got.select("_id", "_h", "m.key", "m.first", "m.s", "m.own", "m.near.prev", "m.near.next")
    got = scratch.keep(got, "chunks")
    del occ, first, rep, firsts, places, wanted, one
    scratch.drop("places")
    scratch.drop("repeated")
    scratch.free()
    kept = got.where("first").groupBy("key").agg(F.min(F.struct("own", "prev", "next")).alias("k"))
    met = got.where("not first").join(kept, "key").where("own = k.own").withColumns({"back": F.expr(_common("prev", "k.prev")), "on": F.expr(_common("next", "k.next"))})
    run = met.withColumn("run", F.expr("concat(slice(prev, 1, back), own, slice(next, 1, on))"))
    run = run.where(f"size(filter(run, l -> btrim(l, {_BLANKS}) <> '')) >= 2 or exists(run, l -> {_long('l', LONG_WORDS)})")
    gone = run.groupBy("_id", "_h").agg(F.collect_list(F.expr("sequence(s - back, s + size(own) - 1 + on)")).alias("g"))  # at most 1 + 2 * SIDE times the document's lines
    gone = gone.select("_id", "_h", F.array_sort(F.array_distinct(F.flatten("g"))).alias("gone"))
    gone = scratch.keep(gone, "gone")
    del got, kept, met, run
    scratch.drop("chunks")
    scratch.free()
    return gone.hint("merge"), scratch


def _left(gone: str, text: str) -> Column:
    """What is left of a text without its lines `gone` (numbers in order): the stretches between them. Linear in the text."""
    before, after = f"if(k = 0, -1, {gone}[k - 1])", f"if(k = size({gone}), size(ls), {gone}[k])"
    stretch = f"slice(ls, {before} + 2, {after} - {before} - 1)"
    return F.expr(f"transform(array(split({text}, '\\n', -1)), ls -> array_join(flatten(transform(sequence(0, size({gone})), k -> {stretch})), '\\n'))[0]")


def _with_gone(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, the numbers of the lines to remove (null: none), and its name."""
    marks, _ = marked(docs.select("doc_id", "text"))
    i, h, gone = fresh(docs.columns, "_id", "_h", "_gone")
    g = marks.select(F.col("_id").alias(i), F.col("_h").alias(h), F.col("gone").alias(gone))
    return docs.join(g, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left").drop(i, h), gone


def dedup(docs: DataFrame, chars: str | None = None) -> DataFrame:
    """docs with repeated passages taken out of text. `chars` names a column that counts the text's characters: it follows where lines went."""
    full, gone = _with_gone(docs)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_left(f"`{gone}`", "text"))
    new = {"text": text}
    if chars:
        new[chars] = F.when(F.col(gone).isNull(), F.col(chars)).otherwise(F.length(text).cast(docs.schema[chars].dataType))
    return full.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed lines, and the characters and digest of what is left, for each row of docs."""
    full, gone = _with_gone(docs.select("doc_id", "text"))
    full = full.withColumn("kept", F.when(F.col(gone).isNull(), F.col("text")).otherwise(_left(gone, "text")))
    return full.select("doc_id", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))
