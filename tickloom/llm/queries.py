"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken in before their language is known, all revised (language known, blanks in a row made one), then later copies of a text deleted."""
    from pyspark.sql import functions as F

    from tickloom.llm import token_counts
    from tickloom.llm.common import BLANK_CLASS, Scratch

    rollup = token_counts.Rollup(spark, f"{Scratch(spark, 'token-counts').root}/state")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    change = lambda d, op, seq: d.withColumns({"op": F.lit(op), "seq": F.lit(seq)})
    load = change(docs.withColumn("lang", F.lit(None).cast("string")), "insert", 0)
    revise = change(docs.withColumn("text", F.trim(F.regexp_replace("text", BLANK_CLASS, " "))), "revise", 1)
    first = docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first"))
    copies = docs.select("doc_id", F.sha2("text", 256).alias("key")).join(first, "key").where("doc_id > first")
    delete = change(copies.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("text", "source", "lang")]), "delete", 2)
    for name, changes in (("load", load), ("revise", revise), ("delete", delete)):
        rollup.commit(name, changes)
    rollup.commit("revise", revise)  # the same batch again changes nothing
    return rollup.totals()


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tickloom.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import ngram_join

    return ngram_join.groups(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import license_scan

    return license_scan.report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import conversation

    return conversation.report(table(spark, sf_dir, "conversations"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import merkle

    return merkle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from tickloom.llm import oracles

    return oracles.SQL
