"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, mixing. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from tickloom.llm.common import Scratch, blank_trim, fresh, table, text_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below 0.5; the lexicon is learned from the labels of the documents given.

    Null and empty texts score as having no term; repeated rows are scored alike; without labels a seed lexicon decides; all columns come through.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated passages taken out; n_chars follows where a text changed.

    Null and empty texts stay as they are; rows alike in doc_id and text lose the same; a null doc_id is the least one.
    """
    return line_dedup.dedup(docs, "n_chars" if "n_chars" in docs.columns else None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by five-word shingles at 0.8 or more; rows without words all stay.

    It is the row of least doc_id, then text hash, then other columns. Rows of a null doc_id come last, link with equal sets only and are one group by them.
    """
    null, at, own, n = fresh(docs.columns, "_null", "_id", "_h", "_n")
    key = lambda h: {null: F.col("doc_id").isNull(), at: F.coalesce("doc_id", F.lit(0)), own: h}
    kept = ngram_join.representatives(docs.select("doc_id", "text"), k=5, num=4, den=5).withColumns(key(F.col("h"))).select(null, at, own)
    words = blank_trim(F.coalesce("text", F.lit(""))) != ""
    by = [null, at, own]
    others = [f"`{c}`" for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    order = W.partitionBy(*by).orderBy(*others, own)
    one = docs.where(words).withColumns(key(text_key())).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return one.join(kept, by, "left_semi").select(*docs.columns).unionByName(docs.where(~words))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item enough. Null and blank texts cover none; repeated rows are decided alike; all columns come through."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document left: null and blank texts take nothing, repeated rows are documents of their own, a null doc_id is the first."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The stages learn, tile strings and follow links, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
