"""Feature tables and raw logs at rest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.functions.exact import path_segment, table_name, topic

HOUR = ("instrument", "year", "month", "day", "hour")


def by_hour(df: DataFrame, time: str = "window_start") -> DataFrame:
    """Partition columns from each row, not from a batch's first."""
    return df.withColumns({"year": F.year(time), "month": F.lpad(F.month(time).cast("string"), 2, "0"), "day": F.lpad(F.dayofmonth(time).cast("string"), 2, "0"), "hour": F.lpad(F.hour(time).cast("string"), 2, "0")})


def feature_files(df: DataFrame) -> DataFrame:
    """Long-form features with the columns their folders are named by."""
    d = by_hour(df.withColumn("topic", topic(F.col("feature_name"), F.col("feature_version"))).drop("feature_name", "feature_version"))
    return d.withColumn("instrument", path_segment(F.col("instrument")))


@dataclass(frozen=True)
class Written:
    """Where a write landed, how many rows it has, and by which sink."""

    location: str
    rows: int
    sink: str


def write_features(df: DataFrame, root: str, mode: str = "append") -> Written:
    """Long-form features under root/<topic>/instrument=/year=/month=/day=/hour=; tasks write ranges of (topic, instrument, time), so few files a folder and no task a hot instrument."""
    seen = Observation()
    out = feature_files(df).repartitionByRange("topic", "instrument", "window_start").observe(seen, F.count("*").alias("rows"))
    out.write.mode(mode).option("compression", "snappy").partitionBy("topic", *HOUR).parquet(root)
    return Written(root, seen.get["rows"], "parquet")


def save_tables(df: DataFrame, names: list[str], root: str, database: str = "default") -> list[Written]:
    """Append each feature to its own table, made when missing; one write for all, each table being a folder of it."""
    spark, tables, seen = df.sparkSession, {n: "features_" + re.sub("[.-]", "_", n.lower()) for n in names}, Observation()
    named = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair])
    out = df.where(F.col("feature_name").isin(*names)).withColumn("table", named[F.col("feature_name")])
    out = out.repartitionByRange("table", "instrument", "window_start").observe(seen, *[F.count_if(F.col("table") == t).alias(t) for t in tables.values()])
    out.write.mode("append").partitionBy("table").parquet(root)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    for t in tables.values():
        spark.sql(f"create table if not exists {database}.{t} ({columns}) using parquet location '{root}/table={t}'")
        spark.sql(f"refresh table {database}.{t}")
    return [Written(f"{database}.{t}", seen.get[t], "tables") for t in tables.values()]


def checked_topic(prefix: str, name: Column, version: Column) -> Column:
    """A feature's topic; an error for any outside the prefix."""
    t = topic(name, version)
    return F.when(t.startswith(prefix), t).otherwise(F.raise_error(F.concat(F.lit("topic outside prefix: "), t)))


#: JSON as it is defined, but for keys: repeated ones are allowed, the last counts.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def raw_lines(records: DataFrame) -> DataFrame:
    """Raw records (topic, partition, offset, timestamp, key, value binary) as log lines: a JSON object is embedded as it is, anything else as base64.

    Numbers keep their digits, for the value's own text is used, line breaks between its tokens as blanks. Null values go under _unknown; what is no JSON
    object, or not UTF-8, under _unparsed. A source or symbol that is no text is unknown. A null key is written as null.
    """
    text = F.try_validate_utf8(F.col("value").cast("string"))
    # In brackets, so that anything after the object makes the text no array of one. A line break within a string is no JSON, so those left are between tokens.
    records = records.withColumn("_text", text).withColumn("_all", F.from_json(F.concat(F.lit("["), F.col("_text"), F.lit("]")), "array<string>", STRICT))
    whole = F.coalesce((F.size("_all") == 1) & F.ltrim("_text", F.lit(" \t\r\n")).startswith("{"), F.lit(False))
    records = records.withColumns({"_whole": whole, "_to": F.from_json("_text", "source variant, instrument struct<symbol: variant>", STRICT), "_flat": F.translate("_text", "\r\n", "  ")})
    head = F.to_json(F.struct("topic", "partition", "offset", "timestamp", "key"), {"ignoreNullFields": "false"})
    cut = F.substring(head, F.lit(1), F.length(head) - 1)
    line = F.when(F.col("value").isNull(), F.concat(cut, F.lit(',"value":null}'))).when(F.col("_whole"), F.concat(cut, F.lit(',"value":'), F.col("_flat"), F.lit("}"))).otherwise(F.concat(cut, F.lit(',"valueBase64":"'), F.translate(F.base64("value"), "\r\n", ""), F.lit('"}')))
    said = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    at = lambda c: F.when(F.col("value").isNull(), "_unknown").when(~F.col("_whole"), "_unparsed").otherwise(path_segment(said(F.col(c))))
    t = F.timestamp_millis("timestamp")
    return by_hour(records.select("topic", "partition", "offset", "timestamp", line.alias("line"), at("_to.source").alias("source"), at("_to.instrument.symbol").alias("instrument"), t.alias("_t")), "_t").drop("_t")


def write_raw(records: DataFrame, root: str) -> None:
    """Gzip lines by topic, source, instrument and hour, in ranges by offset, ordered within a file."""
    order = ("topic", "source", *HOUR, "partition", "offset")
    d = raw_lines(records).repartitionByRange(*order).sortWithinPartitions(*order)
    d.drop("partition", "offset", "timestamp").write.mode("append").option("compression", "gzip").partitionBy("topic", "source", *HOUR).text(root)


def raw_groups(records: DataFrame) -> DataFrame:
    """Per file group: first and last offset, rows, rows that did not parse, and the key their object would have."""
    d = raw_lines(records)
    g = d.groupBy("topic", "partition", "source", *HOUR).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("records"), F.sum((F.col("source") == "_unparsed").cast("bigint")).alias("unparsed"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    return g.withColumn("object_key", F.concat_ws("/", path_segment(F.col("topic")), "source", "instrument", F.col("year").cast("string"), "month", "day", "hour", F.concat(F.lit("p"), F.col("partition").cast("string"), F.lit("-"), pad("first_offset"), F.lit("-"), pad("last_offset"), F.lit(".jsonl.gz"))))
