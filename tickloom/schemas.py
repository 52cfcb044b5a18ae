"""Event schemas. Readers always get one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NUMBER = "decimal(18,8)"
LEVEL = f"struct<price:{NUMBER},size:{NUMBER}>"
ENVELOPE = "event_id string, event_time timestamp, ingest_time timestamp, source string, exchange_id string, instrument string, sequence_number bigint, schema_version int"


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


TRADE = f"{ENVELOPE}, price {NUMBER}, size {NUMBER}, side string, exchange_trade_id string"
BOOK = f"{ENVELOPE}, bids array<{LEVEL}>, asks array<{LEVEL}>, depth int"
CANDLE = f"{ENVELOPE}, open {NUMBER}, high {NUMBER}, low {NUMBER}, close {NUMBER}, volume {NUMBER}, window_start timestamp, window_end timestamp"
DELTA = f"{ENVELOPE}, order_id string, side string, price double, quantity double, action string"
FEATURE = "event_id string, event_time timestamp, instrument string, feature_name string, feature_version string, value decimal(28,8), values map<string,decimal(28,8)>, window_start timestamp, window_end timestamp, input_count bigint, code_version string"
RAW = "topic string, partition int, offset bigint, timestamp bigint, key string, value binary"
#: What windowed operators read: any trade source projected to these columns.
TICK = f"instrument string, event_id bigint, event_time timestamp, price {NUMBER}, size {NUMBER}, side string, partition int, seq bigint"

TOPICS = {"trade": "events.trade", "book": "events.book.snapshot", "candle": "events.candle", "delta": "events.book.delta"}
FEATURES = ("vwap.1m", "obi", "micro_price", "vpin")
SHAPES = {"trade": TRADE, "book": BOOK, "candle": CANDLE, "delta": DELTA}
