"""The log of searches and index runs as JSON lines."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "ts string, event string, query string, query_type string, results bigint, latency_ms double, cache_hit boolean, file string, suggestions bigint, confidence double, was_suggested boolean, repo string, files_changed bigint, chunks_updated bigint, operation string, message string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events with `ts` as a timestamp; lines that are no JSON, or without a valid time, are skipped. A missing file is an error."""
    raw = spark.read.schema(FIELDS).json(path)
    return raw.withColumn("ts", F.try_to_timestamp("ts")).where("ts is not null")


def append_event(path: str, event: str, **fields) -> None:
    """One line with time and event; a field of the caller may replace either."""
    line = {"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "event": event} | fields
    with open(path, "a") as f:
        f.write(json.dumps(line) + "\n")


def append_events(events: DataFrame, path: str) -> None:
    """Many events at once."""
    events.write.mode("append").json(path)
