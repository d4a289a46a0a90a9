"""Analytics over the log of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_QUERIES = 10


def searches_since(log: DataFrame, cutoff: Column) -> DataFrame:
    """Search events at or after a time; null times are left out."""
    return log.where((F.col("event") == "search") & F.col("ts").isNotNull() & (F.col("ts") >= cutoff))


def summary(searches: DataFrame) -> DataFrame:
    """One row: (total, zero_results, cache_hits, avg_latency); the mean is of whole milliseconds, whole division, 0 without any.

    zero_results counts only searches that tell their number of results.
    """
    return searches.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("results") == 0).alias("zero_results"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.coalesce(F.expr("sum(cast(latency_ms as bigint)) div nullif(count(latency_ms), 0)"), F.lit(0)).alias("avg_latency"),
    )


def by_type(searches: DataFrame) -> DataFrame:
    return searches.groupBy("query_type").agg(F.count("*").alias("n"))


def top_queries(searches: DataFrame, most: int = TOP_QUERIES) -> DataFrame:
    """Most frequent queries, ties by text."""
    return searches.where("query is not null").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(most)


def zero_result_queries(searches: DataFrame) -> DataFrame:
    """Queries without results and how often; a missing number of results counts as zero here."""
    return searches.where(F.coalesce("results", F.lit(0)) == 0).where("query is not null").groupBy("query").agg(F.count("*").alias("n"))
