"""Vector retrieval: conjunctive filters, exact cosine top-k, weighted re-ranking and scrolling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equality_filter(conditions: dict[str, str | bool]) -> Column:
    """AND of equalities; values that are neither text nor boolean are ignored, no condition matches all."""
    tests = [F.col(k) == F.lit(v) for k, v in conditions.items() if isinstance(v, (str, bool))]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is null, empty, all zero or not finite, or the lengths differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0) & ~F.isnan(norm) & (norm < F.lit(float("inf")))
    return F.when(ok, _dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_literal(v: list[float]) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def top_k(rows: DataFrame, query: Column, k: int, vector: str = "vector", id_col: str = "id", where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query vector by cosine, with `score`; ties go to the lowest id.

    The filter reaches the scan; ordering with a limit keeps k rows per task and merges them.
    """
    kept = rows if where is None else rows.where(where)
    return kept.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def rerank(rows: DataFrame, k: int, weight: str = "retrieval_weight", id_col: str = "id") -> DataFrame:
    """Order by score times weight; ties go to the lowest id."""
    return rows.withColumn(
        "weighted", F.col("score") * F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    ).orderBy(F.desc("weighted"), F.asc(id_col)).limit(k)


def semantic_search(
    rows: DataFrame, query: Column, k: int, vector: str = "vector", weight: str = "retrieval_weight", id_col: str = "id", where: Column | None = None
) -> DataFrame:
    """Twice k by cosine, then k by weighted score: a heavy row outside the first 2k is lost, as intended."""
    return rerank(top_k(rows, query, 2 * k, vector, id_col, where), k, weight, id_col)


def scroll(rows: DataFrame, where: Column, k: int, id_col: str = "id") -> DataFrame:
    """Rows by filter alone, ordered by id."""
    return rows.where(where).orderBy(id_col).limit(k)


def collection_info(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """(points_count, vector_size, n_sizes): rows, and the most frequent vector length with how many lengths occur."""
    sizes = rows.groupBy(F.coalesce(F.array_size(vector), F.lit(0)).alias("n")).count()
    return sizes.agg(
        F.sum("count").alias("points_count"), F.max_by("n", F.struct("count", "n")).cast("bigint").alias("vector_size"), F.count("*").alias("n_sizes")
    )


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page in a given order with `has_more`: one row more than the page is read, in one plan, never all."""
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = ahead.withColumn("_at", F.row_number().over(Window.orderBy(*order)))  # over limit + 1 rows
    return numbered.withColumn("has_more", F.max("_at").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("_at") <= limit).drop("_at")
