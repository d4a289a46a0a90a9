"""Incremental maintenance: changed files by hash, upserts, tombstones, versions and stale marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import materialize


def changed_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files of `current` (repo, path, hash) that `indexed` lacks or holds with another hash; null hashes count as changed."""
    known = indexed.where("hash is not null and hash <> ''").select("repo", "path", "hash").distinct()
    return current.join(known, ["repo", "path", "hash"], "left_anti")


def removed_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Indexed files that are gone."""
    return indexed.select("repo", "path").distinct().join(current.select("repo", "path"), ["repo", "path"], "left_anti")


def upsert_chunks(old: DataFrame, new: DataFrame, reindexed: DataFrame) -> DataFrame:
    """The next snapshot of chunks: of re-indexed or removed files (repo, file_path) only new chunks stay; ids are unique, the one indexed last wins."""
    kept = old.join(reindexed.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
    rows = kept.unionByName(new, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "indexed_at").alias("x")).select("id", "x.*")


def index_versions(events: DataFrame) -> DataFrame:
    """(repo, version): number of index and invalidation events of each repository."""
    return events.groupBy("repo").agg(F.count("*").alias("version"))


def stale_files(indexed: DataFrame, marks: DataFrame) -> DataFrame:
    """Indexed files marked stale at or after they were indexed; marks are consumed by indexing again."""
    last = marks.groupBy("repo", "path").agg(F.max("ts").alias("ts"))
    return indexed.join(last, ["repo", "path"]).where("ts >= last_indexed").select("repo", "path", "ts")


def write_snapshot(df: DataFrame, name: str) -> DataFrame:
    """Write a table version to the shared folder and read it back."""
    return materialize(df, name)
