"""Continuous refresh: arriving file versions are compared with the indexed state and changed ones are parsed again.

A file stream with checkpoints replaces a poll loop. State is a log of changes, one part per batch, in buckets by a hash of
the key: a batch reads the buckets it touches and writes what changed, never the whole state. A restart repeats the last batch
and overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcatlas.operators import parsing
from srcatlas.session import tasks_for
from srcatlas.sources.repo_files import git_head, read_tree

BUCKETS = 64
STATE_SCHEMA = "repo string, path string, hash string, deleted boolean, v bigint, bucket int"
HEAD_SCHEMA = "repo string, head string, v bigint"


def _prepare(spark: SparkSession, folder: str) -> None:
    """Give a new log its folders."""
    for name, schema in (("state", STATE_SCHEMA), ("heads", HEAD_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/state")


def _current(log: DataFrame) -> DataFrame:
    """(repo, path, hash, deleted, v) of each file, by the last batch that changed it."""
    return log.groupBy("repo", "path").agg(F.max(F.struct("v", "hash", "deleted")).alias("s")).select("repo", "path", "s.hash", "s.deleted", "s.v")


def apply_batch(arrived: DataFrame, folder: str, batch: int, order: str | None = None) -> None:
    """Take in one batch of arrived(repo, path, content and optionally deleted, and the column `order` names).

    Of several versions of a file in one batch the last by `order` counts (ties, and without `order` all: by the hash of the
    content); later batches replace earlier ones. A row with `deleted` removes the file. Rows without repo or path are left
    out; null content counts as an empty file. Unchanged files cost one hash comparison.
    """
    spark = arrived.sparkSession
    rows = arrived.where("repo is not null and path is not null")
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in arrived.columns else F.lit(False)
    rows = rows.select(
        "repo",
        "path",
        "content",
        gone.alias("deleted"),
        F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"),
        (F.col(order) if order else F.lit(0)).alias("_order"),
    )
    last = rows.groupBy("repo", "path").agg(F.max(F.struct("_order", "deleted", "hash")).alias("n")).select(
        "repo", "path", "n.hash", "n.deleted", F.pmod(F.xxhash64("repo", "path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    )
    touched = [r[0] for r in last.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    before = _current(_log(spark, folder).where(F.col("bucket").isin(touched) & (F.col("v") < batch))).select(
        "repo", "path", F.col("hash").alias("old"), F.col("deleted").alias("was_deleted")
    )
    same = (F.col("old") == F.col("hash")) & (F.col("was_deleted") == F.col("deleted"))
    changed = last.join(before, ["repo", "path"], "left").where(~F.coalesce(same, F.lit(False))).select("repo", "path", "hash", "deleted", "bucket")
    contents = rows.where("not deleted").join(changed.where("not deleted").select("repo", "path", "hash"), ["repo", "path", "hash"], "left_semi").dropDuplicates(["repo", "path", "hash"])  # of equal hashes, contents are equal
    parsed = parsing.parse_files(contents.select("repo", "path", "content").repartition(tasks_for(spark)))
    parsing.file_symbols(parsed).write.mode("overwrite").parquet(f"{folder}/symbols/v={batch}")
    changed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/v={batch}")


def refresh_stream(arriving: DataFrame, folder: str, once: bool = True, interval: str = "60 seconds", order: str | None = None) -> StreamingQuery:
    """Start refreshing from a stream of (repo, path, content); `once` handles what is there and ends."""
    _prepare(arriving.sparkSession, folder)
    w = arriving.writeStream.foreachBatch(
        lambda rows, batch: apply_batch(rows, folder, batch, order)
    ).option("checkpointLocation", f"{folder}/checkpoint")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def refreshed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of all files as they are now, with the batch they came in: those of each file's last batch, none of files that were emptied or deleted."""
    now = _current(_log(spark, folder)).where("not deleted").select("repo", F.col("path").alias("file_path"), "v")
    return spark.read.parquet(f"{folder}/symbols").join(now, ["repo", "file_path", "v"], "left_semi").withColumnRenamed("v", "batch")


def refreshed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, hash) of the files as they are now."""
    return _current(_log(spark, folder)).where("not deleted").select("repo", "path", "hash")


def sync_repositories(
    spark: SparkSession, roots: dict[str, str], folder: str, includes: list[str] | None = None, excludes: list[str] | None = None
) -> list[str]:
    """Take in the repositories (name -> folder) whose HEAD is not the one seen last; the names of these.

    What a changed repository no longer holds is deleted. The HEADs seen are kept beside the state, so a restart goes on
    from them; they are written last, so an interrupted run is repeated. One row per repository reaches the driver.
    """
    _prepare(spark, folder)
    heads = spark.read.schema(HEAD_SCHEMA).parquet(f"{folder}/heads")
    known = {r["repo"]: r["head"] for r in heads.groupBy("repo").agg(F.max_by("head", "v").alias("head")).collect()}
    now = {repo: git_head(root) for repo, root in roots.items()}
    changed = sorted(repo for repo, head in now.items() if known.get(repo) != head)
    if not changed:
        return []
    batch = (_log(spark, folder).agg(F.max("v")).head()[0] or 0) + 1
    arrived = None
    for repo in changed:
        tree = read_tree(spark, roots[repo], repo, includes, excludes).where("error is null").select("repo", "path", "content")
        arrived = tree if arrived is None else arrived.unionByName(tree)
    missing = refreshed_files(spark, folder).where(F.col("repo").isin(changed)).select("repo", "path").join(
        arrived.select("repo", "path"), ["repo", "path"], "left_anti"
    )
    arrived = arrived.withColumn("deleted", F.lit(False)).unionByName(
        missing.select("repo", "path", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("deleted"))
    )
    apply_batch(arrived, folder, batch)
    spark.createDataFrame([(repo, now[repo], batch) for repo in changed], HEAD_SCHEMA).write.mode("append").parquet(f"{folder}/heads")
    return changed
