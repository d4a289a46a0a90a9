"""The index pipeline as one composition of DataFrames: parse, chunk, patterns, guides, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.scalar import embedding_text
from srcatlas.operators import chunking, embedding, graph, markdown, parsing, patterns
from srcatlas.session import materialize, tasks_for


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    relationships: DataFrame
    chunks: DataFrame
    errors: DataFrame

    def counters(self) -> DataFrame:
        """(name, n): files, chunks and errors of the run."""
        parts = [t.select(F.lit(name).alias("name")) for name, t in (("files", self.files), ("chunks", self.chunks), ("errors", self.errors))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.count("*").alias("n"))


def build_index(source_files: DataFrame, indexed_at: str, with_vectors: bool = False, large_class: int = chunking.LARGE_CLASS) -> Index:
    """Everything an index run makes of source_files(repo, path, content).

    Of several versions of a path the one with the largest SHA-256 counts, unless a column `version` orders them. The parse result is written once to the shared folder and used by every branch.
    Guides are indexed whether or not there is code; secrets are redacted in every chunk.
    """
    spark = source_files.sparkSession
    order = F.col("version") if "version" in source_files.columns else F.lit(0)
    once = source_files.where("repo is not null and path is not null").groupBy("repo", "path").agg(
        F.max_by("content", F.struct(order, F.sha2("content", 256))).alias("content")
    )
    when = F.lit(indexed_at).cast("timestamp")
    files = once.select(
        "repo",
        "path",
        F.sha2("content", 256).alias("hash"),
        when.alias("last_indexed"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.substring_index("path", "/", 1).alias("module_root"),
    )
    parsed = materialize(parsing.parse_files(once.repartition(tasks_for(spark))), "parsed")
    ids = F.xxhash64("repo", "file_path", "symbol_name", "start_line")
    symbols = parsing.file_symbols(parsed).withColumn("symbol_id", ids).withColumn("indexed_at", when).withColumn(
        "deleted_at", F.lit(None).cast("timestamp")
    )
    relationships = parsing.file_relations(parsed).withColumn(
        "rel_id", F.xxhash64("repo", "source_file", "kind", "source_name", "source_line", "target_path", "target_name")
    ).withColumn("indexed_at", when)
    code = chunking.hierarchical_chunks(symbols, large_class)
    found = patterns.detect_patterns(symbols)
    guides = markdown.guide_chunks(markdown.guide_documents(once.select("repo", "path", F.decode("content", "UTF-8").alias("text"))))
    chunks = patterns.mark_pattern_members(code, found).unionByName(
        patterns.pattern_chunks(found), allowMissingColumns=True
    ).unionByName(guides, allowMissingColumns=True).withColumn("indexed_at", when)
    if with_vectors:
        chunks = embedding.embed_chunks(chunks, embedding_text(F.col("context_header"), F.col("docstring"), F.col("content")))
    return Index(files, symbols, relationships, chunks, parsing.parse_errors(parsed))


def index_edges(index: Index) -> DataFrame:
    return graph.all_edges(index.relationships, index.files, index.symbols)
