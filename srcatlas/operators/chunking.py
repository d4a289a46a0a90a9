"""Chunks from symbols: flat, hierarchical and summaries of large classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions import scalar as S
from srcatlas.operators import redaction

#: A class with more members than this gets a summary chunk.
LARGE_CLASS = 50

CHUNK_COLUMNS = [
    "id",
    "repo",
    "file_path",
    "start_line",
    "end_line",
    "chunk_type",
    "kind",
    "module_path",
    "module_root",
    "submodule",
    "symbol_name",
    "heading_path",
    "content",
    "context_header",
    "signature",
    "docstring",
    "is_test",
    "retrieval_weight",
    "has_secrets",
]


def _chunk(s: DataFrame, kind: Column, name: Column, content: Column, header: Column, signature: Column, id_name: Column | None = None) -> DataFrame:
    module, path = S.module_of_path(F.col("file_path")), F.col("file_path")
    return s.select(
        S.chunk_id(F.col("repo"), path, name if id_name is None else id_name, F.col("start_line")).alias("id"), "repo", "file_path", "start_line", "end_line", F.lit("code").alias("chunk_type"), kind.alias("kind"),
        module.alias("module_path"), S.module_root_of(module).alias("module_root"), S.module_rest_of(module).alias("submodule"), name.alias("symbol_name"), F.lit("").alias("heading_path"),
        redaction.redact(content).alias("content"), header.alias("context_header"), signature.alias("signature"), F.coalesce("docstring", F.lit("")).alias("docstring"),
        S.is_test_file(path).alias("is_test"), S.retrieval_weight(path).cast("float").alias("retrieval_weight"), redaction.has_secrets(content).alias("has_secrets"),
    )


def flat_chunks(symbols: DataFrame) -> DataFrame:
    """One chunk per symbol. Null parents and texts count as empty; secrets are redacted."""
    s = symbols
    header = F.when(F.col("kind") == "method", S.context_header(F.col("file_path"), F.col("parent"), False)).otherwise(F.lit(""))
    return _chunk(
        s, F.col("kind"), F.coalesce("symbol_name", F.lit("")), F.coalesce("content", F.lit("")), header, F.coalesce("signature", F.lit(""))
    )


def hierarchical_chunks(symbols: DataFrame, large_class: int = LARGE_CLASS) -> DataFrame:
    """Top-level symbols and the methods of top-level classes.

    A class with more than `large_class` members becomes a summary (kind class_summary) with its members' names in source
    order; smaller ones keep their text. Nested functions, whose parent is no top-level class of the file, are dropped. Two
    classes of one name in a file share their methods, which are then given once.
    """
    s = symbols.withColumn("parent", F.coalesce("parent", F.lit(""))).withColumn("symbol_name", F.coalesce("symbol_name", F.lit("")))
    file_key = ["repo", "file_path"]
    members = s.where("parent <> ''").groupBy(*file_key, F.col("parent").alias("symbol_name")).agg(
        F.count("*").alias("n_members"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbol_id", F.col("symbol_name").alias("n")))), lambda x: x["n"]), ", "
        ).alias("names"),
    )
    top = s.where("parent = ''").join(members, [*file_key, "symbol_name"], "left")
    is_class, big = F.col("kind") == "class", F.coalesce(F.col("n_members"), F.lit(0)) > large_class
    doc = F.coalesce("docstring", F.lit(""))
    summary = F.concat(
        F.lit("class "),
        F.col("symbol_name"),
        F.lit(":\n"),
        F.when(doc != "", F.concat(F.lit('    """'), doc, F.lit('"""\n\n'))).otherwise(F.lit("")),
        F.lit("    Methods: "),
        F.coalesce("names", F.lit("")),
    )
    kind = F.when(is_class & big, "class_summary").otherwise(F.col("kind"))
    content = F.when(is_class & big, summary).otherwise(F.coalesce("content", F.lit("")))
    id_name = F.when(is_class & big, F.concat(F.col("symbol_name"), F.lit("_summary"))).otherwise(F.col("symbol_name"))
    tops = _chunk(
        top, kind, F.col("symbol_name"), content, F.lit(""), F.when(is_class, F.lit("")).otherwise(F.coalesce("signature", F.lit(""))), id_name
    )
    classes = s.where("parent = '' and kind = 'class'").select(*file_key, F.col("symbol_name").alias("parent")).distinct()
    methods = s.where("parent <> ''").join(classes, [*file_key, "parent"], "left_semi")
    return tops.unionByName(
        _chunk(
            methods,
            F.col("kind"),
            F.col("symbol_name"),
            F.coalesce("content", F.lit("")),
            S.context_header(F.col("file_path"), F.col("parent"), True),
            F.coalesce("signature", F.lit("")),
        )
    )
