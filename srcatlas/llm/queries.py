"""Queries of this folder: name -> callable(spark, sf_dir), all with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.session import table


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.provenance import unwritten_files

    return unwritten_files(*_tables(spark, d, "files", "source_files", "modules"))


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.provenance import file_provenance

    return file_provenance(*_tables(spark, d, "files", "source_files", "modules"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.docpairs import documented_symbols

    return documented_symbols(*_tables(spark, d, "symbols", "source_files")).select("symbol_id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.docpairs import code_documentation_pairs

    return code_documentation_pairs(*_tables(spark, d, "symbols", "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.secrets import credential_lines

    return credential_lines(table(spark, d, "chunks"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.secrets import redacted_chunks

    return redacted_chunks(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.neighbours import similar_pairs

    return similar_pairs(table(spark, d, "chunks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.mixture import draw_mixture

    return draw_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.mixture import draw_mixture

    return draw_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by plain temperature, for the largest total that the repetition limits allow."""
    from srcatlas.llm.mixture import draw_mixture

    return draw_mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), by_temperature=True)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.residue import residue_documents

    return residue_documents(table(spark, d, "documents"))


def p8_residue(spark: SparkSession, d: str) -> DataFrame:
    from srcatlas.llm.residue import judge_residue

    return judge_residue(table(spark, d, "documents")).where(F.col("residue").isNotNull())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_origins": p1_origins,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_tempered": p7_tempered,
    "p8_found": p8_found,
    "p8_residue": p8_residue,
}
SQL: dict[str, str] = {}
