"""Navigation documents: sections with their heading paths, entry points, mentioned files and symbols.

Lines are numbered and exploded; a section is the run of lines below one heading, found by a running maximum per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions import scalar as S

GUIDE_NAMES = ["AGENTS.md", "CLAUDE.md"]


def guide_documents(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose base name is that of a navigation document, outside hidden and dependency folders."""
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda p: p.startswith(".") | p.isin("node_modules", "venv", "__pycache__"))
    return files.where(F.element_at(parts, -1).isin(*GUIDE_NAMES) & ~skipped)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    lines = docs.select("repo", "path", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    h = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    return lines.withColumn("level", F.length(h)).withColumn("heading", F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2))


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(repo, path, heading, heading_path, level, content, start_line, end_line) of every section of docs(repo, path, text).

    Fences are not recognised: a heading in one counts. Text before the first heading is in no section. A heading's path is
    the last heading of each lower level before it, below the last one that closed them. start_line is the heading's line;
    end_line is the line before the next heading less one, and the number of lines for the last section (kept as it is in
    the data model, see the README). Null text has no section. One document is one group; documents spread over tasks.
    """
    lines = _lines(docs, text)
    doc = Window.partitionBy("repo", "path").orderBy("pos")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("repo", "path")
    ls = lines.withColumn("sec", F.max(F.when(F.col("level") > 0, F.col("pos"))).over(upto)).withColumn("n_lines", F.count("*").over(whole))
    # heading stack: position and text of the last heading per level; one of a lower level closes the deeper ones
    for k in range(1, 7):
        ls = ls.withColumn(f"_h{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "heading"))).over(upto))
        ls = ls.withColumn(f"_c{k}", F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("pos"))).over(upto))
    steps = [
        F.when(
            (F.col("level") >= k) & F.col(f"_h{k}").isNotNull() & (F.col(f"_h{k}")["pos"] > F.coalesce(F.col(f"_c{k}"), F.lit(-1))),
            F.col(f"_h{k}")["heading"],
        ) for k in range(1, 7)
    ]
    heads = ls.where("level > 0").withColumn("next", F.lead("pos").over(Window.partitionBy("repo", "path").orderBy("pos")))
    heads = heads.select(
        "repo",
        "path",
        "sec",
        "heading",
        F.concat_ws(" > ", *steps).alias("heading_path"),
        "level",
        (F.col("pos") + 1).alias("start_line"),
        F.when(F.col("next").isNull(), F.col("n_lines")).otherwise(F.col("next") - 1).alias("end_line"),
    )
    bodies = ls.where("sec is not null and level = 0").groupBy("repo", "path", "sec").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), ""
        ).alias("content")
    )
    return heads.join(bodies, ["repo", "path", "sec"], "left").select(
        "repo", "path", "heading", "heading_path", "level", F.coalesce("content", F.lit("")).alias("content"), "start_line", "end_line"
    )


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(repo, path, line_no, code, kind): inline code that is a file path (`file`) or a name (`symbol`), duplicates kept; `entry` marks entry points.

    Entry points: paths on a line that says "entry point", or in a section whose heading says "entry".
    """
    doc = Window.partitionBy("repo", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ls = _lines(docs, text).withColumn("_head", F.last(F.when(F.col("level") > 0, F.lower("heading")), ignorenulls=True).over(doc))
    codes = ls.select(
        "repo",
        "path",
        (F.col("pos") + 1).alias("line_no"),
        "line",
        "_head",
        F.explode(F.regexp_extract_all("line", F.lit("`([^`]+)`"), 1)).alias("code"),
    )
    entry = S.is_file_path(F.col("code")) & (F.lower("line").contains("entry point") | F.coalesce(F.col("_head").contains("entry"), F.lit(False)))
    kind = F.when(S.is_file_path(F.col("code")), "file").when(S.is_symbol(F.col("code")), "symbol")
    return codes.select("repo", "path", "line_no", "code", kind.alias("kind"), entry.alias("entry")).where("kind is not null")


def guide_summary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(repo, path, module, title, description): the first level-1 heading, and the first other non-blank line after it."""
    lines = _lines(docs, text)
    title = lines.where("level = 1").groupBy("repo", "path").agg(F.min_by(F.struct("pos", "heading"), "pos").alias("t"))
    after = lines.join(title, ["repo", "path"]).where("level = 0 and pos > t.pos and trim(line) <> ''").groupBy("repo", "path").agg(
        F.min_by(F.trim("line"), "pos").alias("description")
    )
    parts = F.split(F.col("path"), "/")
    module = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    return docs.select("repo", "path").distinct().join(title, ["repo", "path"], "left").join(after, ["repo", "path"], "left").select(
        "repo",
        "path",
        module.alias("module"),
        F.coalesce("t.heading", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def guide_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """A chunk per section: type doc, kind navigation, weight 1.5, named by its heading path."""
    parts = F.split(F.col("path"), "/")
    module = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))
    return sections(docs, text).select(
        S.chunk_id(F.col("repo"), F.col("path"), F.col("heading"), F.col("start_line")).alias("id"), "repo", F.col("path").alias("file_path"), "start_line", "end_line", F.lit("doc").alias("chunk_type"), F.lit("navigation").alias("kind"),
        module.alias("module_path"), module.alias("module_root"), F.lit("").alias("symbol_name"), "heading_path", "content", F.lit(False).alias("is_test"), F.lit(S.GUIDE_WEIGHT).cast("float").alias("retrieval_weight"),
    )
