"""The property graph as tables: nodes from files and symbols, edges by joins, traversal by frontier joins.

Nodes are `file:<repo>/<path>` and `symbol:<id>`; edges are (type, src, dst) without duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.operators.references import MODULE_ENDINGS, SCRIPT_ENDINGS, clean_path, reference_lookups
from srcatlas.session import materialize


def file_node(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), repo, F.lit("/"), path)


def repo_node(repo: Column) -> Column:
    return F.concat(F.lit("repository:"), repo)


def module_node(repo: Column, path: Column) -> Column:
    return F.concat(F.lit("module:"), repo, F.lit("/"), path)


def pattern_node(repo: Column, name: Column) -> Column:
    return F.concat(F.lit("pattern:"), repo, F.lit("/"), name)


def files_with_hash(files: DataFrame, file_hash: str) -> DataFrame:
    """Current files whose content has that hash; the filter reaches the scan."""
    return current_files(files.where(F.col("hash") == file_hash)).select("repo", "path", "hash")


def symbol_node(symbol_id: Column) -> Column:
    return F.concat(F.lit("symbol:"), symbol_id.cast("string"))


def current_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol id, the one indexed last (ties: the last in the order of its fields); deleted symbols left out."""
    fields = ["repo", "symbol_name", "kind", "file_path", "start_line", "end_line", "parent"]
    latest = symbols.where("symbol_id is not null").groupBy("symbol_id").agg(
        F.max(F.struct("indexed_at", *fields)).alias("s"), F.max("deleted_at").alias("deleted_at")
    )
    return latest.where("deleted_at is null").select("symbol_id", *[f"s.{c}" for c in fields])


def current_files(files: DataFrame) -> DataFrame:
    """One row per file, the one indexed last (ties: the last in the order of its fields); deleted files left out."""
    latest = files.where("repo is not null and path is not null").groupBy("repo", "path").agg(
        F.max(F.struct("last_indexed", "module_root", "hash")).alias("f"), F.max("deleted_at").alias("deleted_at")
    )
    return latest.where("deleted_at is null").select("repo", "path", "f.module_root", "f.hash", "f.last_indexed")


def contains_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File to the symbols in it; only where the file exists."""
    s = symbols.select("symbol_id", "repo", F.col("file_path").alias("path"))
    return s.join(files.select("repo", "path"), ["repo", "path"]).select(
        F.lit("CONTAINS").alias("type"), file_node(F.col("repo"), F.col("path")).alias("src"), symbol_node(F.col("symbol_id")).alias("dst")
    )


def _import_keys(files: DataFrame) -> DataFrame:
    """What a file answers to when imported: (repo, space, key, path, dropped).

    A Python file below a doubled first folder also answers to its name with one of the two; `dropped` marks such keys.
    """

    def ending(e: str) -> Column:
        return F.when(F.col("path").endswith(e), F.expr(f"substring(path, 1, length(path) - {len(e)})"))

    py = files.select(
        "repo", F.lit("py").alias("space"), F.explode(F.array_compact(F.array(*[ending(e) for e in MODULE_ENDINGS]))).alias("key"), "path"
    )
    parts = F.split("key", "/")
    doubled = py.where(
        (F.size(parts) > 1) & (F.get(parts, F.lit(0)) == F.get(parts, F.lit(1)))
    ).withColumn("key", F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"))
    js = files.select(
        "repo",
        F.lit("js").alias("space"),
        F.explode(F.array_compact(F.array(F.col("path"), *[ending(e) for e in SCRIPT_ENDINGS]))).alias("key"),
        "path",
    )
    return py.unionByName(js).withColumn("dropped", F.lit(False)).unionByName(doubled.withColumn("dropped", F.lit(True)))


def import_edges(relationships: DataFrame, files: DataFrame) -> DataFrame:
    """File to the file it imports; both must exist, of several candidates the first path counts, whole names before dropped ones."""
    keys = _import_keys(files).groupBy("repo", "space", "key").agg(F.min(F.struct("dropped", "path")).alias("k")).select(
        "repo", "space", "key", F.col("k.path").alias("target")
    )
    looks = reference_lookups(relationships.where("kind = 'imports'")).where(
        "field = 'target_path' and key is not null"
    ).select("rel_id", "repo", "space", "key").distinct()
    sources = relationships.where("kind = 'imports'").select("rel_id", clean_path(F.col("source_file")).alias("source")).distinct()
    found = looks.join(keys, ["repo", "space", "key"]).join(sources, "rel_id").join(
        files.select("repo", F.col("path").alias("source")), ["repo", "source"], "left_semi"
    )
    return found.select(
        F.lit("IMPORTS").alias("type"), file_node(F.col("repo"), F.col("source")).alias("src"), file_node(F.col("repo"), F.col("target")).alias("dst")
    ).distinct()


def name_classes(symbols: DataFrame) -> DataFrame:
    """(cls, dst): symbols by what a reference may mean, the symbols of a name in a file and those of a name in a repo."""
    s = symbols.where("symbol_name is not null and repo is not null")
    local = s.where("file_path is not null").select(
        F.concat_ws("\x1f", "repo", "symbol_name", "file_path").alias("cls"), symbol_node(F.col("symbol_id")).alias("dst")
    )
    return local.unionByName(s.select(F.concat_ws("\x1f", "repo", "symbol_name").alias("cls"), symbol_node(F.col("symbol_id")).alias("dst")))


def reference_classes(relationships: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """(type, src, cls): CALLS or EXTENDS from a symbol to what the name it uses may mean, one row per symbol and class.

    The source is the innermost symbol of the file whose lines hold the reference. The class is that of the last segment of
    the name: the symbols of that name in the same file if there are any, else those in the repo. The result grows with the
    references, not with the number of symbols that share a name; `name_classes` holds the members.
    """
    rel = relationships.where(F.col("kind") == kind).select(
        "repo",
        clean_path(F.col("source_file")).alias("file_path"),
        F.col("source_line").alias("line"),
        F.substring_index("target_name", ".", -1).alias("name"),
    ).where("name is not null and name <> ''").distinct()
    s = symbols.select("symbol_id", "repo", "file_path", "symbol_name", "start_line", "end_line")
    inside = [rel["repo"] == s["repo"], rel["file_path"] == s["file_path"], rel["line"] >= s["start_line"], rel["line"] <= s["end_line"]]
    innermost = rel.join(s, inside).groupBy(rel["repo"], rel["file_path"], rel["line"], rel["name"]).agg(
        F.max_by(s["symbol_id"], F.struct(s["start_line"], -s["end_line"], s["symbol_id"])).alias("src")
    )
    asked = innermost.select("repo", "file_path", "name", "src").distinct()
    names = s.select("repo", F.col("symbol_name").alias("name"), "file_path").distinct()
    here = asked.join(names, ["repo", "file_path", "name"], "left_semi").select("src", F.concat_ws("\x1f", "repo", "name", "file_path").alias("cls"))
    elsewhere = asked.join(names, ["repo", "file_path", "name"], "left_anti").join(
        names.select("repo", "name").distinct(), ["repo", "name"], "left_semi"
    ).select("src", F.concat_ws("\x1f", "repo", "name").alias("cls"))
    return here.unionByName(elsewhere).select(F.lit(kind.upper()).alias("type"), symbol_node(F.col("src")).alias("src"), "cls").distinct()


def reference_edges(relationships: DataFrame, symbols: DataFrame, kind: str) -> DataFrame:
    """CALLS or EXTENDS edges between symbols: each class of `reference_classes` with its members, expanded on demand."""
    return reference_classes(relationships, symbols, kind).join(name_classes(symbols), "cls").select("type", "src", "dst").distinct()


def graph_nodes(repositories: DataFrame, modules: DataFrame, files: DataFrame, symbols: DataFrame, patterns: DataFrame) -> DataFrame:
    """(node, label, name): every node, one row each; modules only of repositories that exist, null keys left out."""
    repo = F.col("repo")
    known = repositories.select("repo").where("repo is not null").distinct()
    return (
        known.select(repo_node(repo).alias("node"), F.lit("Repository").alias("label"), repo.alias("name"))
        .unionByName(modules.where("path is not null").join(known, "repo", "left_semi").select(module_node(repo, F.col("path")).alias("node"), F.lit("Module").alias("label"), F.col("path").alias("name")))
        .unionByName(files.select(file_node(repo, F.col("path")).alias("node"), F.lit("File").alias("label"), F.col("path").alias("name")))
        .unionByName(symbols.select(symbol_node(F.col("symbol_id")).alias("node"), F.lit("Symbol").alias("label"), F.col("symbol_name").alias("name")))
        .unionByName(patterns.select(pattern_node(repo, F.col("name")).alias("node"), F.lit("Pattern").alias("label"), "name"))
        .where("node is not null")
        .distinct()
    )


def structure_edges(repositories: DataFrame, modules: DataFrame, imports: DataFrame, files: DataFrame, members: DataFrame) -> DataFrame:
    """CONTAINS from repositories to modules, DEPENDS_ON between modules, FOLLOWED_BY from patterns to files.

    A module is contained only if its repository exists. A module depends on another of its repo if one of its files imports
    a file of the other; a file belongs to its module_root. members(repo, name, file_path): files of patterns.
    """
    repo = F.col("repo")
    known = repositories.select("repo").where("repo is not null").distinct()
    contains = modules.where("path is not null").join(known, "repo", "left_semi").select(
        F.lit("CONTAINS").alias("type"), repo_node(repo).alias("src"), module_node(repo, F.col("path")).alias("dst")
    )
    own = modules.select("repo", F.col("path").alias("module_root")).distinct()
    home = files.join(own, ["repo", "module_root"], "left_semi").select(
        file_node(repo, F.col("path")).alias("file"), module_node(repo, F.col("module_root")).alias("module")
    )
    there = home.withColumnsRenamed({"file": "dst", "module": "to"})
    depends = imports.select("src", "dst").join(
        home.withColumnsRenamed({"file": "src", "module": "from"}), "src"
    ).select("from", "dst").distinct().join(there, "dst").where(F.col("from") != F.col("to"))
    followed = members.join(files.select("repo", F.col("path").alias("file_path")), ["repo", "file_path"], "left_semi").select(
        F.lit("FOLLOWED_BY").alias("type"), pattern_node(repo, F.col("name")).alias("src"), file_node(repo, F.col("file_path")).alias("dst")
    )
    return contains.unionByName(
        depends.select(F.lit("DEPENDS_ON").alias("type"), F.col("from").alias("src"), F.col("to").alias("dst"))
    ).unionByName(followed).distinct()


def all_edges(relationships: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    f, s = current_files(files), current_symbols(symbols)
    return contains_edges(f, s).unionByName(import_edges(relationships, f)).unionByName(reference_edges(relationships, s, "calls")).unionByName(
        reference_edges(relationships, s, "extends")
    )


def callers(edges: DataFrame, symbols: DataFrame, repo: str, name: str) -> DataFrame:
    """Symbols that call a symbol of that name, as a bag: one row per edge."""
    target = symbols.where((F.col("repo") == repo) & (F.col("symbol_name") == name)).select(symbol_node(F.col("symbol_id")).alias("dst"))
    hits = edges.where("type = 'CALLS'").join(target, "dst").select("src")
    return hits.join(symbols.withColumn("src", symbol_node(F.col("symbol_id"))), "src").drop("src")


def callees(edges: DataFrame, symbols: DataFrame, repo: str, name: str) -> DataFrame:
    """Symbols that a symbol of that name calls, as a bag."""
    source = symbols.where((F.col("repo") == repo) & (F.col("symbol_name") == name)).select(symbol_node(F.col("symbol_id")).alias("src"))
    hits = edges.where("type = 'CALLS'").join(source, "src").select("dst")
    return hits.join(symbols.withColumn("dst", symbol_node(F.col("symbol_id"))), "dst").drop("dst")


def related_files(imports: DataFrame, calls: DataFrame, members: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node, related): every file with the files it imports, is imported by, calls into and is called from; a file can relate to itself by calls within it.

    calls(src, cls) and members(cls, dst) are reduced to distinct files and classes before they meet.
    """
    home = symbols.select(symbol_node(F.col("symbol_id")).alias("s"), file_node(F.col("repo"), F.col("file_path")).alias("f"))
    callers = calls.join(home.withColumnsRenamed({"s": "src", "f": "a"}), "src").select("a", "cls").distinct()
    holders = members.join(home.withColumnsRenamed({"s": "dst", "f": "b"}), "dst").select("cls", "b").distinct()
    pairs = imports.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(callers.join(holders, "cls").select("a", "b")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("related")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("related"))
    ).distinct()


def _reach(frontier: DataFrame, plain: DataFrame, named: DataFrame | None, members: DataFrame | None) -> DataFrame:
    """Nodes one step from a frontier, over edges either way; a class is passed only from its users to its members or back."""
    ahead = frontier.select(F.col("node").alias("src"))
    back = frontier.select(F.col("node").alias("dst"))
    out = plain.join(ahead, "src", "left_semi").select(F.col("dst").alias("node")).unionByName(
        plain.join(back, "dst", "left_semi").select(F.col("src").alias("node"))
    )
    if named is not None:
        used = named.join(ahead, "src", "left_semi").select("cls").distinct()
        held = members.join(back, "dst", "left_semi").select("cls").distinct()
        out = out.unionByName(
            members.join(used, "cls", "left_semi").select(F.col("dst").alias("node"))
        ).unionByName(named.join(held, "cls", "left_semi").select(F.col("src").alias("node")))
    return out.distinct()


def expand(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int,
    types: tuple[str, ...] = ("CALLS", "EXTENDS", "CONTAINS"),
    named: DataFrame | None = None,
    members: DataFrame | None = None,
    most: int | None = None,
) -> DataFrame:
    """(node, distance): nodes within `depth` steps of the seeds over edges in either direction, seeds left out.

    References may be given as classes, named(type, src, cls) and members(cls, dst), so that a name which many symbols share
    is never expanded into pairs. Every round joins the frontier with the edges and drops what was seen; rounds are written
    to the shared folder, so the plan doesn't grow with depth. Cycles and self-loops end by the anti join. With `most`, the
    first that many by distance and node are returned.
    """
    plain = edges.where(F.col("type").isin(*types)).select("src", "dst")
    if named is not None:
        named = named.where(F.col("type").isin(*types)).select("src", "cls")
    start = materialize(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "frontier")
    seen, frontier = start, start
    for step in range(1, depth + 1):
        frontier = materialize(
            _reach(frontier, plain, named, members).join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step)), "frontier"
        )
        seen = seen.unionByName(frontier)
    found = seen.where("distance > 0")
    return found if most is None else found.orderBy("distance", "node").limit(most)


def expand_basic(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): callers, callees, parents and children of the seeds, one step, distinct; may hold seeds."""
    e = edges.where("type in ('CALLS', 'EXTENDS')")
    out = e.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    back = e.join(seeds.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"))
    return out.unionByName(back).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key; of several new rows the last by `order` counts."""
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), order).alias("x")).select(*keys, "x.*")
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def delete_files(edges: DataFrame, symbols: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges that remain when files (repo, path) are deleted: their symbols go, and every edge at either end."""
    dead_files = gone.select("repo", F.col("path").alias("file_path")).distinct()
    kept = symbols.join(dead_files, ["repo", "file_path"], "left_anti")
    dead = dead_files.select(file_node(F.col("repo"), F.col("file_path")).alias("n")).unionByName(
        symbols.join(dead_files, ["repo", "file_path"], "left_semi").select(symbol_node(F.col("symbol_id")).alias("n"))
    )
    left = edges.join(dead.withColumnRenamed("n", "src"), "src", "left_anti").join(dead.withColumnRenamed("n", "dst"), "dst", "left_anti")
    return kept, left.select(*edges.columns)


def delete_repository(edges: DataFrame, files: DataFrame, symbols: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and edges that remain when a repository is deleted with everything in it."""
    gone = files.where(F.col("repo") == repo).select("repo", "path")
    left_symbols, left_edges = delete_files(edges, symbols, gone)
    return files.where(F.col("repo") != repo), left_symbols.where(F.col("repo") != repo), left_edges
