"""References to records that do not exist.

Every textual reference becomes a lookup `(repo, space, key, t)` and every record that may be referred to becomes a
validity interval `(repo, space, key, [born, died))`; one time-bounded anti join answers all three kinds of reference.
These orphans are round 0 of a fixpoint cascade that hands orphan status down the foreign-key graph; every result is read
from the cascade, with the depth at which it was found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.session import materialize

ALWAYS_BORN = "0001-01-01 00:00:00"
NEVER_DIED = "9999-12-31 00:00:00"
#: Endings that may be left out of a script import; fixed values of the problem statement.
SCRIPT_ENDINGS = [".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts"]
MODULE_ENDINGS = [".py", "/__init__.py"]


def clean_segments(path: Column) -> Column:
    """Path segments: `\\` read as `/`; `.` and empty segments dropped."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.filter(parts, lambda s: ~s.isin("", "."))


def clean_path(path: Column) -> Column:
    return F.array_join(clean_segments(path), "/")


def _directory(segments: Column) -> Column:
    return F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))


def _strip_ending(path: Column, ending: str) -> Column:
    return F.when(path.endswith(ending), F.expr(f"substring(path, 1, length(path) - {len(ending)})"))


def merge_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of `[born, died)` spans per key as disjoint spans.

    Before the window, spans that never end are reduced to the earliest per key, and others to one per distinct start, so
    of a key with very many records only those that were deleted at different times remain.
    """
    lasting = F.col("died") == F.lit(NEVER_DIED).cast("timestamp")
    starts = spans.groupBy(*keys, F.when(~lasting, F.col("born")).alias("_start")).agg(
        F.min("born").alias("born"), F.max("died").alias("died")
    ).drop("_start")
    w = Window.partitionBy(*keys).orderBy("born")
    reach = F.max("died").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = starts.withColumn("_new", F.when(reach.isNull() | (F.col("born") > reach), 1).otherwise(0)).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return islands.groupBy(*keys, "_island").agg(F.min("born").alias("born"), F.max("died").alias("died")).drop("_island")


def file_spans(files: DataFrame) -> DataFrame:
    """One span per file: earliest `last_indexed` to `deleted_at`."""
    f = files.where(F.col("repo").isNotNull() & F.col("path").isNotNull())
    g = f.groupBy("repo", "path").agg(F.min("last_indexed").alias("born"), F.max("deleted_at").alias("died"))
    return g.where("born is not null").withColumn("died", F.coalesce("died", F.lit(NEVER_DIED).cast("timestamp")))


def symbol_spans(symbols: DataFrame) -> DataFrame:
    """One span per symbol id with its names: earliest `indexed_at` to `deleted_at`."""
    s = symbols.where("repo is not null and symbol_id is not null")
    g = s.groupBy("repo", "symbol_id", "symbol_name", "parent").agg(F.min("indexed_at").alias("born"), F.max("deleted_at").alias("died"))
    return g.where("born is not null").withColumn("died", F.coalesce("died", F.lit(NEVER_DIED).cast("timestamp")))


def reference_targets(files: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """All that can be referred to: (repo, space, key, born, died), disjoint spans per key.

    Spaces: `file` (exact path), `py` (slashed module name), `js` (path with optional ending), `sym` (symbol names).
    """
    f = file_spans(files)
    py = F.array_compact(F.array(*[_strip_ending(F.col("path"), e) for e in MODULE_ENDINGS], F.when(F.col("path") == "__init__.py", F.lit(""))))
    js = F.array_compact(
        F.array(
            F.col("path"), *[_strip_ending(F.col("path"), e) for e in SCRIPT_ENDINGS], F.when(F.col("path").isin("index.js", "index.ts"), F.lit(""))
        )
    )
    spaces = F.flatten(
        F.array(
            F.array(F.struct(F.lit("file").alias("space"), F.col("path").alias("key"))),
            F.transform(py, lambda k: F.struct(F.lit("py").alias("space"), k.alias("key"))),
            F.transform(js, lambda k: F.struct(F.lit("js").alias("space"), k.alias("key"))),
        )
    )
    from_files = f.select("repo", F.explode(spaces).alias("k"), "born", "died").select("repo", "k.space", "k.key", "born", "died")
    from_modules = modules.where("repo is not null and path is not null").select(
        "repo", F.lit("py").alias("space"), F.translate("path", ".", "/").alias("key"), F.lit(ALWAYS_BORN).cast("timestamp").alias("born"), F.lit(NEVER_DIED).cast("timestamp").alias("died")
    )
    # an undotted reference means symbol_name, a dotted one parent.symbol_name, so each name lives in its own space
    s = symbol_spans(symbols)
    plain = s.where("symbol_name is not null").select("repo", F.lit("sym").alias("space"), F.col("symbol_name").alias("key"), "born", "died")
    dotted = s.where("symbol_name is not null and parent is not null").select(
        "repo", F.lit("dot").alias("space"), F.concat_ws(".", "parent", "symbol_name").alias("key"), "born", "died"
    )
    return merge_intervals(from_files.unionByName(from_modules).unionByName(plain).unionByName(dotted), ["repo", "space", "key"])


def _py_import(q: DataFrame) -> Column:
    """Slashed key of a Python import, null where it climbs above the root."""
    dots = F.length(F.regexp_extract("target_path", r"^(\.*)", 1))
    rest = F.translate(F.expr("substring(target_path, length(regexp_extract(target_path, '^(\\\\.*)', 1)) + 1)"), ".", "/")
    base = F.col("_dir")
    up = F.slice(base, F.lit(1), F.greatest(F.size(base) - dots + 1, F.lit(0)))
    stem = F.array_join(up, "/")
    relative = F.when(dots - 1 <= F.size(base), F.concat_ws("/", F.when(stem != "", stem), F.when(rest != "", rest)))
    return F.when(dots > 0, relative).otherwise(rest)


def _js_import(q: DataFrame) -> Column:
    """Key of a relative script import: directory of the source plus the path, `..` applied; null above the root."""
    parts = F.split("target_path", "/")
    start = F.struct(F.col("_dir").alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        at, ok = acc["at"], acc["ok"]
        up = part == ".."
        keep = F.when(part.isin("", "."), at).when(up, _directory(at)).otherwise(F.concat(at, F.array(part)))
        return F.struct(keep.alias("at"), (ok & ~(up & (F.size(at) == 0))).alias("ok"))

    walked = F.aggregate(parts, start, step)
    return F.when(walked["ok"], F.array_join(walked["at"], "/"))


def reference_lookups(relationships: DataFrame) -> DataFrame:
    """(rel_id, field, repo, space, key, root, t) per non-null reference; `root` is the part that may be external.

    A null `key` is a reference that cannot exist inside the repository. References that begin with self, cls or this
    are left out. Repeated deliveries give one lookup.
    """
    r = relationships.select("rel_id", "repo", "source_file", "target_path", "target_name", F.col("indexed_at").alias("t")).distinct()
    r = r.withColumn("_seg", clean_segments(F.col("source_file"))).withColumn("_path", F.array_join("_seg", "/")).withColumn(
        "_dir", F.coalesce(_directory(F.col("_seg")), F.array().cast("array<string>"))
    )
    python = F.coalesce(F.col("_path").endswith(".py"), F.lit(False))
    leading = F.col("target_path").startswith(".")
    script_root = F.when(
        F.col("target_path").startswith("@"), F.substring_index("target_path", "/", 2)
    ).otherwise(F.substring_index("target_path", "/", 1))
    import_key = F.when(python, _py_import(r)).when(leading & F.col("source_file").isNotNull(), _js_import(r))
    import_root = F.when(~leading, F.when(python, F.substring_index("target_path", ".", 1)).otherwise(script_root))
    name = F.col("target_name")
    owned = F.substring_index(name, ".", 1).isin("self", "cls", "this")

    def look(cond: Column, field: str, space: Column, key: Column, root: Column) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), space.alias("space"), key.alias("key"), root.alias("root")))

    looks = F.array_compact(
        F.array(
            look(F.col("source_file").isNotNull(), "source_file", F.lit("file"), F.col("_path"), F.lit(None).cast("string")),
            look(F.col("target_path").isNotNull(), "target_path", F.when(python, F.lit("py")).otherwise(F.lit("js")), import_key, import_root),
            look(name.isNotNull() & ~owned, "target_name", F.when(F.instr(name, ".") > 0, F.lit("dot")).otherwise(F.lit("sym")), name, name),
        )
    )
    return r.select("rel_id", "repo", "t", F.explode(looks).alias("x")).select("rel_id", "x.field", "repo", "x.space", "x.key", "x.root", "t")


def orphan_references(relationships: DataFrame, files: DataFrame, symbols: DataFrame, modules: DataFrame, external_targets: DataFrame) -> DataFrame:
    """(rel_id, field, repo, t): every reference that does not resolve in its repo at the time of indexing.

    * resolution is case-sensitive and within the repo; `loaded_at` plays no part; repeated deliveries count once;
    * a null field is no reference; an empty string is one, and resolves only to an equal key;
    * a null repo or a null indexed_at resolves to nothing (only external targets remain);
    * empty tables on either side give the evident result; extra columns are ignored.

    The lookup side is shuffled once, on (repo, space, key); adaptive execution splits a hot key, whose other side holds
    a few disjoint spans only.
    """
    targets = reference_targets(files, symbols, modules)
    ext = external_targets.where("target_ref is not null").select(
        F.when(F.col("target_kind") == "package", "target_path").when(F.col("target_kind") == "callable", "target_name").alias("field"),
        F.col("target_ref").alias("root"),
    ).distinct()
    q = reference_lookups(relationships).join(ext, ["field", "root"], "left_anti")
    cond = [q[k] == targets[k] for k in ("repo", "space", "key")] + [targets["born"] <= q["t"], targets["died"] > q["t"]]
    found = q.join(targets, cond, "left_anti").groupBy("rel_id", "field").agg(F.min(F.struct("t", "repo", "space", "key")).alias("x"))
    return found.select("rel_id", "field", "x.repo", "x.space", "x.key", "x.t")


@dataclass
class Cascade:
    """What a cascade found.

    records(node, table_name, day, depth): orphaned rows of files, symbols, chunks and relationships, one row per record;
    references(rel_id, field, repo, space, key, t, depth): orphaned references, one row per reference.
    Depth 0 is direct, larger ones are inherited over that many foreign keys.
    """

    records: DataFrame
    references: DataFrame


def _node(table: str, *parts: str) -> Column:
    return F.concat_ws("\x1f", F.lit(table), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def cascade(
    relationships: DataFrame, files: DataFrame, symbols: DataFrame, modules: DataFrame, external_targets: DataFrame, chunks: DataFrame
) -> Cascade:
    """Direct and inherited orphans.

    Records are the rows of files, symbols, chunks and relationships, one per key. Direct: a file whose module_root names
    no module, a symbol or chunk whose file does not exist when it was indexed, a relationship with an unresolved
    reference. Inherited: a record whose parent record is an orphan (symbol, chunk and relationship to their file, symbol
    to its parent class of the same file, chunk to the symbol it was cut from, relationship to the symbol it starts in);
    the references of a relationship that inherits are inherited orphans, unless they are direct ones. Null parents are no
    parents; of several days of one record the first counts. Rounds of semi joins run down that graph until a round adds
    nothing; each round is written to the shared folder, so a lost executor costs one round at most.
    """
    f = file_spans(files).select("repo", F.col("path").alias("file"), "born", "died")
    sym = symbols.where("symbol_id is not null").groupBy(
        "symbol_id", "repo", F.col("file_path").alias("file"), "symbol_name", "parent"
    ).agg(F.min("indexed_at").alias("t"))
    chk = chunks.where("id is not null").groupBy("id", "repo", F.col("file_path").alias("file"), "symbol_name").agg(F.min("indexed_at").alias("t"))
    rel = relationships.select(
        "rel_id", "repo", clean_path(F.col("source_file")).alias("file"), "source_name", F.col("indexed_at").alias("t")
    ).distinct()

    def fileless(x: DataFrame) -> DataFrame:
        return x.join(f, [x["repo"] == f["repo"], x["file"] == f["file"], f["born"] <= x["t"], f["died"] > x["t"]], "left_anti")

    def rows(x: DataFrame, table: str, *key: str) -> DataFrame:
        return x.select(_node(table, *key).alias("node"), F.lit(table).alias("table_name"), F.to_date("t").alias("day"))

    fil = files.where("path is not null").groupBy("repo", F.col("path").alias("file")).agg(
        F.max("module_root").alias("module_root"), F.min("last_indexed").alias("t")
    )
    roots = modules.select("repo", F.col("path").alias("module_root")).distinct()
    rootless = fil.where("module_root is not null").join(roots, ["repo", "module_root"], "left_anti")
    references = materialize(orphan_references(relationships, files, symbols, modules, external_targets), "references")
    direct = rows(rootless, "files", "repo", "file").unionByName(
        rows(fileless(sym), "symbols", "symbol_id")
    ).unionByName(rows(fileless(chk), "chunks", "id")).unionByName(rows(references, "relationships", "rel_id"))
    direct = direct.groupBy("node", "table_name").agg(F.min("day").alias("day"))

    # parent -> child edges: by the file, and by the name within it
    def children(x: DataFrame, table: str, key: str, name: Column, when: str) -> DataFrame:
        return x.where(when).select(
            "repo", "file", name.alias("name"), _node(table, key).alias("node"), F.lit(table).alias("table_name"), F.to_date("t").alias("day")
        )

    names = sym.where("symbol_name is not null").select(
        "repo", "file", F.col("symbol_name").alias("name"), _node("symbols", "symbol_id").alias("parent_node")
    )
    named = children(sym, "symbols", "symbol_id", F.col("parent"), "coalesce(parent, '') <> ''").unionByName(
        children(chk, "chunks", "id", F.col("symbol_name"), "coalesce(symbol_name, '') <> ''")
    )
    named = named.unionByName(children(rel, "relationships", "rel_id", F.substring_index("source_name", ".", -1), "source_name is not null"))
    by_name = named.join(names, ["repo", "file", "name"]).where("node <> parent_node").select("parent_node", "node", "table_name", "day")
    nothing = F.lit("")
    by_file = children(sym, "symbols", "symbol_id", nothing, "true").unionByName(children(chk, "chunks", "id", nothing, "true")).unionByName(
        children(rel, "relationships", "rel_id", nothing, "true")
    )
    by_file = by_file.where("file is not null").select(_node("files", "repo", "file").alias("parent_node"), "node", "table_name", "day")
    edges = materialize(by_file.unionByName(by_name), "fk-edges")

    frontier = materialize(direct.withColumn("depth", F.lit(0)), "orphans")
    found, depth = frontier, 0
    while True:  # each round adds unseen nodes only, so it ends
        depth += 1
        reached = edges.join(
            frontier.select(F.col("node").alias("parent_node")), "parent_node", "left_semi"
        ).groupBy("node", "table_name").agg(F.min("day").alias("day"))
        frontier = materialize(reached.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "orphans")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)

    heirs = found.where("table_name = 'relationships' and depth > 0").select(
        F.substring_index("node", "\x1f", -1).cast(relationships.schema["rel_id"].dataType).alias("rel_id"), "depth"
    )
    looks = reference_lookups(relationships).groupBy("rel_id", "field").agg(F.min(F.struct("t", "repo", "space", "key")).alias("x"))
    inherited = looks.join(heirs, "rel_id").select("rel_id", "field", "x.repo", "x.space", "x.key", "x.t", "depth")
    return Cascade(found, references.withColumn("depth", F.lit(0)).unionByName(inherited))


def _kind(depth: str = "depth") -> Column:
    return F.when(F.col(depth) == 0, "direct").otherwise("inherited").alias("orphan_kind")


def orphan_report(references: DataFrame) -> DataFrame:
    """Orphaned references of a cascade per table referred to, UTC day of indexing and kind: (target_table, day, orphan_kind, n_orphans, n_keys).

    n_keys counts the distinct (repo, key) referred to. Counts are made per key first, so a hot key is one row.
    """
    table = F.when(F.col("field") == "target_name", "symbols").when(
        (F.col("field") == "target_path") & (F.col("space") == "py"), "modules"
    ).otherwise("files")
    per_key = references.groupBy(table.alias("target_table"), F.to_date("t").alias("day"), _kind(), "repo", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("target_table", "day", "orphan_kind").agg(F.sum("n").alias("n_orphans"), F.count("*").alias("n_keys"))


def orphan_counts(records: DataFrame) -> DataFrame:
    """Orphaned records of a cascade per table and day: (table_name, day, orphan_kind, depth, n_records)."""
    return records.groupBy("table_name", "day", _kind(), "depth").agg(F.count("*").alias("n_records"))
