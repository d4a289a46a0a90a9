"""Queries on the graph, patterns and search composition, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.operators import graph, patterns, retrieval, vectors
from srcatlas.session import materialize, table as T


def _parts(spark, d):
    return graph.current_files(T(spark, d, "files")), graph.current_symbols(T(spark, d, "symbols"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_edges(T(spark, d, "relationships"), T(spark, d, "files"), T(spark, d, "symbols"))


def _largest_repo(symbols: DataFrame) -> str:
    row = symbols.groupBy("repo").count().orderBy(F.desc("count"), "repo").head()
    return row[0] if row else ""


def contains_edges(spark, d):
    return graph.contains_edges(*_parts(spark, d))


def import_edges(spark, d):
    return graph.import_edges(T(spark, d, "relationships"), _parts(spark, d)[0])


def call_edges(spark, d):
    return graph.reference_edges(T(spark, d, "relationships"), _parts(spark, d)[1], "calls")


def extends_edges(spark, d):
    return graph.reference_edges(T(spark, d, "relationships"), _parts(spark, d)[1], "extends")


def symbol_by_name(spark, d):
    s = _parts(spark, d)[1]
    return s.where("symbol_name in ('run', 'load', 'start')").select("symbol_id", "repo", "file_path", "start_line", "end_line")


def callers(spark, d):
    s = _parts(spark, d)[1]
    return graph.callers(call_edges(spark, d), s, _largest_repo(s), "run").select("symbol_id", "symbol_name", "file_path")


def callees(spark, d):
    s = _parts(spark, d)[1]
    return graph.callees(call_edges(spark, d), s, _largest_repo(s), "run").select("symbol_id", "symbol_name", "file_path")


def _graph(spark: SparkSession, d: str) -> retrieval.Graph:
    """The tables that traversal reads, each written once: current symbols, what contains them, references by classes, members."""
    f, s = _parts(spark, d)
    s, rel = materialize(s, "symbols"), T(spark, d, "relationships")
    named = graph.reference_classes(rel, s, "calls").unionByName(graph.reference_classes(rel, s, "extends"))
    return retrieval.Graph(materialize(graph.contains_edges(f, s), "contains"), materialize(named, "classes"), materialize(graph.name_classes(s), "members"), s)


def _related(spark: SparkSession, d: str) -> DataFrame:
    f, s = _parts(spark, d)
    rel = T(spark, d, "relationships")
    return graph.related_files(graph.import_edges(rel, f), graph.reference_classes(rel, s, "calls"), graph.name_classes(s), s)


def related_files(spark, d):
    return _related(spark, d)


def _seeds(s: DataFrame) -> DataFrame:
    return s.where((F.col("repo") == _largest_repo(s)) & (F.col("symbol_name") == "run")).select(graph.symbol_node(F.col("symbol_id")).alias("node"))


def expand_khop(spark, d):
    g = _graph(spark, d)
    return graph.expand(g.edges, _seeds(g.symbols), 2, named=g.named, members=g.members)


def expand_limited(spark, d):
    """The same, but only the 20 nearest nodes."""
    g = _graph(spark, d)
    return graph.expand(g.edges, _seeds(g.symbols), 2, named=g.named, members=g.members, most=20)


def expand_basic(spark, d):
    return graph.expand_basic(_edges(spark, d), _seeds(_parts(spark, d)[1]))


def files_by_hash(spark, d):
    f = T(spark, d, "files")
    some = f.where("hash is not null and deleted_at is null").agg(F.min("hash")).head()[0] or ""
    return graph.files_with_hash(f, some)


def _patterns(spark: SparkSession, d: str) -> patterns.Patterns:
    return patterns.detect_patterns(_parts(spark, d)[1], 2, 0.5)


def graph_nodes(spark, d):
    f, s = _parts(spark, d)
    n = graph.graph_nodes(T(spark, d, "repositories"), T(spark, d, "modules"), f, s, _patterns(spark, d).found)
    return n.where("label <> 'Symbol'")


def structure_edges(spark, d):
    f = _parts(spark, d)[0]
    return graph.structure_edges(
        T(spark, d, "repositories"), T(spark, d, "modules"), graph.import_edges(T(spark, d, "relationships"), f), f, _patterns(spark, d).members
    )


def upsert_symbols(spark, d):
    s = T(spark, d, "symbols").select("symbol_id", "repo", "symbol_name", "indexed_at")
    cut = F.lit("2024-03-10 00:00:00").cast("timestamp")
    old = s.where(F.col("indexed_at") < cut).groupBy("symbol_id").agg(F.max(F.struct("indexed_at", "repo", "symbol_name")).alias("x"))
    old = old.select("symbol_id", "x.repo", "x.symbol_name", "x.indexed_at")
    return graph.upsert(old, s.where(F.col("indexed_at") >= cut), ["symbol_id"], "indexed_at").select("symbol_id", "repo", "symbol_name")


def delete_file_cascade(spark, d):
    f = T(spark, d, "files").groupBy("repo", "path").agg(F.max("deleted_at").alias("deleted_at"))
    s = T(spark, d, "symbols").select("symbol_id", "repo", "file_path").distinct()
    edges = graph.contains_edges(f, s)
    kept, left = graph.delete_files(edges, s, f.where("deleted_at is not null"))
    return kept.select(
        graph.symbol_node(F.col("symbol_id")).alias("node"), F.lit("symbol").alias("what")
    ).unionByName(left.select(F.col("dst").alias("node"), F.lit("edge").alias("what")))


def delete_repository(spark, d):
    f, s = _parts(spark, d)
    files, symbols, edges = graph.delete_repository(graph.contains_edges(f, s), f, s, _largest_repo(s))
    return files.select(F.lit("files").alias("what")).unionByName(
        symbols.select(F.lit("symbols").alias("what"))
    ).unionByName(edges.select(F.lit("edges").alias("what"))).groupBy("what").agg(F.count("*").alias("n"))


def file_signature(spark, d):
    return patterns.file_signatures(_parts(spark, d)[1]).select(
        "repo", "file_path", "has_class", "class_name", F.array_join("methods", ",").alias("methods"), "has_init"
    )


def jaccard_to_leader(spark, d):
    sig = patterns.file_signatures(_parts(spark, d)[1])
    led = patterns.cluster_files(sig)
    lead = sig.select("repo", F.col("file_path").alias("cluster"), F.col("methods").alias("leader_methods"))
    return led.join(sig, ["repo", "file_path"]).join(lead, ["repo", "cluster"]).select(
        "repo",
        "file_path",
        "cluster",
        F.round(patterns.jaccard(F.col("methods"), F.col("leader_methods")) * 1000).cast("bigint").alias("similarity_milli"),
    )


def pattern_clusters(spark, d):
    return patterns.cluster_files(patterns.file_signatures(_parts(spark, d)[1]))


def pattern_detection(spark, d):
    return _patterns(spark, d).found.select(
        "repo", "name", "description", F.array_join("methods", ",").alias("methods"), "canonical_file", "member_count"
    )


def pattern_chunks(spark, d):
    return patterns.pattern_chunks(_patterns(spark, d)).select("id", "repo", "symbol_name", "file_path", F.sha2("content", 256).alias("content_hash"))


def follows_pattern(spark, d):
    c = T(spark, d, "chunks").select("id", "repo", "file_path", "follows_pattern").distinct()
    return patterns.mark_pattern_members(c, _patterns(spark, d)).groupBy("repo", "follows_pattern").agg(F.count("*").alias("n_chunks"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.current_chunks(
        T(spark, d, "chunks").select(
            "id",
            "repo",
            "file_path",
            "start_line",
            "end_line",
            "kind",
            "symbol_name",
            "module_path",
            "heading_path",
            "content",
            "docstring",
            "is_test",
            "retrieval_weight",
            "vector",
            "indexed_at",
        )
    )


def _first_vector(c: DataFrame) -> list[float]:
    """Vector of the usable chunk of a function with the lowest id: the query of the examples."""
    row = c.where(
        "kind = 'function' and size(vector) = 128 and not isnan(array_max(vector)) and array_max(vector) < double('infinity')"
    ).orderBy("id").select("vector").head()
    return row[0] if row else [0.0] * 128


def expansion_merge(spark, d):
    c, g = _chunks(spark, d), _graph(spark, d)
    found = vectors.scroll(c, (F.col("symbol_name") == "run") & (F.col("repo") == _largest_repo(g.symbols)), 10)
    found = found.withColumn("score", F.lit(1.0))
    return retrieval.expand_results(found, c, g.edges, g.symbols, 2, 20, named=g.named, members=g.members)


def _search(spark, d, text: str, **request) -> DataFrame:
    c = _chunks(spark, d)
    found = retrieval.search(c, retrieval.Request(text, **request), vectors.vector_literal(_first_vector(c)), lambda: _graph(spark, d))
    return found.select(
        "rank", "id", F.round(F.col("score") * 1_000_000).cast("bigint").alias("score_micro"), "has_more", "query_type", "file_path", "symbol_name"
    )


def search_symbol(spark, d):
    """Second page of a search for a name."""
    return _search(spark, d, "where is `run`", limit=7, offset=5)


def search_pattern(spark, d):
    """A search for a pattern, which falls back to meaning where no chunk is one."""
    return _search(spark, d, "typical structure of a queue", limit=50, include_tests="exclude")


def search_concept(spark, d):
    """A search by meaning that is expanded over the graph."""
    return _search(spark, d, "caching strategy", limit=10)


def suggest_context(spark, d):
    c = _chunks(spark, d).where("size(vector) = 128")
    row = c.where(
        "kind = 'function' and not isnan(array_max(vector)) and array_max(vector) < double('infinity')"
    ).orderBy("id").select("file_path", "vector", "repo").head()
    own = f"file:{row['repo']}/{row['file_path']}"
    rel = _related(spark, d).where(F.col("node") == own).select(F.regexp_replace("related", r"^file:[^/]*/", "").alias("file_path"))
    return retrieval.suggest_context(c, vectors.vector_literal(row["vector"]), row["file_path"], rel)


def relevant_context(spark, d):
    """Context of the first file, by path, that relates to others."""
    rel = materialize(_related(spark, d), "related")
    c = _chunks(spark, d)
    node = rel.agg(F.min("node")).head()[0]
    return retrieval.relevant_context(c, rel, node, vectors.vector_literal(_first_vector(c)))


def relevant_context_folder(spark, d):
    """Context of a folder, which relates to nothing over the graph."""
    c = _chunks(spark, d)
    return retrieval.relevant_context(c, _related(spark, d), "file:no/such/folder", vectors.vector_literal(_first_vector(c)))


QUERIES = {
    f.__name__: f
    for f in (
        contains_edges, import_edges, call_edges, extends_edges, symbol_by_name, callers, callees, related_files, expand_khop, expand_limited, expand_basic, files_by_hash, graph_nodes, structure_edges, upsert_symbols, delete_file_cascade, delete_repository,
        file_signature, jaccard_to_leader, pattern_clusters, pattern_detection, pattern_chunks, follows_pattern, expansion_merge, suggest_context, search_symbol, search_pattern, search_concept, relevant_context, relevant_context_folder,
    )
}

_BASE = """
WITH RECURSIVE f AS (SELECT repo, path FROM files WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL HAVING max(deleted_at) IS NULL),
s AS (SELECT symbol_id, x.* FROM (SELECT symbol_id, max(deleted_at) AS gone, arg_max(struct_pack(repo := repo, symbol_name := symbol_name, kind := kind, file_path := file_path, start_line := start_line, end_line := end_line, parent := parent), indexed_at) AS x FROM symbols GROUP BY 1) WHERE gone IS NULL),
top AS (SELECT repo FROM s GROUP BY 1 ORDER BY count(*) DESC, repo LIMIT 1),
r0 AS (SELECT DISTINCT rel_id, repo, kind, source_line, target_path, target_name, array_to_string(list_filter(string_split(replace(source_file, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS src FROM relationships),
r AS (SELECT *, string_split(src, '/')[1:len(string_split(src, '/')) - 1] AS dir, suffix(src, '.py') AS py, len(target_path) - len(ltrim(target_path, '.')) AS dots FROM r0),
pyk AS (SELECT repo, left(path, len(path) - len(e)) AS key, path FROM f, (VALUES ('.py'), ('/__init__.py')) v(e) WHERE suffix(path, e)),
keys AS (SELECT repo, 'py' AS space, key, arg_min(path, (dropped, path)) AS target FROM (SELECT repo, key, path, 0 AS dropped FROM pyk UNION ALL
    SELECT repo, array_to_string(string_split(key, '/')[2:], '/'), path, 1 FROM pyk WHERE string_split(key, '/')[1] = string_split(key, '/')[2]) GROUP BY ALL
  UNION ALL SELECT repo, 'js', left(path, len(path) - len(e)), min(path) FROM f, (VALUES (''), ('.js'), ('.jsx'), ('.ts'), ('.tsx'), ('/index.js'), ('/index.ts')) v(e) WHERE suffix(path, e) GROUP BY ALL),
looks AS (SELECT repo, src, CASE WHEN coalesce(py, false) THEN 'py' ELSE 'js' END AS space, CASE WHEN coalesce(py, false) THEN
    CASE WHEN dots = 0 THEN replace(target_path, '.', '/') WHEN dots - 1 <= len(dir) THEN array_to_string(list_concat(dir[1:len(dir) - dots + 1], list_filter([replace(ltrim(target_path, '.'), '.', '/')], lambda x: x <> '')), '/') END
  WHEN dots > 0 AND src IS NOT NULL THEN regexp_replace(array_to_string(list_reduce(list_concat([''], dir, list_filter(string_split(target_path, '/'), lambda x: x NOT IN ('', '.'))),
    lambda a, x: CASE WHEN x = '..' THEN CASE WHEN a = '' THEN '//' ELSE regexp_replace(a, '/[^/]*$', '') END ELSE a || '/' || x END).string_split('/')[2:], '/'), '^/.*', '//') END AS key
  FROM r WHERE kind = 'imports' AND target_path IS NOT NULL),
imports AS (SELECT DISTINCT 'IMPORTS' AS type, 'file:' || l.repo || '/' || src AS src, 'file:' || l.repo || '/' || target AS dst FROM looks l JOIN keys k USING (repo, space, key) JOIN f ON f.repo = l.repo AND f.path = l.src),
inner_sym AS (SELECT r.kind, r.repo, r.src AS file_path, r.source_line, string_split(target_name, '.')[-1] AS name, arg_max(s.symbol_id, (s.start_line, -s.end_line, s.symbol_id)) AS caller
  FROM (SELECT DISTINCT kind, repo, src, source_line, target_name FROM r WHERE kind IN ('calls', 'extends') AND target_name IS NOT NULL) r JOIN s ON s.repo = r.repo AND s.file_path = r.src AND r.source_line BETWEEN s.start_line AND s.end_line GROUP BY ALL),
refs AS (SELECT DISTINCT upper(i.kind) AS type, 'symbol:' || caller AS src, 'symbol:' || t.symbol_id AS dst FROM inner_sym i JOIN s t ON t.repo = i.repo AND t.symbol_name = i.name
  WHERE t.file_path = i.file_path OR NOT EXISTS (SELECT 1 FROM s z WHERE z.repo = i.repo AND z.symbol_name = i.name AND z.file_path = i.file_path)),
contains AS (SELECT 'CONTAINS' AS type, 'file:' || s.repo || '/' || path AS src, 'symbol:' || symbol_id AS dst FROM s JOIN f ON f.repo = s.repo AND f.path = s.file_path),
edges AS (SELECT * FROM contains UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM refs),
seeds AS (SELECT 'symbol:' || symbol_id AS node FROM s WHERE symbol_name = 'run' AND repo = (SELECT repo FROM top)),
und AS (SELECT src, dst FROM edges WHERE type <> 'IMPORTS' UNION SELECT dst, src FROM edges WHERE type <> 'IMPORTS'),
hop AS (SELECT node, 0 AS d FROM seeds UNION SELECT u.dst, d + 1 FROM hop JOIN und u ON u.src = hop.node WHERE d < 2)
"""

def _pattern_sql(similarity: float, least: int) -> str:
    """Signatures, distinct method sets in order of their first paths, leaders one set after the other, clusters and patterns."""
    alike = "len(list_intersect(x.m, {m})) >= " + str(similarity) + " * len(list_distinct(list_concat(x.m, {m})))"
    return f"""
, sig AS (SELECT repo, file_path, bool_or(kind = 'class') AS has_class, coalesce(arg_max(symbol_name, (start_line, symbol_id)) FILTER (kind = 'class'), '') AS class_name,
  coalesce(list_sort(list(symbol_name) FILTER (kind = 'method')), []) AS methods FROM s GROUP BY 1, 2),
keyed AS (SELECT *, list_sort(list_distinct(methods)) AS m FROM sig),
sets AS (SELECT repo, m, first_path, row_number() OVER (PARTITION BY repo ORDER BY first_path) AS k FROM (SELECT repo, m, min(file_path) AS first_path FROM keyed WHERE has_class AND len(m) > 0 GROUP BY ALL)),
steps AS (SELECT repo, k, [struct_pack(p := first_path, m := m)] AS ls FROM sets WHERE k = 1
  UNION ALL SELECT s.repo, s.k, CASE WHEN len(list_filter(l.ls, lambda x: {alike.format(m='s.m')})) > 0 THEN l.ls ELSE list_append(l.ls, struct_pack(p := s.first_path, m := s.m)) END FROM steps l JOIN sets s ON s.repo = l.repo AND s.k = l.k + 1),
leaders AS (SELECT repo, arg_max(ls, k) AS ls FROM steps GROUP BY 1),
led AS (SELECT s.repo, s.m, list_min(list_transform(list_filter(ls, lambda x: x.p <= s.first_path AND {alike.format(m='s.m')}), lambda x: x.p)) AS cluster FROM sets s JOIN leaders USING (repo)),
member AS (SELECT k.repo, k.file_path, k.class_name, k.methods, k.m, CASE WHEN has_class AND len(k.m) > 0 THEN led.cluster ELSE k.file_path END AS cluster FROM keyed k LEFT JOIN led ON led.repo = k.repo AND led.m = k.m),
big AS (SELECT repo, cluster, count(*) AS member_count, min(file_path) AS canonical_file, min(reverse(nullif(class_name, ''))) AS lo, max(reverse(nullif(class_name, ''))) AS hi FROM member GROUP BY 1, 2 HAVING count(*) >= {least}),
ending AS (SELECT *, reverse(left(lo, coalesce(list_max(list_filter(range(0, least(len(lo), len(hi)) + 1), lambda i: left(lo, i) = left(hi, i))), 0))) AS sfx FROM big),
common AS (SELECT repo, cluster, string_agg(x, ',' ORDER BY x) AS methods FROM (SELECT b.repo, b.cluster, x, count(*) AS n, any_value(member_count) AS c FROM (SELECT repo, cluster, unnest(methods) AS x FROM member) u JOIN big b USING (repo, cluster) GROUP BY ALL) WHERE n >= (c * 8) // 10 GROUP BY 1, 2),
pat AS (SELECT e.repo, e.cluster, CASE WHEN lo IS NULL THEN 'Unknown' WHEN strlen(sfx) >= 4 THEN sfx ELSE 'Pattern' END AS name, coalesce(c.methods, '') AS methods, canonical_file, member_count FROM ending e LEFT JOIN common c ON c.repo = e.repo AND c.cluster = e.cluster),
found AS (SELECT *, 'Classes following the ' || name || ' pattern implement: ' || replace(methods, ',', ', ') AS description FROM pat)
"""


_PATTERNS = _BASE + _pattern_sql(0.5, 2)
_HASH = "h AS (SELECT *, sha256(repo || ':patterns:' || name || ':0') AS h FROM found)"
_CHUNKS = """, ck AS (SELECT id, x.* FROM (SELECT id, arg_max(struct_pack(repo := repo, file_path := file_path, kind := kind, symbol_name := symbol_name, module_path := module_path, is_test := is_test, w := retrieval_weight::DOUBLE, v := vector::DOUBLE[]), indexed_at) AS x FROM chunks WHERE id IS NOT NULL GROUP BY id)),
usable AS (SELECT *, coalesce(len(v) = 128 AND NOT isnan(list_max(v)) AND list_max(v) < 'infinity'::DOUBLE AND sqrt(list_dot_product(v, v)) > 0 AND sqrt(list_dot_product(v, v)) < 'infinity'::DOUBLE, false) AS ok FROM ck),
q AS (SELECT v AS qv, file_path AS qf, repo AS qr FROM ck WHERE kind = 'function' AND len(v) = 128 AND NOT isnan(list_max(v)) AND list_max(v) < 'infinity'::DOUBLE ORDER BY id LIMIT 1),
scored AS (SELECT *, CASE WHEN ok THEN list_cosine_similarity(v, qv) ELSE 0 END AS score FROM usable, q)
"""
_EXPANDED = """, reached AS (SELECT node, min(d) AS distance FROM walk WHERE node NOT IN (SELECT node FROM start) GROUP BY 1),
more AS (SELECT s.repo, s.symbol_name, min(distance) AS distance FROM reached JOIN s ON 'symbol:' || s.symbol_id = node WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.repo = s.repo AND b.symbol_name = s.symbol_name AND b.symbol_name <> '') GROUP BY 1, 2),
firsts AS (SELECT min(c.id) AS id, m.symbol_name, distance FROM ck c JOIN more m ON m.repo = c.repo AND m.symbol_name = c.symbol_name GROUP BY c.repo, m.symbol_name, distance),
extra AS (SELECT id, symbol_name, distance FROM firsts WHERE id NOT IN (SELECT id FROM base) ORDER BY distance, symbol_name, id LIMIT {k}),
merged AS (SELECT id, score, row_number() OVER (ORDER BY tier, a, b, c, d) AS rank FROM (SELECT id, score, 0 AS tier, -score AS a, id AS b, '' AS c, '' AS d FROM base UNION ALL SELECT id, 0.5, 1, distance, symbol_name, id, '' FROM extra))
"""


def _walk_sql(depth: int) -> str:
    return f""", start AS (SELECT DISTINCT 'symbol:' || symbol_id AS node FROM s JOIN (SELECT DISTINCT repo, symbol_name FROM base WHERE coalesce(symbol_name, '') <> '') USING (repo, symbol_name)),
walk AS (SELECT node, 0 AS d FROM start UNION SELECT u.dst, d + 1 FROM walk JOIN und u ON u.src = walk.node WHERE d < {depth})"""


_HOME = "home AS (SELECT 'symbol:' || symbol_id AS sy, 'file:' || repo || '/' || file_path AS fi FROM s)"
_RELATED = _BASE + f", {_HOME}, p AS (SELECT src AS a, dst AS b FROM imports UNION SELECT x.fi, y.fi FROM refs e JOIN home x ON x.sy = e.src JOIN home y ON y.sy = e.dst WHERE type = 'CALLS'), rl AS (SELECT a AS node, b AS related FROM p UNION SELECT b, a FROM p)"

SQL = {
    "contains_edges": _BASE + "SELECT * FROM contains",
    "import_edges": _BASE + "SELECT * FROM imports",
    "call_edges": _BASE + "SELECT * FROM refs WHERE type = 'CALLS'",
    "extends_edges": _BASE + "SELECT * FROM refs WHERE type = 'EXTENDS'",
    "symbol_by_name": _BASE + "SELECT symbol_id, repo, file_path, start_line, end_line FROM s WHERE symbol_name IN ('run', 'load', 'start')",
    "callers": _BASE + "SELECT c.symbol_id, c.symbol_name, c.file_path FROM refs e JOIN seeds ON e.dst = seeds.node JOIN s c ON 'symbol:' || c.symbol_id = e.src WHERE e.type = 'CALLS'",
    "callees": _BASE + "SELECT c.symbol_id, c.symbol_name, c.file_path FROM refs e JOIN seeds ON e.src = seeds.node JOIN s c ON 'symbol:' || c.symbol_id = e.dst WHERE e.type = 'CALLS'",
    "related_files": _BASE + f", {_HOME}, p AS (SELECT src AS a, dst AS b FROM imports UNION SELECT x.fi, y.fi FROM refs e JOIN home x ON x.sy = e.src JOIN home y ON y.sy = e.dst WHERE type = 'CALLS') SELECT a AS node, b AS related FROM p UNION SELECT b, a FROM p",
    "expand_khop": _BASE + "SELECT node, CAST(min(d) AS INT) AS distance FROM hop WHERE node NOT IN (SELECT node FROM seeds) GROUP BY 1",
    "expand_basic": _BASE + "SELECT dst AS node FROM refs JOIN seeds ON src = node UNION SELECT src FROM refs JOIN seeds ON dst = node",
    "upsert_symbols": "SELECT symbol_id, x.repo AS repo, x.symbol_name AS symbol_name FROM (SELECT symbol_id, arg_max(struct_pack(repo := repo, symbol_name := symbol_name), (indexed_at >= TIMESTAMPTZ '2024-03-10 00:00:00+00', indexed_at)) AS x FROM symbols GROUP BY 1)",
    "delete_file_cascade": "WITH f AS (SELECT repo, path, max(deleted_at) AS gone FROM files GROUP BY ALL), s AS (SELECT DISTINCT symbol_id, repo, file_path AS path FROM symbols), k AS (SELECT symbol_id, f.path IS NOT NULL AS has FROM s LEFT JOIN f USING (repo, path) WHERE gone IS NULL) SELECT 'symbol:' || symbol_id AS node, 'symbol' AS what FROM k UNION ALL SELECT 'symbol:' || symbol_id, 'edge' FROM k WHERE has",
    "delete_repository": _BASE + "SELECT 'files' AS what, count(*) AS n FROM f WHERE repo <> (SELECT repo FROM top) UNION ALL SELECT 'symbols', count(*) FROM s WHERE repo <> (SELECT repo FROM top) UNION ALL SELECT 'edges', count(*) FROM contains JOIN s ON dst = 'symbol:' || symbol_id WHERE repo <> (SELECT repo FROM top)",
    "file_signature": _BASE + "SELECT repo, file_path, bool_or(kind = 'class') AS has_class, coalesce(arg_max(symbol_name, (start_line, symbol_id)) FILTER (kind = 'class'), '') AS class_name, coalesce(string_agg(symbol_name, ',' ORDER BY symbol_name) FILTER (kind = 'method'), '') AS methods, coalesce(bool_or(kind = 'method' AND symbol_name IN ('__init__', 'constructor')), false) AS has_init FROM s GROUP BY 1, 2",
    "expand_limited": _BASE + "SELECT node, CAST(min(d) AS INT) AS distance FROM hop WHERE node NOT IN (SELECT node FROM seeds) GROUP BY 1 ORDER BY 2, 1 LIMIT 20",
    "files_by_hash": "WITH h AS (SELECT min(hash) AS h FROM files WHERE deleted_at IS NULL) SELECT repo, path, h AS hash FROM files, h WHERE hash = h AND repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL HAVING max(deleted_at) IS NULL",
    "jaccard_to_leader": _BASE
    + _pattern_sql(0.8, 2)
    + "SELECT m.repo, m.file_path, m.cluster, CAST(round(CASE WHEN len(m.m) + len(l.m) = 0 THEN 0 ELSE len(list_intersect(m.m, l.m)) / len(list_distinct(list_concat(m.m, l.m))) END * 1000) AS BIGINT) AS similarity_milli FROM member m JOIN member l ON l.repo = m.repo AND l.file_path = m.cluster",
    "pattern_clusters": _BASE + _pattern_sql(0.8, 2) + "SELECT repo, file_path, cluster FROM member",
    "pattern_detection": _PATTERNS + "SELECT repo, name, description, methods, canonical_file, member_count FROM found",
    "pattern_chunks": _PATTERNS
    + f", {_HASH}, ls AS (SELECT repo, cluster, string_agg('- ' || file_path || chr(10), '' ORDER BY file_path) AS files FROM member GROUP BY 1, 2)"
    + " SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12) AS id, repo, name AS symbol_name, canonical_file AS file_path,"
    + " sha256('# ' || name || ' Pattern' || chr(10) || chr(10) || description || chr(10) || chr(10) || '## Example Files' || chr(10) || files || chr(10) || '## Canonical Example' || chr(10) || canonical_file || chr(10)) AS content_hash FROM h JOIN ls USING (repo, cluster)",
    "follows_pattern": _PATTERNS
    + ", fp AS (SELECT m.repo, m.file_path, min(f.name) AS follows_pattern FROM member m JOIN found f USING (repo, cluster) GROUP BY 1, 2) SELECT c.repo, fp.follows_pattern, count(*) AS n_chunks FROM (SELECT DISTINCT id, repo, file_path, follows_pattern FROM chunks) c LEFT JOIN fp ON fp.repo = c.repo AND fp.file_path = c.file_path GROUP BY ALL",
    "graph_nodes": _PATTERNS
    + "SELECT 'repository:' || repo AS node, 'Repository' AS label, repo AS name FROM repositories UNION SELECT 'module:' || repo || '/' || path, 'Module', path FROM modules WHERE repo IN (SELECT repo FROM repositories) UNION SELECT 'file:' || repo || '/' || path, 'File', path FROM f UNION SELECT 'pattern:' || repo || '/' || name, 'Pattern', name FROM found",
    "structure_edges": _PATTERNS.replace("f AS (SELECT repo, path FROM files", "roots AS (SELECT repo, path, arg_max(struct_pack(r := module_root), (last_indexed, coalesce(module_root, ''))).r AS root FROM files GROUP BY 1, 2), f AS (SELECT repo, path FROM files", 1)
    + ", hm AS (SELECT 'file:' || f.repo || '/' || f.path AS file, 'module:' || f.repo || '/' || root AS module FROM f JOIN roots USING (repo, path) WHERE EXISTS (SELECT 1 FROM modules m WHERE m.repo = f.repo AND m.path = root))"
    + " SELECT 'CONTAINS' AS type, 'repository:' || repo AS src, 'module:' || repo || '/' || path AS dst FROM modules WHERE repo IN (SELECT repo FROM repositories) UNION SELECT 'DEPENDS_ON', a.module, b.module FROM imports i JOIN hm a ON a.file = i.src JOIN hm b ON b.file = i.dst WHERE a.module <> b.module"
    + " UNION SELECT 'FOLLOWED_BY', 'pattern:' || m.repo || '/' || p.name, 'file:' || m.repo || '/' || m.file_path FROM member m JOIN found p USING (repo, cluster) JOIN f ON f.repo = m.repo AND f.path = m.file_path",
    "expansion_merge": _BASE
    + _CHUNKS
    + ", base AS (SELECT id, repo, symbol_name, 1.0 AS score FROM ck WHERE symbol_name = 'run' AND repo = (SELECT repo FROM top) ORDER BY id LIMIT 10)"
    + _walk_sql(2)
    + _EXPANDED.format(k=20)
    + "SELECT CAST(rank AS INT) AS rank, id, score::DOUBLE AS score FROM merged WHERE rank <= 20",
    "search_symbol": _BASE
    + _CHUNKS
    + "SELECT CAST(row_number() OVER (ORDER BY id) + 5 AS INT) AS rank, id, 0 AS score_micro, (SELECT count(*) FROM ck WHERE symbol_name = 'run') > 12 AS has_more, 'symbol' AS query_type, file_path, symbol_name FROM (SELECT * FROM ck WHERE symbol_name = 'run' ORDER BY id LIMIT 7 OFFSET 5)",
    "search_pattern": _BASE
    + _CHUNKS
    + ", two AS (SELECT * FROM scored WHERE NOT coalesce(is_test, false) ORDER BY score DESC, id LIMIT 12), six AS (SELECT *, score * coalesce(w, 1) AS wt FROM two ORDER BY score * coalesce(w, 1) DESC, id LIMIT 6)"
    + " SELECT CAST(row_number() OVER (ORDER BY wt DESC, id) AS INT) AS rank, id, CAST(round(wt * 1000000) AS BIGINT) AS score_micro, (SELECT count(*) FROM six) > 5 AS has_more, 'pattern' AS query_type, file_path, symbol_name FROM (SELECT * FROM six ORDER BY wt DESC, id LIMIT 5)",
    "search_concept": _BASE
    + _CHUNKS
    + ", two AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 22), base AS (SELECT id, repo, symbol_name, score * coalesce(w, 1) AS score FROM two ORDER BY score * coalesce(w, 1) DESC, id LIMIT 11)"
    + _walk_sql(1)
    + _EXPANDED.format(k=11)
    + "SELECT CAST(m.rank AS INT) AS rank, m.id, CAST(round(m.score * 1000000) AS BIGINT) AS score_micro, (SELECT count(*) FROM merged) > 10 AS has_more, 'concept' AS query_type, file_path, symbol_name FROM merged m JOIN ck USING (id) WHERE m.rank <= 10",
    "suggest_context": _RELATED
    + _CHUNKS
    + ", g AS (SELECT DISTINCT regexp_replace(related, '^file:[^/]*/', '') AS file_path, 'imports/calls' AS reason, 2.0::DOUBLE AS score FROM rl, q WHERE node = 'file:' || qr || '/' || qf AND regexp_replace(related, '^file:[^/]*/', '') <> qf),"
    + " near AS (SELECT * FROM scored WHERE len(v) = 128 AND file_path <> qf ORDER BY score DESC, id LIMIT 15), pf AS (SELECT file_path, arg_max(struct_pack(m := module_path, k := kind, qf := qf), (score, id)) AS c, max(score) AS score FROM near GROUP BY 1),"
    + " al AS (SELECT * FROM g UNION ALL SELECT file_path, CASE WHEN regexp_replace(c.qf, '(^|/)[^/]*$', '') = regexp_replace(file_path, '(^|/)[^/]*$', '') THEN 'same directory' WHEN string_split(regexp_replace(c.qf, '(^|/)[^/]*$', ''), '/')[-1] <> '' AND contains(coalesce(c.m, ''), string_split(regexp_replace(c.qf, '(^|/)[^/]*$', ''), '/')[-1]) THEN 'same module' WHEN coalesce(c.k, '') <> '' THEN 'similar ' || c.k ELSE 'semantically related' END, score FROM pf WHERE file_path NOT IN (SELECT file_path FROM g))"
    + " SELECT file_path, reason, CAST(row_number() OVER (ORDER BY score DESC, file_path) AS INT) AS rank FROM al ORDER BY rank LIMIT 3",
    "relevant_context": _RELATED + "SELECT DISTINCT regexp_replace(related, '^file:[^/]*/', '') AS file_path, 'imports/calls' AS reason FROM rl WHERE node = (SELECT min(node) FROM rl) ORDER BY 1 LIMIT 10",
    "relevant_context_folder": _BASE
    + _CHUNKS
    + "SELECT DISTINCT file_path, 'semantically related' AS reason FROM (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10) ORDER BY score * coalesce(w, 1) DESC, id LIMIT 5)",
}
