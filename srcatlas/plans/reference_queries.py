"""Queries on dangling references, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcatlas.operators import references
from srcatlas.session import table


def _cascade(spark: SparkSession, d: str) -> references.Cascade:
    return references.cascade(*[table(spark, d, n) for n in ("relationships", "files", "symbols", "modules", "external_targets", "chunks")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The references at depth 0 of the cascade."""
    return _cascade(spark, d).references.where("depth = 0").select("rel_id", "field")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_cascade(spark, d).references)


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(_cascade(spark, d).records)


_FOUND = r"""
WITH f AS (
  SELECT repo, path, min(last_indexed) AS born, coalesce(max(deleted_at), TIMESTAMPTZ '9999-12-31') AS died
  FROM files WHERE repo IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
s AS (
  SELECT repo, symbol_name, parent, symbol_id, min(indexed_at) AS born, coalesce(max(deleted_at), TIMESTAMPTZ '9999-12-31') AS died
  FROM symbols GROUP BY ALL),
targets AS (
  SELECT repo, 'file' AS space, path AS key, born, died FROM f
  UNION ALL SELECT repo, 'py', left(path, len(path) - len(e)), born, died
    FROM f, (VALUES ('.py'), ('/__init__.py')) v(e) WHERE suffix(path, e)
  UNION ALL SELECT repo, 'js', left(path, len(path) - len(e)), born, died
    FROM f, (VALUES (''), ('.js'), ('.jsx'), ('.ts'), ('.tsx'), ('/index.js'), ('/index.ts')) v(e) WHERE suffix(path, e)
  UNION ALL SELECT repo, 'py', replace(path, '.', '/'), TIMESTAMPTZ '0001-01-01', TIMESTAMPTZ '9999-12-31' FROM modules
  UNION ALL SELECT repo, 'sym', symbol_name, born, died FROM s
  UNION ALL SELECT repo, 'dot', parent || '.' || symbol_name, born, died FROM s WHERE parent IS NOT NULL),
r0 AS (
  SELECT DISTINCT rel_id, repo, source_file, target_path, target_name, indexed_at AS t,
    list_filter(string_split(replace(coalesce(source_file, ''), '\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS seg
  FROM relationships),
r AS (
  SELECT *, array_to_string(seg, '/') AS path, seg[1:len(seg) - 1] AS dir,
    suffix(array_to_string(seg, '/'), '.py') AS py, len(target_path) - len(ltrim(target_path, '.')) AS dots
  FROM r0),
q AS (
  SELECT rel_id, 'source_file' AS field, repo, 'file' AS space, path AS key, NULL AS root, t FROM r WHERE source_file IS NOT NULL
  UNION ALL
  SELECT rel_id, 'target_path', repo, 'py',
    CASE WHEN dots = 0 THEN replace(target_path, '.', '/')
         WHEN dots - 1 <= len(dir) THEN array_to_string(list_concat(dir[1:len(dir) - dots + 1],
           list_filter([replace(ltrim(target_path, '.'), '.', '/')], lambda x: x <> '')), '/') END,
    CASE WHEN dots = 0 THEN split_part(target_path, '.', 1) END, t
  FROM r WHERE target_path IS NOT NULL AND py
  UNION ALL
  SELECT rel_id, 'target_path', repo, 'js',
    CASE WHEN dots > 0 AND source_file IS NOT NULL THEN
      regexp_replace(array_to_string(list_reduce(list_concat([''], dir, list_filter(string_split(target_path, '/'), lambda x: x NOT IN ('', '.'))),
        lambda a, x: CASE WHEN x = '..' THEN CASE WHEN a = '' THEN '//' ELSE regexp_replace(a, '/[^/]*$', '') END ELSE a || '/' || x END).string_split('/')[2:], '/'), '^/.*', '//') END,
    CASE WHEN dots = 0 THEN CASE WHEN target_path LIKE '@%' THEN split_part(target_path, '/', 1) || '/' || split_part(target_path, '/', 2)
         ELSE split_part(target_path, '/', 1) END END, t
  FROM r WHERE target_path IS NOT NULL AND NOT py
  UNION ALL
  SELECT rel_id, 'target_name', repo, CASE WHEN contains(target_name, '.') THEN 'dot' ELSE 'sym' END, target_name, target_name, t
  FROM r WHERE target_name IS NOT NULL AND split_part(target_name, '.', 1) NOT IN ('self', 'cls', 'this')),
ext AS (SELECT DISTINCT CASE target_kind WHEN 'package' THEN 'target_path' WHEN 'callable' THEN 'target_name' END AS field, target_ref FROM external_targets),
orphans AS (
  SELECT DISTINCT rel_id, field, space, repo, key, t FROM q
  WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.field = q.field AND e.target_ref = q.root)
    AND NOT EXISTS (SELECT 1 FROM targets g WHERE g.repo = q.repo AND g.space = q.space AND g.key = q.key AND g.born <= q.t AND g.died > q.t))
"""

_DAY = "CAST(t AT TIME ZONE 'UTC' AS DATE)"
_CASCADE = (
    _FOUND.replace("WITH f AS", "WITH RECURSIVE f AS", 1).rstrip()
    + f""",
sym AS (SELECT 'symbols:' || symbol_id AS node, 'symbols' AS tab, repo, file_path AS file, symbol_name AS name, parent AS up, min(indexed_at) AS t FROM symbols WHERE symbol_id IS NOT NULL GROUP BY ALL),
chk AS (SELECT 'chunks:' || id AS node, 'chunks' AS tab, repo, file_path AS file, NULL AS name, symbol_name AS up, min(indexed_at) AS t FROM chunks WHERE id IS NOT NULL GROUP BY ALL),
rel AS (SELECT DISTINCT 'relationships:' || r.rel_id AS node, 'relationships' AS tab, r.repo, CASE WHEN r.source_file IS NULL THEN NULL ELSE r.path END AS file, NULL AS name,
  string_split(o.source_name, '.')[-1] AS up, r.t FROM r JOIN relationships o ON o.rel_id = r.rel_id AND o.indexed_at IS NOT DISTINCT FROM r.t),
rec AS (SELECT * FROM sym UNION ALL SELECT * FROM chk UNION ALL SELECT * FROM rel),
fil AS (SELECT repo, path, max(module_root) AS module_root, min(last_indexed) AS t FROM files WHERE path IS NOT NULL GROUP BY ALL),
direct AS (
  SELECT 'files:' || coalesce(repo, '') || chr(31) || path AS node, 'files' AS tab, {_DAY} AS day FROM fil
    WHERE module_root IS NOT NULL AND NOT EXISTS (SELECT 1 FROM modules m WHERE m.repo = fil.repo AND m.path = fil.module_root)
  UNION ALL SELECT node, tab, {_DAY} FROM rec WHERE tab <> 'relationships' AND NOT EXISTS (SELECT 1 FROM f WHERE f.repo = rec.repo AND f.path = rec.file AND f.born <= rec.t AND f.died > rec.t)
  UNION ALL SELECT 'relationships:' || rel_id, 'relationships', {_DAY} FROM orphans),
edges AS (
  SELECT DISTINCT 'files:' || coalesce(repo, '') || chr(31) || file AS parent, node, tab, {_DAY} AS day FROM rec WHERE file IS NOT NULL
  UNION SELECT s.node, c.node, c.tab, CAST(c.t AT TIME ZONE 'UTC' AS DATE) FROM rec c JOIN sym s ON s.repo = c.repo AND s.file = c.file AND s.name = c.up
    WHERE c.up IS NOT NULL AND (c.up <> '' OR c.tab = 'relationships') AND s.node <> c.node),
walk AS (
  SELECT node, tab, day, 0 AS depth FROM (SELECT node, tab, min(day) AS day FROM direct GROUP BY ALL)
  UNION SELECT e.node, e.tab, e.day, depth + 1 FROM walk w JOIN edges e ON e.parent = w.node WHERE depth < 24),
found AS (SELECT node, tab, min(depth) AS depth, arg_min(day, (depth, day)) AS day FROM walk GROUP BY ALL)
"""
)
_TABLE = "CASE WHEN field = 'target_name' THEN 'symbols' WHEN field = 'target_path' AND space = 'py' THEN 'modules' ELSE 'files' END"

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_cascade": p2_cascade}
SQL = {
    "p2_found": _FOUND + "SELECT DISTINCT rel_id, field FROM orphans",
    "p2_report": _CASCADE
    + f""", one AS (SELECT rel_id, field, arg_min(struct_pack(space := space, repo := repo, key := key), t) AS x, min(t) AS t FROM q GROUP BY ALL),
refs AS (SELECT o.rel_id, o.field, o.x.space AS space, o.x.repo AS repo, o.x.key AS key, o.t, CASE WHEN d.rel_id IS NOT NULL THEN 'direct' ELSE 'inherited' END AS orphan_kind
  FROM one o LEFT JOIN (SELECT DISTINCT rel_id, field FROM orphans) d USING (rel_id, field) LEFT JOIN (SELECT node, depth FROM found WHERE tab = 'relationships') w ON w.node = 'relationships:' || o.rel_id
  WHERE d.rel_id IS NOT NULL OR w.depth > 0)
SELECT {_TABLE} AS target_table, {_DAY} AS day, orphan_kind, count(*) AS n_orphans, count(DISTINCT (repo, key)) AS n_keys FROM refs GROUP BY ALL""",
    "p2_cascade": _CASCADE + "SELECT tab AS table_name, day, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS orphan_kind, depth, count(*) AS n_records FROM found GROUP BY ALL",
}
