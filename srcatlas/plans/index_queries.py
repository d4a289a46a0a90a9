"""Queries on scalar functions, chunks, vectors, classification, logs and maintenance, with their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions import classify, scalar as S
from srcatlas.operators import chunking, incremental, log_analytics, markdown, redaction, suggestions, vectors
from srcatlas.sources import repo_files
from srcatlas.session import shared_folder, table as T


def _micro(c: str):
    return F.round(F.col(c) * 1_000_000).cast("bigint").alias("score_micro")


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("label") % 3 == 0, 1.0).when(F.col("label") % 3 == 1, 0.5).otherwise(1.5)
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", w.alias("retrieval_weight"))


def _probe(rows: DataFrame):
    """Vector of the row with the lowest id: the query of the vector examples."""
    return vectors.vector_literal(rows.where("size(vector) > 0").orderBy("id").select("vector").head()[0])


def vector_topk(spark, d):
    e = _weighted(spark, d)
    return vectors.top_k(e, _probe(e), 20).select("id", "label", _micro("score"))


def vector_topk_filtered(spark, d):
    e = _weighted(spark, d)
    return vectors.top_k(e, _probe(e), 20, where=F.col("label") == 3).select("id", "label", _micro("score"))


def semantic_rerank(spark, d):
    e = _weighted(spark, d)
    return vectors.semantic_search(e, _probe(e), 15).select("id", "label", _micro("weighted"))


def chunk_vector_search(spark, d):
    from srcatlas.operators.retrieval import current_chunks

    c = current_chunks(T(spark, d, "chunks").select("id", "kind", "is_test", "retrieval_weight", "vector", "indexed_at")).where("size(vector) = 128")
    probe = c.where("not isnan(array_max(vector)) and array_max(vector) < double('infinity') and kind = 'method'")
    return vectors.semantic_search(c, _probe(probe), 10, where=~F.col("is_test")).select("id", "kind", _micro("weighted"))


def scroll_filter(spark, d):
    docs = T(spark, d, "documents")
    return vectors.scroll(
        docs, vectors.equality_filter({"lang": "en", "source": "readme", "n_chars": 5}), 20, "doc_id"
    ).select("doc_id", "lang", "source")


def include_tests_modes(spark, d):
    from srcatlas.operators.retrieval import search_filter

    c = T(spark, d, "chunks")
    return c.agg(
        *[F.count_if(search_filter("all", "", m)).alias(f"n_{m}") for m in ("include", "exclude", "only")],
        F.count_if(search_filter("", "payout", "include")).alias("n_payout"),
        F.count_if(search_filter("", "payout", "include", True)).alias("n_payout_exact"),
    )


def collection_info(spark, d):
    return vectors.collection_info(T(spark, d, "chunks"))


def chunk_ids(spark, d):
    s = T(spark, d, "symbols")
    return s.select(
        "symbol_id", S.chunk_id(F.col("repo"), F.col("file_path"), F.col("symbol_name"), F.col("start_line")).alias("chunk_id")
    ).distinct()


def content_hash(spark, d):
    return T(spark, d, "source_files").select("repo", "path", S.content_hash(F.col("content")).alias("hash")).distinct()


def token_estimate(spark, d):
    return T(spark, d, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


def test_file_flag(spark, d):
    return T(spark, d, "files").select(
        "repo",
        "path",
        S.is_test_file(F.col("path")).alias("is_test"),
        S.retrieval_weight(F.col("path")).alias("weight"),
        S.language(F.col("path")).alias("language"),
    ).distinct()


def module_resolve(spark, d):
    p = F.col("path")
    m = S.module_of_path(p)
    return T(spark, d, "files").select(
        "repo",
        "path",
        m.alias("module_path"),
        S.module_root_of(m).alias("module_root"),
        S.module_rest_of(m).alias("module_rest"),
        S.submodule_of_path(p).alias("submodule"),
        S.module_of_directory(p).alias("folder_module"),
    ).distinct()


def embedding_text(spark, d):
    return T(spark, d, "chunks").select(
        "id", F.sha2(S.embedding_text(F.col("context_header"), F.col("docstring"), F.col("content")), 256).alias("text_hash")
    ).distinct()


def query_keys(spark, d):
    q = T(spark, d, "documents").where("text is not null")
    return q.select(
        "doc_id",
        S.query_hash(F.col("text"), F.col("repo")).alias("query_hash"),
        S.cache_key(F.col("repo"), F.col("text"), F.lit(7), F.col("source")).alias("cache_key"),
    )


def _queries(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("query"))


def classify_queries(spark, d):
    return _queries(spark, d).select("doc_id", classify.query_type(F.col("query")).alias("query_type"))


def extract_symbol_name(spark, d):
    return _queries(spark, d).select("doc_id", classify.symbol_name(F.col("query")).alias("symbol_name"))


def route_queries(spark, d):
    r = classify.route_queries(_queries(spark, d))
    return r.groupBy("query_type", "use_graph", "depth", "max_results").agg(F.count("*").alias("n"))


def walk_filter(spark, d):
    return T(spark, d, "files").select("repo", "path").distinct().select("repo", "path", repo_files.path_filter(F.col("path")).alias("kept"))


def module_detection(spark, d):
    """Modules of the listed files and of the packages that the modules table names, whose marks the file table lacks."""
    packages = T(spark, d, "modules").where("fs_path is not null").select(
        "repo", F.concat(F.regexp_replace("fs_path", "/+$", ""), F.lit("/__init__.py")).alias("path")
    )
    paths = T(spark, d, "files").select("repo", "path").unionByName(packages).where("repo is not null and path is not null").distinct()
    return repo_files.detect_modules(paths).withColumn("submodules", F.array_join("submodules", ","))


def project_probe(spark, d):
    return repo_files.probe_project(T(spark, d, "files").select("repo", "path").distinct()).select(
        "repo", F.array_join("includes", ",").alias("includes")
    )


def index_counters(spark, d):
    """Counts of a whole index run over the source files."""
    from srcatlas.plans.index_pipeline import build_index

    return build_index(T(spark, d, "source_files"), "2024-08-01 00:00:00").counters()


def _first_and_last(spark, d):
    f = T(spark, d, "files")
    first = f.groupBy("repo", "path").agg(
        F.min_by("hash", F.struct("last_indexed", F.coalesce("hash", F.lit("")))).alias("hash"), F.min("last_indexed").alias("last_indexed")
    )
    last = f.groupBy("repo", "path").agg(
        F.max_by("hash", F.struct("last_indexed", F.coalesce("hash", F.lit("")))).alias("hash"), F.max("deleted_at").alias("deleted_at")
    )
    return first, last


def incremental_changed(spark, d):
    first, last = _first_and_last(spark, d)
    return incremental.changed_files(last, first).select("repo", "path", "hash")


def removed_files(spark, d):
    first, last = _first_and_last(spark, d)
    return incremental.removed_files(last.where("deleted_at is null"), first)


def upsert_chunks(spark, d):
    c = T(spark, d, "chunks").select("id", "repo", "file_path", "symbol_name", "indexed_at")
    old, new = c.where("indexed_at < timestamp'2024-03-10'"), c.where("indexed_at >= timestamp'2024-03-10'")
    return incremental.upsert_chunks(old, new, new.select("repo", "file_path")).select("id", "repo", "file_path", "indexed_at")


def index_versions(spark, d):
    return incremental.index_versions(T(spark, d, "events").select(F.col("user_id").alias("repo")))


def stale_files(spark, d):
    f = T(spark, d, "files")
    indexed = f.groupBy("repo", "path").agg(F.max("last_indexed").alias("last_indexed"))
    return incremental.stale_files(indexed, f.where("deleted_at is not null").select("repo", "path", F.col("deleted_at").alias("ts")))


def secret_detect(spark, d):
    return redaction.detect_secrets(T(spark, d, "chunks").select("id", "content").distinct()).withColumn("n", F.col("n").cast("bigint"))


def secret_redact(spark, d):
    c = T(spark, d, "chunks").select("id", "content").distinct()
    return c.select(
        "id", redaction.has_secrets(F.col("content")).alias("has_secrets"), F.sha2(redaction.redact(F.col("content")), 256).alias("content_hash")
    ).distinct()


def _one_symbol(spark, d):
    s = T(spark, d, "symbols")
    return s.groupBy("symbol_id").agg(
        F.max_by(F.struct(*[c for c in s.columns if c != "symbol_id"]), "indexed_at").alias("x")
    ).select("symbol_id", "x.*")


def hierarchical_chunks(spark, d):
    c = chunking.hierarchical_chunks(_one_symbol(spark, d), 3)
    return c.select("id", "repo", "file_path", "kind", "symbol_name", "context_header", "is_test")


def class_summaries(spark, d):
    return chunking.hierarchical_chunks(_one_symbol(spark, d), 3).where("kind = 'class_summary'").select(
        "id", "symbol_name", F.regexp_extract("content", r"Methods: (.*)$", 1).alias("methods")
    )


def flat_chunks(spark, d):
    return chunking.flat_chunks(_one_symbol(spark, d)).select(
        "id", "kind", "symbol_name", "module_path", "submodule", "context_header", "is_test", F.col("retrieval_weight").cast("double").alias("weight")
    )


def _guides(spark, d):
    docs = T(spark, d, "documents").where("source in ('agents_md', 'readme', 'wiki')")
    return docs.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")


def guide_sections(spark, d):
    return markdown.sections(_guides(spark, d)).select(
        "path", "heading", "heading_path", "level", "start_line", "end_line", F.sha2("content", 256).alias("content_hash")
    )


def guide_headings(spark, d):
    return markdown.sections(_guides(spark, d)).select("path", "heading", "level", "start_line", "end_line")


def guide_mentions(spark, d):
    return markdown.mentions(_guides(spark, d)).groupBy("path", "kind", "code").agg(F.count("*").alias("n"))


def guide_summaries(spark, d):
    return markdown.guide_summary(_guides(spark, d)).select("path", "title", "description")


def _log(spark, d):
    e = T(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "ts",
        F.lit("search").alias("event"),
        F.col("user_id").cast("string").alias("query"),
        F.col("event_type").alias("query_type"),
        F.when(k % 10 != 3, k % 7).alias("results"),
        F.col("value").alias("latency_ms"),
        (k % 5 == 0).alias("cache_hit"),
    )


def _recent(spark, d):
    return log_analytics.searches_since(_log(spark, d), F.to_timestamp(F.lit("2024-01-10 00:00:00")))


def search_summary(spark, d):
    return log_analytics.summary(_recent(spark, d))


def searches_by_type(spark, d):
    return log_analytics.by_type(_recent(spark, d))


def top_queries(spark, d):
    return log_analytics.top_queries(_recent(spark, d))


def zero_result_queries(spark, d):
    return log_analytics.zero_result_queries(_recent(spark, d))


def known_terms(spark, d):
    return suggestions.known_terms(T(spark, d, "chunks").select("id", "symbol_name").distinct(), F.col("symbol_name"))


def suggest_terms(spark, d):
    q = T(spark, d, "documents").where("source = 'search_log' and text is not null").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query")
    )
    return suggestions.suggest(q, known_terms(spark, d))


def paginate(spark, d):
    f = T(spark, d, "files").select("repo", "path").distinct()
    return vectors.page(f, 40, 25, F.asc("repo"), F.asc("path"))


def _one_version(spark, d):
    """Each path once, of several contents the one with the largest hash."""
    s = T(spark, d, "source_files")
    return s.groupBy("repo", "path").agg(F.max_by("content", F.sha2("content", 256)).alias("content"))


def python_outline(spark, d):
    """Functions and classes at the left margin of the Python files that the grammar accepts."""
    from srcatlas.operators import parsing

    sources = _one_version(spark, d).where(F.col("path").endswith(".py") & F.is_valid_utf8("content"))
    parsed = parsing.parse_files(sources).where("error is null")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    margin = sources.select(
        "repo", F.col("path").alias("file_path"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    ).where(F.col("line").rlike("^\ufeff?(async |def |class )")).select("repo", "file_path", (F.col("pos") + 1).cast("int").alias("start_line"))
    s = parsing.file_symbols(parsed).where("parent = ''").select("repo", "file_path", "symbol_name", "kind", "start_line")
    return s.join(margin, ["repo", "file_path", "start_line"], "left_semi")


def python_imports(spark, d):
    """Plain imports at the left margin of the Python files that the grammar accepts."""
    from srcatlas.operators import parsing

    sources = _one_version(spark, d).where(F.col("path").endswith(".py") & F.is_valid_utf8("content"))
    parsed = parsing.parse_files(sources).where("error is null")
    return parsing.file_relations(parsed).where("kind = 'imports' and source_name = ''").select("repo", "source_file", "source_line", "target_path")


def repo_symbols(spark, d):
    """Symbols parsed from all source files."""
    from srcatlas.operators import parsing

    parsed = parsing.parse_files(_one_version(spark, d))
    return parsing.file_symbols(parsed).select("repo", "file_path", "symbol_name", "kind", "parent", "start_line", "end_line", "signature")


def repo_relationships(spark, d):
    from srcatlas.operators import parsing

    return parsing.file_relations(parsing.parse_files(_one_version(spark, d)))


def full_index(spark, d):
    """Chunks of a whole index run over the source files."""
    from srcatlas.plans.index_pipeline import build_index

    return build_index(T(spark, d, "source_files"), "2024-08-01 00:00:00").chunks.select(
        "id", "repo", "file_path", "chunk_type", "kind", "symbol_name", "follows_pattern", "has_secrets"
    )


def embedded_chunks(spark, d):
    """Offline vectors of all chunks, checked by their lengths."""
    from srcatlas.operators.embedding import embed_chunks

    c = embed_chunks(
        T(spark, d, "chunks").select("id", "context_header", "docstring", "content").distinct(),
        S.embedding_text(F.col("context_header"), F.col("docstring"), F.col("content")),
        column="v",
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return c.select("id", F.size("v").cast("bigint").alias("dimension"), F.round(norm, 3).alias("norm"))


def refresh_stream(spark, d):
    """Symbols after the source files have arrived as a stream."""
    from srcatlas.streaming.refresh import refresh_stream as start, refreshed_symbols

    folder = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex[:12]}"
    path = f"{d}/source_files.parquet"
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if spark.read.parquet(path).inputFiles()[0].rstrip("/") != path and "/source_files.parquet/" in spark.read.parquet(path).inputFiles()[0] else spark.readStream.schema(spark.read.parquet(path).schema).option(
        "pathGlobFilter", "source_files.parquet"
    ).parquet(d)
    start(arriving, folder).awaitTermination()
    return refreshed_symbols(spark, folder).select("repo", "file_path", "symbol_name", "kind", "start_line")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_filtered, semantic_rerank, chunk_vector_search, scroll_filter, include_tests_modes, collection_info, chunk_ids, content_hash, token_estimate, test_file_flag, module_resolve,
        embedding_text, query_keys, classify_queries, extract_symbol_name, route_queries, walk_filter, module_detection, incremental_changed, removed_files, upsert_chunks, index_versions, stale_files,
        secret_detect, secret_redact, hierarchical_chunks, class_summaries, flat_chunks, guide_sections, guide_headings, guide_mentions, guide_summaries, search_summary, searches_by_type, top_queries,
        zero_result_queries, known_terms, suggest_terms, paginate, project_probe, index_counters, python_outline, python_imports, repo_symbols, repo_relationships, full_index, embedded_chunks, refresh_stream,
    )
}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, CASE label % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 1.5 END AS w FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY id LIMIT 1), s AS (SELECT id, label, w, list_cosine_similarity(v, qv) AS score FROM e, q)"
_M = "CAST(round({} * 1000000) AS BIGINT) AS score_micro"
_ID = "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12)"


def _sql_id(repo: str, path: str, name: str, line: str) -> str:
    h = f"sha256(coalesce({repo},'') || ':' || coalesce({path},'') || ':' || coalesce({name},'') || ':' || CAST(coalesce({line},0) AS VARCHAR))"
    return _ID.replace("h,", h + ",")


def _sql_test(path: str) -> str:
    return "(" + " OR ".join(f"contains(lower({path}), '{m}')" for m in S.TEST_MARKS) + ")"


def _sql_word(text: str, w: str) -> str:
    at = f"strpos({text}, '{w}')"
    return f"({at} > 0 AND ({at} = 1 OR substr({text}, {at} - 1, 1) IN (' ', chr(9), chr(10), ',', '.')) AND substr({text}, {at} + {len(w)}, 1) IN (' ', chr(9), chr(10), ',', '.', 's', ''))"


_VERB, _SNAKE, _PASCAL = rf"\b({classify.VERBS})[A-Z][a-zA-Z]*\b", r"\b[a-z]+(_[a-z]+)+\b", r"\b[A-Z][a-z]+([A-Z][a-z]+)+\b"
_TYPE = (
    "CASE WHEN regexp_matches(text, '\"[^\"]+\"|`[^`]+`') THEN 'symbol' WHEN regexp_matches(lower(text), 'how do .* work') OR regexp_matches(lower(text), 'how does .* work') THEN 'pattern' WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in classify.PATTERN_WORDS)
    + " THEN 'pattern' WHEN "
    + " OR ".join(_sql_word("lower(text)", w) for w in classify.RELATION_WORDS)
    + " THEN 'relationship' WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in classify.FLOW_WORDS)
    + f" THEN 'flow' WHEN regexp_matches(text, '{_VERB}') OR regexp_matches(text, '{_SNAKE}') OR regexp_matches(text, '{_PASCAL}') THEN 'symbol' ELSE 'concept' END"
)
_STEM = r"regexp_replace(path, '\.[^./]*$', '')"
_PARTS = f"string_split({_STEM}, '/')"
_MODULE = f"array_to_string(CASE WHEN len({_PARTS}) > 1 AND {_PARTS}[1] = {_PARTS}[2] THEN {_PARTS}[2:] ELSE {_PARTS} END, '.')"
_DIRS = "string_split(regexp_replace(path, '(^|/)[^/]*$', ''), '/')"
_FOLDER = f"array_to_string(CASE WHEN len({_DIRS}) > 1 AND {_DIRS}[1] = {_DIRS}[2] THEN {_DIRS}[2:] ELSE {_DIRS} END, '.')"
#: The default excludes and includes said in DuckDB's own words: folders anywhere above, endings of names.
_EXC_FOLDERS = "['.git', '__pycache__', 'node_modules', 'venv', '.venv', 'dist', 'build', '.idea', '.vscode']"
_KEPT = f"NOT list_has_any(string_split(path, '/'), {_EXC_FOLDERS}) AND NOT (path GLOB '*.pyc' OR path GLOB '*.min.js' OR path GLOB '*.bundle.js') AND (path GLOB '*.py' OR path GLOB '*.js' OR path GLOB '*.ts' OR path GLOB '*.tsx' OR path GLOB '*.jsx' OR path GLOB '*.go')"
_ENDS = """ends AS (SELECT repo, path, arg_min(struct_pack(h := hash), (last_indexed, coalesce(hash, ''))).h AS first_hash, arg_max(struct_pack(h := hash), (last_indexed, coalesce(hash, ''))).h AS last_hash,
  min(last_indexed) AS first_indexed, max(last_indexed) AS last_indexed, max(deleted_at) AS deleted_at FROM files GROUP BY repo, path)"""
_SYM = "sym AS (SELECT symbol_id, x.* FROM (SELECT symbol_id, arg_max(struct_pack(repo := repo, symbol_name := symbol_name, kind := kind, file_path := file_path, start_line := start_line, parent := coalesce(parent, '')), indexed_at) AS x FROM symbols GROUP BY symbol_id))"
_TREE = """members AS (SELECT repo, file_path, parent AS symbol_name, count(*) AS n, string_agg(symbol_name, ', ' ORDER BY start_line, symbol_id) AS names FROM sym WHERE parent <> '' GROUP BY ALL),
top AS (SELECT s.*, coalesce(m.n, 0) > 3 AND kind = 'class' AS big, m.names FROM sym s LEFT JOIN members m USING (repo, file_path, symbol_name) WHERE parent = ''),
method AS (SELECT s.* FROM sym s WHERE parent <> '' AND EXISTS (SELECT 1 FROM sym c WHERE c.repo = s.repo AND c.file_path = s.file_path AND c.symbol_name = s.parent AND c.kind = 'class' AND c.parent = ''))"""
_HITS = " UNION ALL ".join(
    f"SELECT id, line_no, '{name}' AS secret_type, len(list_filter(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}', 0), lambda m: NOT regexp_matches(m, '{redaction.PLACEHOLDERS}'))) AS n FROM ls" for name, p, _ in redaction.PATTERNS
)


def _sql_redacted(c: str) -> str:
    for _, p, r in redaction.PATTERNS:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '{r.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return c


_LINE_SECRET = " OR ".join(
    f"len(list_filter(regexp_extract_all(x, '{p.replace(chr(39), chr(39) * 2)}', 0), lambda m: NOT regexp_matches(m, '{redaction.PLACEHOLDERS}'))) > 0" for _, p, _ in redaction.PATTERNS
)
_SECRET = f"(len(list_filter(string_split(content, chr(10)), lambda x: {_LINE_SECRET})) > 0)"
_MASKED = f"array_to_string(list_transform(string_split(content, chr(10)), lambda x: {_sql_redacted('x')}), chr(10))"
_GUIDES = "g AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE source IN ('agents_md', 'readme', 'wiki')), l AS (SELECT path, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM g)"
_ENTRY_WORDS = "(contains(code, '/') OR " + " OR ".join(f"suffix(code, '{e}')" for e in S.FILE_ENDINGS) + ")"
_LOG = "lg AS (SELECT ts, CAST(user_id AS VARCHAR) AS query, event_type AS query_type, CASE WHEN k % 10 <> 3 THEN k % 7 END AS results, value AS latency, k % 5 = 0 AS hit FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE ts >= TIMESTAMP '2024-01-10')"
_TERMS = "terms AS (SELECT lower(symbol_name) AS term, count(*) AS n FROM (SELECT DISTINCT id, symbol_name FROM chunks) WHERE symbol_name <> '' GROUP BY 1)"
_SYN = "syn(word, term) AS (VALUES " + ", ".join(f"('{w}', '{t}')" for w, ts in suggestions.SYNONYMS.items() for t in ts) + ")"

SQL = {
    "vector_topk": f"WITH {_E} SELECT id, label, {_M.format('score')} FROM s ORDER BY score DESC, id LIMIT 20",
    "vector_topk_filtered": f"WITH {_E} SELECT id, label, {_M.format('score')} FROM s WHERE label = 3 ORDER BY score DESC, id LIMIT 20",
    "semantic_rerank": f"WITH {_E} SELECT id, label, {_M.format('score * w')} FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 30) ORDER BY score * w DESC, id LIMIT 15",
    "scroll_filter": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'readme' ORDER BY doc_id LIMIT 20",
    "include_tests_modes": "SELECT count(*) AS n_include, count(*) FILTER (NOT coalesce(is_test, false)) AS n_exclude, count(*) FILTER (coalesce(is_test, false)) AS n_only, count(*) FILTER (module_path = 'payout' OR module_path LIKE 'payout.%') AS n_payout, count(*) FILTER (module_path = 'payout') AS n_payout_exact FROM chunks",
    "collection_info": "WITH z AS (SELECT coalesce(len(vector), 0) AS n, count(*) AS c FROM chunks GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS points_count, arg_max(n, (c, n)) AS vector_size, count(*) AS n_sizes FROM z",
    "chunk_ids": f"SELECT DISTINCT symbol_id, {_sql_id('repo', 'file_path', 'symbol_name', 'start_line')} AS chunk_id FROM symbols",
    "content_hash": "SELECT DISTINCT repo, path, sha256(content) AS hash FROM source_files",
    "token_estimate": "SELECT doc_id, CAST(strlen(coalesce(text, '')) // 4 AS BIGINT) AS tokens FROM documents",
    "test_file_flag": f"SELECT DISTINCT repo, path, {_sql_test('path')} AS is_test, CASE WHEN {_sql_test('path')} THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.js') OR suffix(path, '.jsx') THEN 'javascript' WHEN suffix(path, '.ts') OR suffix(path, '.tsx') THEN 'typescript' END AS language FROM files",
    "module_resolve": f"SELECT DISTINCT repo, path, {_MODULE} AS module_path, string_split({_MODULE}, '.')[1] AS module_root, CASE WHEN contains({_MODULE}, '.') THEN substr({_MODULE}, strpos({_MODULE}, '.') + 1) ELSE '' END AS module_rest, coalesce(string_split({_MODULE}, '.')[2], '') AS submodule, CASE WHEN {_FOLDER} = '' THEN '.' ELSE {_FOLDER} END AS folder_module FROM files",
    "embedding_text": "SELECT DISTINCT id, sha256(concat_ws(chr(10) || chr(10), nullif(context_header, ''), nullif(docstring, ''), coalesce(content, ''))) AS text_hash FROM chunks",
    "query_keys": "SELECT doc_id, substr(sha256(text || ':' || coalesce(repo, '')), 1, 16) AS query_hash, 'query:' || coalesce(repo, '') || ':' || substr(sha256(text || ':' || coalesce(source, '')), 1, 16) || ':7' AS cache_key FROM documents WHERE text IS NOT NULL",
    "classify_queries": f"SELECT doc_id, {_TYPE} AS query_type FROM documents WHERE text IS NOT NULL",
    "extract_symbol_name": f"SELECT doc_id, coalesce(nullif(regexp_extract(text, '\"([^\"]+)\"', 1), ''), nullif(regexp_extract(text, '`([^`]+)`', 1), ''), nullif(regexp_extract(text, '{_VERB}', 0), ''), nullif(regexp_extract(text, '{_PASCAL}', 0), ''), nullif(regexp_extract(text, '" + r"\b([a-z]+_[a-z_]+)\b" + "', 1), ''), '') AS symbol_name FROM documents WHERE text IS NOT NULL",
    "route_queries": f"WITH r(query_type, use_graph, depth, max_results) AS (VALUES " + ", ".join(f"('{t}', {str(g).lower()}, {dp}, {mx})" for t, _, _, _, g, dp, mx in classify.ROUTES) + f") SELECT query_type, use_graph, depth, max_results, count(*) AS n FROM (SELECT {_TYPE} AS query_type FROM documents WHERE text IS NOT NULL) JOIN r USING (query_type) GROUP BY ALL",
    "walk_filter": f"SELECT DISTINCT repo, path, {_KEPT} AS kept FROM files",
    "incremental_changed": f"WITH {_ENDS} SELECT repo, path, last_hash AS hash FROM ends WHERE last_hash IS NULL OR last_hash = '' OR first_hash IS NULL OR last_hash <> first_hash",
    "removed_files": f"WITH {_ENDS} SELECT repo, path FROM ends WHERE deleted_at IS NOT NULL",
    "upsert_chunks": "WITH c AS (SELECT DISTINCT id, repo, file_path, symbol_name, indexed_at, indexed_at >= TIMESTAMPTZ '2024-03-10 00:00:00+00' AS new FROM chunks), kept AS (SELECT * FROM c WHERE new OR NOT EXISTS (SELECT 1 FROM c n WHERE n.new AND n.repo = c.repo AND n.file_path = c.file_path)) SELECT id, x.repo AS repo, x.file_path AS file_path, x.indexed_at AS indexed_at FROM (SELECT id, arg_max(struct_pack(repo := repo, file_path := file_path, indexed_at := indexed_at), indexed_at) AS x FROM kept GROUP BY id)",
    "index_versions": "SELECT user_id AS repo, count(*) AS version FROM events GROUP BY 1",
    "stale_files": f"WITH {_ENDS} SELECT repo, path, deleted_at AS ts FROM ends WHERE deleted_at >= last_indexed",
    "secret_detect": f"WITH ls AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM (SELECT DISTINCT id, content FROM chunks)), h AS ({_HITS}) SELECT id, CAST(line_no AS INT) AS line_no, secret_type, n FROM h WHERE n > 0",
    "secret_redact": f"SELECT DISTINCT id, coalesce({_SECRET}, false) AS has_secrets, sha256(CASE WHEN {_SECRET} THEN {_MASKED} ELSE content END) AS content_hash FROM chunks",
    "hierarchical_chunks": f"WITH {_SYM}, {_TREE} SELECT {_sql_id('repo', 'file_path', chr(40) + 'symbol_name || CASE WHEN big THEN ' + chr(39) + '_summary' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END' + chr(41), 'start_line')} AS id, repo, file_path, CASE WHEN big THEN 'class_summary' ELSE kind END AS kind, symbol_name, '' AS context_header, {_sql_test('file_path')} AS is_test FROM top UNION ALL SELECT {_sql_id('repo', 'file_path', 'symbol_name', 'start_line')}, repo, file_path, kind, symbol_name, '# File: ' || file_path || chr(10) || '# Class: ' || parent || chr(10) || '# Related methods in same class', {_sql_test('file_path')} FROM method",
    "class_summaries": f"WITH {_SYM}, {_TREE} SELECT {_sql_id('repo', 'file_path', chr(40) + 'symbol_name || ' + chr(39) + '_summary' + chr(39) + chr(41), 'start_line')} AS id, symbol_name, names AS methods FROM top WHERE big",
    "flat_chunks": f"WITH {_SYM}, m AS (SELECT *, file_path AS path FROM sym) SELECT {_sql_id('repo', 'file_path', 'symbol_name', 'start_line')} AS id, kind, symbol_name, {_MODULE} AS module_path, CASE WHEN contains({_MODULE}, '.') THEN substr({_MODULE}, strpos({_MODULE}, '.') + 1) ELSE '' END AS submodule, CASE WHEN kind = 'method' AND parent <> '' THEN '# File: ' || file_path || chr(10) || '# Class: ' || parent || chr(10) ELSE '' END AS context_header, {_sql_test('file_path')} AS is_test, CASE WHEN {_sql_test('file_path')} THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM m",
    "guide_headings": rf"WITH {_GUIDES}, h AS (SELECT path, n_lines, no, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS heading, len(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')) SELECT path, heading, CAST(level AS INT) AS level, CAST(no AS INT) AS start_line, CAST(coalesce(lead(no) OVER (PARTITION BY path ORDER BY no) - 2, n_lines) AS BIGINT) AS end_line FROM h",
    "guide_mentions": rf"WITH {_GUIDES}, c AS (SELECT path, unnest(regexp_extract_all(line, '`([^`]+)`', 1)) AS code FROM l), k AS (SELECT path, code, CASE WHEN {_ENTRY_WORDS} THEN 'file' WHEN NOT contains(code, '/') AND (regexp_matches(code, '^[A-Z][a-zA-Z0-9]+$') OR regexp_matches(code, '^[a-z_][a-z0-9_]+$')) THEN 'symbol' END AS kind FROM c) SELECT path, kind, code, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL",
    "search_summary": f"WITH {_LOG} SELECT count(*) AS total, count(*) FILTER (results = 0) AS zero_results, count(*) FILTER (hit) AS cache_hits, CAST(sum(CAST(trunc(latency) AS BIGINT)) // count(latency) AS BIGINT) AS avg_latency FROM lg",
    "searches_by_type": f"WITH {_LOG} SELECT query_type, count(*) AS n FROM lg GROUP BY 1",
    "top_queries": f"WITH {_LOG} SELECT query, count(*) AS n FROM lg GROUP BY 1 ORDER BY n DESC, query LIMIT 10",
    "zero_result_queries": f"WITH {_LOG} SELECT query, count(*) AS n FROM lg WHERE coalesce(results, 0) = 0 GROUP BY 1",
    "known_terms": f"WITH {_TERMS} SELECT term, n FROM terms",
    "suggest_terms": rf"WITH {_TERMS}, {_SYN}, w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE source = 'search_log' AND text IS NOT NULL)), h AS (SELECT doc_id, pos, 0 AS kind, w.word, t.term, n FROM w JOIN syn USING (word) JOIN terms t ON t.term = syn.term UNION ALL SELECT doc_id, pos, 1, word, term, n FROM w JOIN terms ON contains(term, word) OR contains(word, term)), f AS (SELECT doc_id, term, arg_min(struct_pack(kind := kind, word := word, n := n), (pos, kind)) AS x FROM h GROUP BY ALL), r AS (SELECT doc_id AS query_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, term) AS INT) AS rank, term, x.n AS n, CASE x.kind WHEN 0 THEN 'synonym for ''' || x.word || '''' ELSE 'partial match' END AS reason FROM f) SELECT * FROM r WHERE rank <= 5",
    "paginate": "WITH f AS (SELECT DISTINCT repo, path FROM files) SELECT repo, path, (SELECT count(*) FROM f) > 65 AS has_more FROM f ORDER BY repo, path LIMIT 25 OFFSET 40",
    "chunk_vector_search": "WITH c AS (SELECT id, x.* FROM (SELECT id, arg_max(struct_pack(kind := kind, t := is_test, w := retrieval_weight::DOUBLE, v := vector::DOUBLE[]), indexed_at) AS x FROM chunks WHERE id IS NOT NULL GROUP BY id) WHERE len(x.v) = 128), q AS (SELECT v AS qv FROM c WHERE NOT isnan(list_max(v)) AND list_max(v) < 'infinity'::DOUBLE AND kind = 'method' ORDER BY id LIMIT 1),"
    " n AS (SELECT id, kind, w, CASE WHEN isnan(sqrt(list_dot_product(v, v))) OR sqrt(list_dot_product(v, v)) = 0 OR sqrt(list_dot_product(v, v)) = 'infinity'::DOUBLE THEN 0 ELSE list_cosine_similarity(v, qv) END AS score FROM c, q WHERE NOT t ORDER BY score DESC, id LIMIT 20) SELECT id, kind, CAST(round(score * w * 1000000) AS BIGINT) AS score_micro FROM n ORDER BY score * w DESC, id LIMIT 10",
    "module_detection": r"""WITH p AS (SELECT DISTINCT repo, string_split(path, '/') AS p FROM (SELECT repo, path FROM files UNION ALL SELECT repo, regexp_replace(fs_path, '/+$', '') || '/__init__.py' FROM modules WHERE fs_path IS NOT NULL) WHERE repo IS NOT NULL AND path IS NOT NULL),
      x AS (SELECT repo, p, p[1] AS module FROM p WHERE len(p) > 1 AND NOT p[1][1] = '.' AND p[1] NOT IN ('node_modules', 'venv', '__pycache__')),
      k AS (SELECT repo, module, bool_or(p = [module, '__init__.py']) AS py, bool_or(p = [module, 'package.json']) AS node, bool_or(p = [module, 'go.mod']) AS go, bool_or(p[2] = p[1] AND coalesce(p[3], '') = '__init__.py') AS nested FROM x GROUP BY 1, 2),
      n AS (SELECT repo, module, CASE WHEN py THEN 'Python package' WHEN node THEN 'Node package' WHEN go THEN 'Go module' ELSE 'Python package' END AS kind, CASE WHEN nested AND NOT py THEN 1 ELSE 0 END AS b FROM k WHERE py OR node OR go OR nested),
      s AS (SELECT DISTINCT repo, module, p[b + 2] AS sub FROM x JOIN n USING (repo, module) WHERE len(p) = b + 3 AND NOT regexp_matches(p[b + 2], '^[._]') AND regexp_matches(p[b + 3], '^__init__\.py$|\.(py|js|ts|go)$'))
      SELECT repo, module, kind, kind || ': ' || module AS description, coalesce((SELECT string_agg(sub, ',' ORDER BY sub) FROM s WHERE s.repo = n.repo AND s.module = n.module), '') AS submodules FROM n""",
    "project_probe": "WITH t AS (SELECT repo, bool_or(len(string_split(path, '/')) <= 2 AND suffix(path, '.py')) AS py, bool_or(len(string_split(path, '/')) <= 2 AND suffix(path, '.go')) AS go, bool_or(len(string_split(path, '/')) <= 2 AND (suffix(path, '.js') OR suffix(path, '.ts'))) AS js FROM files GROUP BY 1)"
    " SELECT repo, CASE WHEN py OR go OR js THEN concat_ws(',', CASE WHEN py THEN '**/*.py' END, CASE WHEN go THEN '**/*.go' END, CASE WHEN js THEN '**/*.js,**/*.ts,**/*.jsx,**/*.tsx' END) ELSE '**/*.py,**/*.go,**/*.js,**/*.ts' END AS includes FROM t",
    "python_outline": r"""WITH c AS (SELECT repo, path AS file_path, arg_max(content, sha256(content)) AS b FROM source_files WHERE suffix(path, '.py') GROUP BY 1, 2), t AS (SELECT repo, file_path, string_split(regexp_replace(decode(b), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM c WHERE TRY(decode(b)) IS NOT NULL),
      l AS (SELECT repo, file_path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM t)
      SELECT repo, file_path, regexp_extract(line, '^\x{FEFF}?(?:async +)?(?:def|class) +(\w+)', 1) AS symbol_name, CASE WHEN contains(split_part(line, '(', 1), 'def ') THEN 'function' ELSE 'class' END AS kind, CAST(no AS INT) AS start_line FROM l WHERE regexp_matches(line, '^\x{FEFF}?(?:async +)?(?:def|class) +\w+')""",
    "python_imports": r"""WITH c AS (SELECT repo, path AS source_file, arg_max(content, sha256(content)) AS b FROM source_files WHERE suffix(path, '.py') GROUP BY 1, 2), t AS (SELECT repo, source_file, string_split(regexp_replace(decode(b), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM c WHERE TRY(decode(b)) IS NOT NULL),
      l AS (SELECT repo, source_file, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS source_line FROM t)
      SELECT repo, source_file, source_line, unnest(string_split(regexp_replace(regexp_extract(line, '^\x{FEFF}?import +([\w., ]+)', 1), ' ', '', 'g'), ',')) AS target_path FROM l WHERE regexp_matches(line, '^\x{FEFF}?import +[\w., ]+$') AND NOT contains(line, ' as ')
      UNION ALL SELECT repo, source_file, source_line, regexp_extract(line, '^\x{FEFF}?from +([\w.]+) +import', 1) FROM l WHERE regexp_matches(line, '^\x{FEFF}?from +[\w.]+ +import')""",
    "guide_sections": rf"""WITH {_GUIDES}, h AS (SELECT path, n_lines, no, regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2) AS heading, len(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level, lead(no) OVER (PARTITION BY path ORDER BY no) AS nxt FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')),
      st AS (SELECT h.path, h.no, string_agg(g.heading, ' > ' ORDER BY g.level) AS heading_path FROM h JOIN h g ON g.path = h.path AND g.no <= h.no WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.path = h.path AND x.no > g.no AND x.no <= h.no AND x.level <= g.level) GROUP BY 1, 2),
      bd AS (SELECT h.path, h.no, string_agg(line || chr(10), '' ORDER BY l.no) AS content FROM h JOIN l ON l.path = h.path AND l.no > h.no AND (h.nxt IS NULL OR l.no < h.nxt) GROUP BY 1, 2)
      SELECT h.path, heading, heading_path, CAST(level AS INT) AS level, CAST(h.no AS INT) AS start_line, CAST(coalesce(nxt - 2, n_lines) AS BIGINT) AS end_line, sha256(coalesce(content, '')) AS content_hash FROM h JOIN st ON st.path = h.path AND st.no = h.no LEFT JOIN bd ON bd.path = h.path AND bd.no = h.no""",
    "guide_summaries": rf"WITH {_GUIDES}, k AS (SELECT *, len(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) AS level FROM l), t AS (SELECT path, min(no) AS no, arg_min(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2), no) AS title FROM k WHERE level = 1 GROUP BY 1) SELECT g.path, coalesce(t.title, '') AS title, coalesce((SELECT arg_min(trim(line), k.no) FROM k WHERE k.path = g.path AND k.no > t.no AND level = 0 AND trim(line) <> ''), '') AS description FROM (SELECT DISTINCT path FROM g) g LEFT JOIN t USING (path)",
    "embedded_chunks": r"SELECT DISTINCT id, 128::BIGINT AS dimension, CASE WHEN regexp_matches(concat_ws(chr(10), context_header, docstring, content), '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM (SELECT DISTINCT id, context_header, docstring, content FROM chunks)",
}
