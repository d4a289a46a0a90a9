"""Search over chunks: filters, strategies by query type, graph expansion, related context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.functions import classify, scalar as S
from srcatlas.operators import embedding, graph, vectors

RESULT_COLUMNS = ["file_path", "start_line", "end_line", "kind", "symbol_name", "module_path", "heading_path", "content", "docstring"]
EXPANSION_SCORE = 0.5
CONTEXT_OVERFETCH = 5
DEFAULT_LIMIT = 10
#: Bytes of a file from which context is suggested, and of its head that make the query.
SHORTEST_FILE, QUERY_BYTES = 50, 2000


def search_filter(repo: str = "", module: str = "", include_tests: str = "include", exact_module: bool = False) -> Column:
    """Filter of a search: repo unless empty or 'all', module with everything below it (or exactly), tests included, excluded or only."""
    f = F.lit(True)
    if repo and repo != "all":
        f = f & (F.col("repo") == repo)
    if module:
        own = F.col("module_path") == module
        f = f & (own if exact_module else own | F.col("module_path").startswith(module + "."))
    if include_tests == "exclude":
        f = f & ~F.coalesce(F.col("is_test"), F.lit(False))
    elif include_tests == "only":
        f = f & F.coalesce(F.col("is_test"), F.lit(False))
    return f


def symbol_search(chunks: DataFrame, name: str, k: int, where: Column | None = None) -> DataFrame:
    return vectors.scroll(chunks, (F.col("symbol_name") == name) & (F.lit(True) if where is None else where), k).withColumn("score", F.lit(0.0))


def pattern_search(chunks: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    return vectors.scroll(chunks, (F.col("kind") == "pattern") & (F.lit(True) if where is None else where), k).withColumn("score", F.lit(0.0))


def current_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id, the one indexed last (ties: the last in the order of its columns)."""
    rest = [c for c in chunks.columns if c not in ("id", "indexed_at")]
    return chunks.where("id is not null").groupBy("id").agg(F.max(F.struct("indexed_at", *rest)).alias("c")).select("id", "c.*")


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """Rows of the first of several small results that has any, decided within the plan; each has at most a page of rows."""
    rows = [t.withColumn("_tier", F.lit(k)) for k, t in enumerate(tiers)]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r, allowMissingColumns=True)
    best = F.min("_tier").over(Window.partitionBy(F.lit(1)))
    return all_.withColumn("_best", best).where("_tier = _best").drop("_tier", "_best")


def retrieve(chunks: DataFrame, kind: str, name: str, query: Column, k: int, where: Column | None = None) -> DataFrame:
    """Chunks for one query by its type: by symbol name or pattern, and by meaning where these find nothing."""
    by_meaning = vectors.semantic_search(chunks, query, k, where=where)
    if kind in ("symbol", "relationship") and name:
        return first_tier([symbol_search(chunks, name, k, where), by_meaning])
    if kind == "pattern":
        return first_tier([pattern_search(chunks, k, where), by_meaning])
    return by_meaning


def effective_limit(asked: int | None, most: int) -> int:
    """Rows of a page: what was asked for, 10 without, lowered by what the query's type allows and never raised."""
    return min(asked if asked and asked > 0 else DEFAULT_LIMIT, most)


@dataclass
class Request:
    """A search: text, repo ('' or 'all' for every one), module, tests (include, exclude, only), page."""

    query: str
    repo: str = ""
    module: str = ""
    include_tests: str = "include"
    limit: int | None = None
    offset: int = 0


@dataclass
class Graph:
    """What expansion walks: plain edges, references by class, members of classes, symbols."""

    edges: DataFrame
    named: DataFrame
    members: DataFrame
    symbols: DataFrame


def search(chunks: DataFrame, request: Request, vector: Column, graph_tables: Callable[[], Graph] | None = None) -> DataFrame:
    """(rank, id, score, has_more, query_type and the result columns): one page of a whole search.

    The query is classified and routed; chunks come by name, pattern or meaning; where the route asks for it results are
    expanded over the graph; the page is cut from one row more than it holds. An empty query is an error; an unknown repo or
    module, or an offset behind the last row, gives no rows. `vector` is the query's embedding; `graph_tables` is called only
    where the route asks for the graph.
    """
    if not request.query.strip():
        raise ValueError("query parameter is required")
    spark = chunks.sparkSession
    route = classify.route_queries(spark.createDataFrame([(request.query,)], "query string")).head()  # one row
    limit = effective_limit(request.limit, route["max_results"])
    ahead = request.offset + limit + 1
    where = search_filter(request.repo, request.module, request.include_tests)
    found = retrieve(chunks, route["query_type"], route["symbol_name"], vector, ahead, where)
    scored = found.withColumn("score", F.coalesce("weighted", "score")) if "weighted" in found.columns else found
    if route["use_graph"] and graph_tables is not None:
        g = graph_tables()
        ranked = expand_results(
            scored,
            chunks,
            g.edges,
            g.symbols,
            route["depth"],
            ahead,
            request.repo or "all",
            where,
            g.named,
            g.members,
        )
    else:
        ranked = scored.select("id", "score").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))))  # at most a page
    page = vectors.page(ranked.select("rank", "id", "score"), request.offset, limit, F.asc("rank"))
    return page.join(chunks.select("id", "repo", *RESULT_COLUMNS), "id").select(
        "rank", "id", "score", "has_more", F.lit(route["query_type"]).alias("query_type"), "repo", *RESULT_COLUMNS
    )


def relevant_context(chunks: DataFrame, related: DataFrame, node: str, vector: Column, k: int = 5, most_related: int = 10) -> DataFrame:
    """(file_path, reason): files related over the graph to a file or folder; where there are none, the files of the k chunks nearest to its name.

    related(node, related): file nodes; at most `most_related` of them, in order. `vector`: embedding of the base name.
    """
    path = F.regexp_replace("related", r"^file:[^/]*/", "")
    by_graph = related.where(F.col("node") == node).select(path.alias("file_path")).distinct().orderBy("file_path").limit(most_related).withColumn(
        "reason", F.lit("imports/calls")
    )
    near = vectors.semantic_search(chunks, vector, k).groupBy("file_path").agg(F.max("weighted").alias("s")).select(
        "file_path", F.lit("semantically related").alias("reason")
    )
    return first_tier([by_graph, near])


def text_vector(spark, text: str, embedder: embedding.Embedder | None = None) -> Column:
    """Embedding of one text as a literal."""
    row = embedding.embed_chunks(spark.createDataFrame([(text,)], "text string"), F.col("text"), embedder).select("vector").head()
    return vectors.vector_literal(row[0])


def context_of_file(
    chunks: DataFrame, content: bytes | None, path: str, related: DataFrame, k: int = 3, embedder: embedding.Embedder | None = None
) -> DataFrame:
    """Context for a file by its text: nothing for files under 50 bytes, else by the embedding of the first 2,000 bytes."""
    if content is None or len(content) < SHORTEST_FILE:
        return related.sparkSession.createDataFrame([], "file_path string, reason string, rank int")
    text = content[:QUERY_BYTES].decode("utf-8", "ignore")
    return suggest_context(chunks, text_vector(related.sparkSession, text, embedder), path, related, k)


def expand_results(
    found: DataFrame,
    chunks: DataFrame,
    edges: DataFrame,
    symbols: DataFrame,
    depth: int,
    k: int,
    repo: str = "all",
    where: Column | None = None,
    named: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """(rank, id, score): results in their order, then one chunk per symbol reached over the graph, up to k in all.

    Symbols whose name was found already, and chunks already there, are skipped; order: distance, name, id. With repo 'all'
    the graph of every repository is used.
    """
    order = Window.orderBy(F.desc("score"), F.asc("id"))  # over the few rows found
    base = found.select("id", "repo", "symbol_name", "score").withColumn("rank", F.row_number().over(order))
    names = base.where("coalesce(symbol_name, '') <> ''").select("repo", "symbol_name").distinct()
    pool = symbols if repo in ("", "all") else symbols.where(F.col("repo") == repo)
    seeds = pool.join(F.broadcast(names), ["repo", "symbol_name"]).select(graph.symbol_node(F.col("symbol_id")).alias("node"))
    reached = graph.expand(edges, seeds, depth, named=named, members=members).where(F.col("node").startswith("symbol:"))
    more = reached.join(
        pool.withColumn("node", graph.symbol_node(F.col("symbol_id"))), "node"
    ).groupBy("repo", "symbol_name").agg(F.min("distance").alias("distance")).join(F.broadcast(names), ["repo", "symbol_name"], "left_anti")
    usable = chunks if where is None else chunks.where(where)
    first = usable.join(more, ["repo", "symbol_name"]).groupBy("repo", "symbol_name", "distance").agg(F.min("id").alias("id")).join(
        F.broadcast(base.select("id")), "id", "left_anti"
    )
    extra = first.orderBy("distance", "symbol_name", "id").limit(k).select("id", F.lit(EXPANSION_SCORE).alias("score"), "distance", "symbol_name")
    tail = extra.withColumn("rank", F.lit(1_000_000) + F.row_number().over(Window.orderBy("distance", "symbol_name", "id"))).select("rank", "id", "score")  # at most k rows
    return base.select("rank", "id", "score").unionByName(tail).orderBy("rank").limit(k).withColumn(
        "rank", F.row_number().over(Window.orderBy("rank"))
    )


def result_rows(found: DataFrame) -> DataFrame:
    """The nine fields a search answers with."""
    return found.select(*RESULT_COLUMNS)


def suggest_context(chunks: DataFrame, query: Column, path: str, related: DataFrame, k: int = 3) -> DataFrame:
    """(file_path, reason, rank): files related over the graph first, then the files of the nearest chunks, without the file itself.

    related(file_path): already ordered candidates. Nearest: the top 5k chunks, unweighted, over all repositories, best
    chunk per file.
    """
    near = vectors.top_k(chunks.where(F.col("file_path") != path), query, CONTEXT_OVERFETCH * k)
    per_file = near.groupBy("file_path").agg(
        F.max_by(F.struct("module_path", "kind"), F.struct("score", "id")).alias("c"), F.max("score").alias("score")
    )
    reason = S.relation_reason(F.lit(path), F.col("file_path"), F.col("c.module_path"), F.col("c.kind"))
    graphed = related.where(F.col("file_path") != path).select("file_path", F.lit("imports/calls").alias("reason"), F.lit(2.0).alias("score"))
    by_vector = per_file.select("file_path", reason.alias("reason"), "score").join(F.broadcast(graphed.select("file_path")), "file_path", "left_anti")
    few = graphed.unionByName(by_vector).orderBy(F.desc("score"), "file_path").limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_path"))).select("file_path", "reason", "rank")  # at most k rows
