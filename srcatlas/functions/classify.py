"""Classification of search queries and their routing, as column expressions over any number of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.scalar import any_of

# -- fixed word lists and patterns
VERBS = "get|set|is|has|find|handle|create|delete|update|validate|check|process"
RELATION_WORDS = [
    "calls",
    "call",
    "calling",
    "uses",
    "use",
    "using",
    "imports",
    "import",
    "importing",
    "depends",
    "dependency",
    "dependencies",
    "references",
    "reference",
    "referencing",
    "invokes",
    "invoke",
    "invoking",
]
FLOW_WORDS = ["flow", "flows", "path from", "path to", "get to", "gets to", "route", "routing", "pipeline", "chain"]
PATTERN_WORDS = ["pattern", "patterns", "typical", "typically", "standard", "convention", "structure of", "example of"]
#: ASCII word boundaries: Java's \b takes accented letters for word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
VERB_NAME = f"{LEFT}({VERBS})[A-Z][a-zA-Z]*{RIGHT}"
SNAKE_NAME = f"{LEFT}[a-z]+(_[a-z]+)+{RIGHT}"
PASCAL_NAME = f"{LEFT}[A-Z][a-z]+([A-Z][a-z]+)+{RIGHT}"

#: query_type, semantic, symbol index, pattern index, graph expansion, depth, most results
ROUTES = [
    ("symbol", False, True, False, False, 0, 10),
    ("relationship", False, True, False, True, 1, 20),
    ("flow", True, False, False, True, 3, 15),
    ("pattern", False, False, True, False, 0, 5),
    ("concept", True, False, False, True, 1, 10),
]


def contains_word(text: Column, word: str) -> Column:
    """Whether the first occurrence of a word stands alone: after a separator, before one, an s or the end."""
    at = F.instr(text, word)
    prev = F.substr(text, at - 1, F.lit(1))
    nxt = F.substr(text, at + len(word), F.lit(1))
    marks = [" ", "\t", "\n", ",", "."]
    return (at > 0) & ((at == 1) | prev.isin(marks)) & (nxt.isin(*marks, "s") | (nxt == ""))


def query_type(query: Column) -> Column:
    """symbol, pattern, relationship, flow or concept; null counts as empty."""
    q = F.coalesce(query, F.lit(""))
    low = F.lower(q)
    return (
        F.when(q.rlike('"[^"]+"|`[^`]+`'), "symbol")
        .when(low.rlike("how do .* work") | low.rlike("how does .* work"), "pattern")
        .when(any_of([low.contains(w) for w in PATTERN_WORDS]), "pattern")
        .when(any_of([contains_word(low, w) for w in RELATION_WORDS]), "relationship")
        .when(any_of([low.contains(w) for w in FLOW_WORDS]), "flow")
        .when(q.rlike(VERB_NAME) | q.rlike(SNAKE_NAME) | q.rlike(PASCAL_NAME), "symbol")
        .otherwise("concept")
    )


def symbol_name(query: Column) -> Column:
    """Name a query asks for: quoted, back-ticked, verb camel case, Pascal case, snake case; else the empty string."""
    q = F.coalesce(query, F.lit(""))
    tries = [
        F.regexp_extract(q, p, g) for p, g in (
            ('"([^"]+)"', 1), ("`([^`]+)`", 1), (VERB_NAME, 0), (PASCAL_NAME, 0), (f"{LEFT}([a-z]+_[a-z_]+){RIGHT}", 1)
        )
    ]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit(""))


def routes(spark: SparkSession) -> DataFrame:
    """The five routes, one row each."""
    return spark.createDataFrame(
        ROUTES, "query_type string, use_semantic boolean, use_symbols boolean, use_patterns boolean, use_graph boolean, depth int, max_results int"
    )


def route_queries(queries: DataFrame, column: str = "query") -> DataFrame:
    """Queries with their type, the name they ask for and their route (a join with five rows)."""
    q = queries.withColumn("query_type", query_type(F.col(column))).withColumn("symbol_name", symbol_name(F.col(column)))
    return q.join(F.broadcast(routes(queries.sparkSession)), "query_type")
