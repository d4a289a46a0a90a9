import time

import pytest
from pyspark.sql import functions as F

from srcatlas.functions import classify, scalar as S
from srcatlas.functions.lexing import lex


def values(spark, cases, expr):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", expr.alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_test_files(spark):
    yes = [
        "test_users.py",
        "users_test.py",
        "users_test.go",
        "users.test.js",
        "users.test.ts",
        "users.spec.js",
        "users.spec.ts",
        "/path/to/tests/users.py",
        "/path/to/__tests__/users.js",
        "latest_data.py",
    ]
    no = ["users.py", "users.go", "users.js", "testing_utils.py", "tests/x.py", None, ""]
    assert values(spark, yes + no, S.is_test_file(F.col("x"))) == [True] * len(yes) + [False] * len(no)


def test_modules(spark):
    paths = ["src/utils/helper.py", "fisio/fisio/imports/aws.py", "main.py", "lib/auth/service.js", None]
    assert values(spark, paths, S.module_of_path(F.col("x"))) == ["src.utils.helper", "fisio.imports.aws", "main", "lib.auth.service", ""]
    assert values(spark, paths[:4], S.submodule_of_path(F.col("x"))) == ["utils", "imports", "", "auth"]
    assert values(
        spark, ["pkg/util.py", "src/pkg/sub/deep.py", "fisio/fisio/imports/aws.py", "main.py"], S.module_of_directory(F.col("x"))
    ) == ["pkg", "src.pkg.sub", "fisio.imports", "."]
    assert values(
        spark, ["fisio.common", "fisio.imports.aws", "mymodule", "a.b.c.d"], S.module_rest_of(F.col("x"))
    ) == ["common", "imports.aws", "", "b.c.d"]


def test_ids_and_keys(spark):
    assert values(spark, ["func"], S.chunk_id(F.lit("repo"), F.lit("file.py"), F.col("x"), F.lit(10))) == ["31b37b4f-43d1-e856-3d54-52a7f9825a1f"]
    assert values(spark, ["word " * 600, "x" * 2100, "ü" * 8, None], S.token_estimate(F.col("x"))) == [750, 525, 4, 0]
    one, two = values(spark, ["a", "a"], S.cache_key(F.lit("r"), F.col("x"), F.lit(42), F.lit("m"), F.lit("0")))
    other = values(spark, ["a"], S.cache_key(F.lit("r"), F.col("x"), F.lit(42), F.lit("m"), F.lit("10")))[0]
    assert one == two and other != one and one.startswith("query:r:") and one.endswith(":42")
    assert values(spark, ["q"], S.query_hash(F.col("x"), F.lit("r"))) == [S.hash_query("q", "r")]


def test_code_words(spark):
    assert values(
        spark, ["path/to/file.py", "file.js", "handler.go", "MyClass", "config"], S.is_file_path(F.col("x"))
    ) == [True, True, True, False, False]
    assert values(
        spark, ["MyClass", "get_user_by_id", "path/to/file", "file.py", "camelCase"], S.is_symbol(F.col("x"))
    ) == [True, True, False, False, False]


CLASSES = {
    "symbol": ['"validateToken"', 'find "UserService"', "what is `getUserById`", "what is getUserById", "find handleAuthError", "where is process_payment", "show me UserService", "égetUser"],
    "relationship": ["what calls validateToken", "functions that use redis", "who imports auth module", "what depends on database", "show references to config"],
    "flow": ["data flow from API to database", "how does request get to handler", "path from login to session", "routing of authentication", "pipeline for data processing"],
    "pattern": ["how do importers work", "how does the importer pattern work", "pattern for error handling", "typical structure of a test", "standard convention for models"],
    "concept": ["authentication timeout handling", "where is user validation", "error handling for database", "retry logic", "caching strategy", "user use", None],
}


@pytest.mark.parametrize("kind", CLASSES)
def test_query_types(spark, kind):
    assert values(spark, CLASSES[kind], classify.query_type(F.col("x"))) == [kind] * len(CLASSES[kind])


def test_symbol_names(spark):
    assert values(spark, [*CLASSES["symbol"], "authentication timeout", None], classify.symbol_name(F.col("x"))) == [
        "validateToken", "UserService", "getUserById", "getUserById", "handleAuthError", "process_payment", "UserService", "getUser", "", ""
    ]


def test_routes(spark):
    q = spark.createDataFrame([("what calls x",), ("retry logic",)], "query string")
    assert {
        (r["query_type"], r["depth"], r["max_results"]) for r in classify.route_queries(q).collect()
    } == {("relationship", 1, 20), ("concept", 1, 10)}


def test_cursor():
    c = S.encode_cursor("q", 20)
    assert S.decode_cursor(c, "q") == 20
    for bad, message in (("not-valid-base64!!!", "invalid cursor"), ("bm90LWpzb24=", "invalid cursor format")):
        with pytest.raises(ValueError, match=message):
            S.decode_cursor(bad)
    with pytest.raises(ValueError, match="expired"):
        S.decode_cursor(S.encode_cursor("q", 1, time.time() - 700))
    with pytest.raises(ValueError, match="another"):
        S.decode_cursor(c, "other")


def test_durations_and_sizes():
    assert [S.parse_duration(x) for x in ("7d", "24h", "1h30m", "250ms")] == [604800, 86400, 5400, 0.25]
    assert [S.embedding_size(m) for m in ("voyage-4-large", "voyage-4-lite", "else")] == [1024, 512, 1024]
    assert (S.repo_of_path("/h/repos/x/a.py", "/h/repos"), S.repo_of_path("/h/repos2/x", "/h/repos")) == ("x", "")


def test_lexer_kinds():
    js = "const a = `x ${`y ${1}`} z`; // c\nlet r = /a\\/[/]b/g.test(s) / 2; /* d */"
    kinds = [(k, js[a:b]) for k, a, b in lex(js, "script")]
    assert ("string", "`x ${`y ${1}`} z`") in kinds and ("string", "/a\\/[/]b/g") in kinds and ("comment", "/* d */") in kinds
    py = "x = r'''a\n'''  # c\ny = 'open\nz = 1"
    assert [k for k, _, _ in lex(py, "python")].count("string") == 2
