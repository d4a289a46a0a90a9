import json

import pytest
from pyspark.sql import functions as F

from srcatlas.plans.index_pipeline import build_index, index_edges
from srcatlas.sources import event_log, repo_files, settings
from srcatlas.streaming.refresh import refresh_stream, refreshed_symbols


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_walk_and_read(spark, tmp_path):
    tree(
        tmp_path,
        {
            "main.py": "x",
            "pkg/__init__.py": "",
            "node_modules/f.py": "x",
            ".git/f.py": "x",
            "dist/f.py": "x",
            "a.min.js": "x",
            "src/pkg/deep.py": "x",
            "generated.py": "x",
            "notes.txt": "x",
        },
    )
    got = list(repo_files.walk(str(tmp_path), excludes=["**/generated.py", "src/*"]))
    assert got == ["main.py", "pkg/__init__.py"]
    rows = repo_files.read_tree(spark, str(tmp_path), "r").collect()
    assert {r["path"] for r in rows} == {"main.py", "pkg/__init__.py", "src/pkg/deep.py", "generated.py"} and all(len(r["hash"]) == 64 for r in rows)
    paths = spark.createDataFrame([(p,) for p in ["main.py", "node_modules/f.py", "src/pkg/deep.py", "notes.txt"]], "path string")
    assert [
        r["k"] for r in paths.select(repo_files.path_filter(F.col("path"), excludes=["src/*"]).alias("k")).collect()
    ] == [True, False, False, False]


def test_module_detection(spark):
    paths = [
        "mypkg/__init__.py",
        "mypkg/utils/__init__.py",
        "mypkg/models/x.py",
        "mypkg/_private/__init__.py",
        "frontend/package.json",
        "svc/go.mod",
        "dbl/dbl/__init__.py",
        ".git/x",
        "node_modules/__init__.py",
        "plain/readme.md",
        "top.py",
    ]
    got = {
        r["module"]: (r["kind"], r["submodules"]) for r in repo_files.detect_modules(
            spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
        ).collect()
    }
    assert got == {
        "mypkg": ("Python package", ["models", "utils"]),
        "frontend": ("Node package", []),
        "svc": ("Go module", []),
        "dbl": ("Python package", []),
    }


def test_git_head(tmp_path):
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    first = repo_files.git_head(str(tmp_path))
    (tmp_path / ".git/refs/heads/main").write_text("abc123\n")
    assert len(first) == 16 and repo_files.git_head(str(tmp_path)) == "abc123"


def test_event_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    event_log.append_event(str(path), "search", query="a", results=0)
    with path.open("a") as f:
        f.write("not json\n" + json.dumps({"event": "search", "ts": "never"}) + "\n")
    rows = event_log.read_log(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["query"] == "a"


def test_settings(tmp_path):
    assert settings.load_settings(str(tmp_path / "none")).query_ttl_minutes == 10
    with pytest.raises(FileNotFoundError):
        settings.load_repo_settings(str(tmp_path))
    assert settings.write_repo_settings(str(tmp_path), "x", ["**/*.py"]) and not settings.write_repo_settings(str(tmp_path), "x", [])
    assert settings.load_repo_settings(str(tmp_path)).includes == ["**/*.py"]


SOURCES = [
    (
        "r",
        "greeter.py",
        b"from helpers import helper\n\ndef greet(name):\n    return helper(name)\n\nclass Greeter:\n    def __init__(self):\n        self.x = 1\n    def greet(self):\n        return greet('x')\n",
    ),
    ("r", "helpers.py", b"def helper(n):\n    return n\n"),
    ("r", "AGENTS.md", b"# Guide\ntext\n"),
    ("r", "x.go", b"package x"),
    ("r", "helpers.py", b"def helper(n):\n    return n\n"),
    ("r", "null.py", None),
]


def test_index_pipeline(spark):
    ix = build_index(spark.createDataFrame(SOURCES, "repo string, path string, content binary"), "2024-01-01 00:00:00", with_vectors=True)
    chunks = ix.chunks.collect()
    assert {(c["kind"], c["symbol_name"]) for c in chunks} == {
        ("function", "greet"),
        ("class", "Greeter"),
        ("method", "__init__"),
        ("method", "greet"),
        ("function", "helper"),
        ("navigation", ""),
    }
    assert all(len(c["vector"]) == 128 for c in chunks) and len({c["id"] for c in chunks}) == len(chunks)
    types = {r["type"] for r in index_edges(ix).collect()}
    assert types == {"CONTAINS", "IMPORTS", "CALLS"} and {r["path"] for r in ix.errors.collect()} == {"x.go", "AGENTS.md"}


def test_refresh_stream(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    schema = "repo string, path string, content binary"
    for version in (b"def one(): pass\n", b"def two(): pass\n"):
        spark.createDataFrame([("r", "a.py", version), ("r", "b.py", b"def same(): pass\n")], schema).write.mode("append").parquet(str(inbox))
        refresh_stream(spark.readStream.schema(schema).parquet(str(inbox)), folder).awaitTermination()
    rows = refreshed_symbols(spark, folder).collect()
    assert {(r["symbol_name"], r["batch"]) for r in rows} == {("two", 1), ("same", 0)}


def test_refresh_takes_the_newest_version_and_forgets_emptied_and_deleted_files(spark, tmp_path):
    from srcatlas.streaming.refresh import _prepare, apply_batch, refreshed_files

    folder = str(tmp_path / "log")
    _prepare(spark, folder)
    schema = "repo string, path string, content binary, at int, deleted boolean"

    def names():
        return {(r["file_path"], r["symbol_name"]) for r in refreshed_symbols(spark, folder).collect()}

    first = [
        ("r", "a.py", b"def zz(): pass\n", 1, None),
        ("r", "a.py", b"def b(): pass\n", 2, False),
        ("r", "c.py", b"def c(): pass\n", 1, False),
        ("r", "d.py", b"def d(): pass\n", 1, None),
        (None, "x.py", b"", 1, None),
    ]
    apply_batch(spark.createDataFrame(first, schema), folder, 0, order="at")
    assert names() == {("a.py", "b"), ("c.py", "c"), ("d.py", "d")}
    second = [("r", "a.py", b"", 3, False), ("r", "c.py", None, 3, True), ("r", "d.py", b"def d(): pass\n", 9, False)]
    for _ in range(2):  # a repeated batch overwrites itself
        apply_batch(spark.createDataFrame(second, schema), folder, 1, order="at")
    assert names() == {("d.py", "d")} and {r["path"] for r in refreshed_files(spark, folder).collect()} == {"a.py", "d.py"}
    apply_batch(spark.createDataFrame([("r", "c.py", b"def c2(): pass\n", 1, False)], schema), folder, 2)
    assert names() == {("d.py", "d"), ("c.py", "c2")}


def test_sync_follows_heads(spark, tmp_path):
    from srcatlas.streaming.refresh import refreshed_files, sync_repositories

    root, folder = tmp_path / "repo", str(tmp_path / "log")
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "HEAD").write_text("a" * 40)
    (root / "a.py").write_text("def a(): pass\n")
    (root / "b.py").write_text("def b(): pass\n")
    assert sync_repositories(spark, {"r": str(root)}, folder) == ["r"] and sync_repositories(spark, {"r": str(root)}, folder) == []
    (root / "b.py").unlink()
    assert refreshed_symbols(spark, folder).count() == 2
    (root / ".git" / "HEAD").write_text("b" * 40)
    assert sync_repositories(spark, {"r": str(root)}, folder) == ["r"]
    assert [r["path"] for r in refreshed_files(spark, folder).collect()] == ["a.py"] and refreshed_symbols(spark, folder).count() == 1


def test_project_probe(spark):
    paths = spark.createDataFrame([("p", "src/a.py"), ("p", "a/b/c.go"), ("j", "x.ts"), ("n", "readme.md")], "repo string, path string")
    assert {r["repo"]: r["includes"] for r in repo_files.probe_project(paths).collect()} == {
        "p": ["**/*.py"],
        "j": ["**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx"],
        "n": repo_files.DEFAULT_PROJECT,
    }
