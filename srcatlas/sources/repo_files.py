"""Source trees as tables: a Python data source that lists and reads files by globs.

Spark's own file sources hide names that begin with `_` or `.`, so `__init__.py` would be lost; this reader returns them.
The driver lists paths only; contents are read by the tasks.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# -- default globs, fixed values
INCLUDES = ["**/*.py", "**/*.js", "**/*.ts", "**/*.tsx", "**/*.jsx", "**/*.go"]
EXCLUDES = [
    "**/.git/**",
    "**/__pycache__/**",
    "**/*.pyc",
    "**/node_modules/**",
    "**/venv/**",
    "**/.venv/**",
    "**/dist/**",
    "**/build/**",
    "**/.idea/**",
    "**/.vscode/**",
    "**/*.min.js",
    "**/*.bundle.js",
]
FILES_PER_PARTITION = 256


def glob_regex(glob: str) -> str:
    """A glob as an anchored expression: `**` crosses slashes and may be nothing, `*` and `?` stay within a segment, `{a,b}` and `[...]` as usual."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def path_filter(path: Column, includes: list[str] | None = None, excludes: list[str] | None = None) -> Column:
    """Whether a walk keeps a path: no default or given exclude matches it or a folder above it, and an include matches."""
    ex = [glob_regex(g) for g in [*EXCLUDES, *(excludes or [])]]
    parts = F.split(path, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), n), "/")).otherwise(F.lit("\x00")),
    )
    pruned = F.exists(above, lambda d: F.concat(d, F.lit("/")).rlike("|".join(ex)) | d.rlike("|".join(ex)))
    return ~pruned & ~path.rlike("|".join(ex)) & path.rlike("|".join(glob_regex(g) for g in (includes or INCLUDES)))


def walk(root: str, includes: list[str] | None = None, excludes: list[str] | None = None) -> Iterator[str]:
    """Relative paths in depth-first lexical order; an excluded folder is not entered. Errors of listing are raised."""
    ex = re.compile("|".join(glob_regex(g) for g in [*EXCLUDES, *(excludes or [])]))
    inc = re.compile("|".join(glob_regex(g) for g in (includes or INCLUDES)))

    def inside(folder: str) -> Iterator[str]:
        for e in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if not (ex.match(rel + "/") or ex.match(rel)):
                    yield from inside(rel)
            elif not ex.match(rel) and inc.match(rel):
                yield rel

    yield from inside("")


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.repo = options["path"], options.get("repo", "")
        self.includes = [g for g in options.get("includes", "").split("\n") if g]
        self.excludes = [g for g in options.get("excludes", "").split("\n") if g]

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root, self.includes, self.excludes))
        return [_Slice(paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                with open(os.path.join(self.root, p), "rb") as f:
                    yield self.repo, p, f.read(), None
            except OSError as e:
                yield self.repo, p, None, str(e)


class RepoFiles(DataSource):
    """`spark.read.format("repo_files").option("path", root).option("repo", name).load()`."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "repo string, path string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, repo: str, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """(repo, path, content, error, hash) of a tree; unreadable files have an error and no hash."""
    spark.dataSource.register(RepoFiles)
    r = spark.read.format("repo_files").option("path", root).option("repo", repo).option(
        "includes", "\n".join(includes or [])
    ).option("excludes", "\n".join(excludes or []))
    return r.load().withColumn("hash", F.sha2("content", 256))


def detect_modules(paths: DataFrame) -> DataFrame:
    """(repo, module, kind, description, submodules) of the top-level folders of paths(repo, path).

    By what a folder holds, in this order: `__init__.py`, `package.json`, `go.mod`, a folder of its own name with
    `__init__.py`. Hidden, dependency and cache folders don't count. Submodules of a Python package: its folders with
    `__init__.py`, or with source files directly inside, not beginning with `.` or `_`.
    """
    p = F.split("path", "/")
    x = paths.select("repo", p.alias("p"), F.get(p, F.lit(0)).alias("module")).where("size(p) > 1").where(
        ~F.col("module").startswith(".") & ~F.col("module").isin("node_modules", "venv", "__pycache__")
    )

    def at(*parts: Column | str) -> Column:
        want = F.array(*[F.lit(s) if isinstance(s, str) else s for s in parts])
        return F.coalesce(F.max(F.col("p") == want), F.lit(False))

    m = F.col("module")
    flags = x.groupBy("repo", "module").agg(
        at(m, "__init__.py").alias("py"),
        at(m, "package.json").alias("node"),
        at(m, "go.mod").alias("go"),
        F.coalesce(F.max((F.get("p", F.lit(1)) == F.get("p", F.lit(0))) & (F.get("p", F.lit(2)) == "__init__.py")), F.lit(False)).alias("nested"),
    )
    kind = F.when(F.col("py"), "Python package").when(F.col("node"), "Node package").when(F.col("go"), "Go module").when(
        F.col("nested"), "Python package"
    )
    named = flags.select("repo", "module", kind.alias("kind"), (F.col("nested") & ~F.col("py")).alias("inner")).where("kind is not null")
    base = F.when(F.col("inner"), 1).otherwise(0)
    subs = x.join(
        named.select("repo", "module", "inner"), ["repo", "module"]
    ).withColumn("sub", F.get("p", base + 1)).where(F.size("p") == base + 3).where(~F.col("sub").rlike(r"^[._]"))
    keep = subs.where(
        F.get("p", base + 2).rlike(r"^__init__\.py$|\.(py|js|ts|go)$")
    ).groupBy("repo", "module").agg(F.array_sort(F.collect_set("sub")).alias("submodules"))
    return named.join(keep, ["repo", "module"], "left").select(
        "repo",
        "module",
        "kind",
        F.concat("kind", F.lit(": "), "module").alias("description"),
        F.coalesce("submodules", F.array().cast("array<string>")).alias("submodules"),
    )


#: What tells a kind of project, and what is then indexed; the usual globs where nothing tells. Fixed values.
PROJECT_MARKS = [([".py"], ["**/*.py"]), ([".go"], ["**/*.go"]), ([".js", ".ts"], ["**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx"])]
DEFAULT_PROJECT = ["**/*.py", "**/*.go", "**/*.js", "**/*.ts"]


def probe_project(paths: DataFrame) -> DataFrame:
    """(repo, includes): globs for the kinds of files that lie at the root or one folder below; the usual ones where there are none."""
    near = F.size(F.split("path", "/")) <= 2
    told = [
        F.max(near & F.coalesce(F.col("path").rlike("(" + "|".join(re.escape(e) for e in ends) + ")$"), F.lit(False))) for ends, _ in PROJECT_MARKS
    ]
    globs = [F.when(t, F.array(*[F.lit(g) for g in gs])).otherwise(F.array().cast("array<string>")) for t, (_, gs) in zip(told, PROJECT_MARKS)]
    probed = paths.groupBy("repo").agg(F.concat(*globs).alias("includes"))
    return probed.select(
        "repo", F.when(F.size("includes") > 0, F.col("includes")).otherwise(F.array(*[F.lit(g) for g in DEFAULT_PROJECT])).alias("includes")
    )


def git_head(root: str) -> str:
    """Commit of HEAD by git, else what .git/HEAD says; a reference without a commit gives a hash of its text."""
    try:
        r = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
        return r.stdout.strip()
    except (OSError, subprocess.SubprocessError):
        pass
    with open(os.path.join(root, ".git", "HEAD")) as f:
        text = f.read().strip()
    if not text.startswith("ref: "):
        return text
    ref = os.path.join(root, ".git", text[5:])
    if os.path.exists(ref):
        with open(ref) as f:
            return f.read().strip()
    import hashlib

    return hashlib.sha256(text.encode()).digest()[:8].hex()
