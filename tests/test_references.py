from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from srcatlas.operators.references import cascade, merge_intervals, orphan_counts, orphan_references, orphan_report
from tests.brute_references import brute_orphans

T0 = datetime(2024, 3, 1, tzinfo=UTC)
FILES = "repo string, path string, module_root string, last_indexed timestamp, deleted_at timestamp"
SYMBOLS = "symbol_id bigint, repo string, symbol_name string, parent string, file_path string, indexed_at timestamp, deleted_at timestamp"
RELS = "rel_id bigint, repo string, kind string, source_file string, source_name string, target_path string, target_name string, indexed_at timestamp, loaded_at timestamp, repo_extra string"


def at(days):
    return None if days is None else T0 + timedelta(days=days)


def tables(spark, rels):
    files = [
        ("r", "pkg/a.py", "pkg", at(0), None),
        ("r", "pkg/a.py", "pkg", at(9), None),
        ("r", "pkg/sub/__init__.py", "pkg", at(0), at(5)),
        ("r", "web/x.ts", "gone", at(0), None),
        ("r", "web/lib/index.js", None, at(3), None),
        ("q", "pkg/b.py", None, at(0), None),
    ]
    symbols = [
        (1, "r", "run", "Job", "pkg/a.py", at(0), None),
        (1, "r", "run", "Job", "pkg/a.py", at(8), None),
        (2, "r", "load", None, "pkg/a.py", at(4), at(6)),
        (3, "r", "load", None, "pkg/a.py", at(7), None),
        (4, "r", "Job", None, "missing.py", at(0), None),
        (5, "r", "inner", "Job", "missing.py", at(0), None),
    ]
    return (
        spark.createDataFrame(rels, RELS),
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(symbols, SYMBOLS),
        spark.createDataFrame([("r", "pkg.core", "pkg/core/", None)], "repo string, path string, fs_path string, description string"),
        spark.createDataFrame(
            [("package", "python", "os"), ("package", "js", "@orb/ui"), ("callable", "python", "len")],
            "target_kind string, lang string, target_ref string",
        ),
    )


def rel(i, src, path=None, name=None, day=2, repo="r"):
    return (i, repo, "imports", src, "f", path, name, at(day), at(day), "x")


CASES = [
    rel(1, "./pkg//a.py", "os.path"), rel(2, "pkg\\a.py", ".sub"), rel(3, "pkg/a.py", ".sub", day=7), rel(4, "pkg/a.py", "..pkg.a"), rel(5, "pkg/a.py", "....x"), rel(6, "pkg/a.py", "pkg.core"),
    rel(7, "pkg/a.py", "."), rel(8, "web/x.ts", "./lib", day=4), rel(9, "web/x.ts", "./lib", day=1), rel(10, "web/x.ts", "../../up"), rel(11, "web/x.ts", "@orb/ui/deep"), rel(12, "web/x.ts", "@orb"), rel(13, None, "./x"),
    rel(14, None, None, "load", 5), rel(15, None, None, "load", 6), rel(16, None, None, "load", 7), rel(17, None, None, "Job.run"), rel(18, None, None, "Job.none"), rel(19, None, None, "self.x"), rel(20, None, None, "len"),
    rel(21, "nope.py", None, "Len"), rel(22, "", "", ""), rel(22, "", "", ""), rel(23, "pkg/b.py", None, "run", repo="q"), (24, None, "calls", "pkg/a.py", "f", None, "run", at(2), at(2), "x"), (25, "r", "calls", "pkg/a.py", "f", None, "run", None, at(2), "x"),
]


def test_matches_brute_force(spark):
    t = tables(spark, CASES)
    got = {(r["rel_id"], r["field"]) for r in orphan_references(*t).collect()}
    rows = [[r.asDict() for r in x.collect()] for x in t]
    rows[0] = [r for r in rows[0] if r["repo"] is not None and r["indexed_at"] is not None]
    want = brute_orphans(*rows)
    extra = {(24, "source_file"), (24, "target_name"), (25, "source_file"), (25, "target_name")}  # null repo or time: nothing resolves
    assert got == want | extra
    assert (3, "target_path") in got and (2, "target_path") not in got and (15, "target_name") in got and (14, "target_name") not in got


def test_report_counts_each_reference_once(spark):
    rows = orphan_report(orphan_references(*tables(spark, CASES)).withColumn("depth", F.lit(0))).collect()
    assert sum(r["n_orphans"] for r in rows) == orphan_references(*tables(spark, CASES)).count()


def test_empty_tables(spark):
    empty = [x.limit(0) for x in tables(spark, CASES)]
    assert orphan_references(*empty).count() == 0
    only = orphan_references(tables(spark, CASES)[0], *empty[1:])
    assert only.where("field = 'source_file'").count() == len({c[0] for c in CASES if c[3] is not None})


def test_intervals_merge(spark):
    rows = [("k", at(0), at(2)), ("k", at(1), at(3)), ("k", at(3), at(4)), ("k", at(6), at(7)), ("k", at(6), at(9)), ("m", at(0), at(1))]
    out = merge_intervals(spark.createDataFrame(rows, "key string, born timestamp, died timestamp"), ["key"]).collect()
    assert sorted((r["key"], (r["died"] - r["born"]).days) for r in out) == [("k", 3), ("k", 4), ("m", 1)]


def test_cascade_inherits(spark):
    rels, files, symbols, modules, ext = tables(spark, [rel(1, "web/x.ts", "@orb/ui"), rel(2, "missing.py", None, "run", 2)])
    chunks = spark.createDataFrame(
        [("c1", "r", "web/x.ts", None, at(1)), ("c2", "r", "missing.py", "inner", at(1))],
        "id string, repo string, file_path string, symbol_name string, indexed_at timestamp",
    )
    out = {
        (r["table_name"], r["orphan_kind"]): r["n_records"] for r in orphan_counts(
            cascade(rels, files, symbols, modules, ext, chunks).records
        ).groupBy("table_name", "orphan_kind").sum("n_records").withColumnRenamed("sum(n_records)", "n_records").collect()
    }
    assert out["files", "direct"] == 3  # their module_root names no module
    assert out["relationships", "inherited"] == 1  # its own references resolve, its file is an orphan
    assert out["symbols", "direct"] == 2 and out["chunks", "inherited"] == 1


def test_cascade_follows_deep_chains(spark):
    rels, files, _, modules, ext = tables(spark, [])
    f = spark.createDataFrame([("r", "deep.py", None, at(5), None)], FILES)
    symbols = spark.createDataFrame([(k, "r", f"s{k}", f"s{k - 1}" if k else None, "deep.py", at(6 if k else 1), None) for k in range(23)], SYMBOLS)
    chunks = spark.createDataFrame([], "id string, repo string, file_path string, symbol_name string, indexed_at timestamp")
    out = {r["depth"]: r["n_records"] for r in orphan_counts(cascade(rels, f, symbols, modules, ext, chunks).records).collect()}
    assert out == dict.fromkeys(range(23), 1)
