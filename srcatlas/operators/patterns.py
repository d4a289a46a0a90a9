"""Recurring structural patterns: files whose classes have similar method sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.session import materialize

MIN_CLUSTER, MIN_SIMILARITY = 5, 0.8


def file_signatures(symbols: DataFrame) -> DataFrame:
    """(repo, file_path, has_class, class_name, methods, has_init) per file.

    class_name is the last class by line; methods are sorted and keep duplicates; has_init: a Python or script constructor.
    """
    s = symbols.where("repo is not null and file_path is not null")
    is_class, is_method = F.col("kind") == "class", F.col("kind") == "method"
    g = s.groupBy("repo", "file_path").agg(
        F.max(is_class).alias("has_class"),
        F.max_by(F.when(is_class, F.col("symbol_name")), F.when(is_class, F.struct("start_line", "symbol_id"))).alias("class_name"),
        F.array_sort(F.collect_list(F.when(is_method, F.col("symbol_name")))).alias("methods"),
        F.max(is_method & F.col("symbol_name").isin("__init__", "constructor")).alias("has_init"),
    )
    return g.select(
        "repo",
        "file_path",
        "has_class",
        F.coalesce("class_name", F.lit("")).alias("class_name"),
        "methods",
        F.coalesce("has_init", F.lit(False)).alias("has_init"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct methods; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(repo, early, late): pairs of the sets(repo, set_id, first_path, methods) of a repo that are similar enough, in order of their first paths.

    Sets meet only on one of their rarest methods: with a similarity of s, two sets of n methods must share one of the
    n - ceil(s n) + 1 rarest, so a method that every class has brings no pairs. Lengths and the exact share follow in the join.
    """
    often = sets.select("repo", F.explode("methods").alias("method")).groupBy("repo", "method").agg(F.count("*").alias("often"))
    counted = sets.select("repo", "set_id", F.size("methods").alias("n"), F.explode("methods").alias("method")).join(often, ["repo", "method"])
    rank = F.row_number().over(Window.partitionBy("repo", "set_id").orderBy("often", "method"))
    rare = counted.withColumn("rank", rank).where(
        F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    ).select("repo", "set_id", "method")
    keyed = rare.join(sets, ["repo", "set_id"]).select("repo", "method", "first_path", "methods")
    a, b = keyed.withColumnsRenamed({"first_path": "early", "methods": "m"}), keyed.withColumnsRenamed({"first_path": "late", "methods": "o"})
    met = a.join(b, ["repo", "method"]).where(
        (F.col("early") < F.col("late")) & (F.least(F.size("m"), F.size("o")) >= similarity * F.greatest(F.size("m"), F.size("o")) - 1e-9)
    )
    return met.where(jaccard(F.col("m"), F.col("o")) >= similarity - 1e-9).select("repo", "early", "late").distinct()


def cluster_files(signatures: DataFrame, similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(repo, file_path, cluster): files led by the first file, in order of paths, whose methods are similar enough.

    Files with the same method set always fall together, so a repo's *distinct* sets are clustered and files join back by
    the set's hash. Similarity is to the leader, not transitive: a set leads once every earlier set similar to it is led by
    another, and others follow the first leader they are similar to. Leaders are settled in rounds of joins over the similar
    pairs, written to the shared folder. Files without a class or without methods stay alone.
    """
    sets = signatures.withColumn("distinct_methods", F.array_sort(F.array_distinct("methods"))).withColumn(
        "set_id", F.sha2(F.array_join("distinct_methods", "\x1f"), 256)
    )
    able = sets.where("has_class and size(distinct_methods) > 0")
    reduced = materialize(
        able.groupBy("repo", "set_id").agg(F.min("file_path").alias("first_path"), F.min("distinct_methods").alias("methods")), "sets"
    )
    pairs = materialize(similar_sets(reduced, similarity), "similar-sets")
    left, led = pairs, None
    while not left.isEmpty():  # each round settles the first set of every pair at least
        leads = left.select("repo", F.col("early").alias("path")).distinct().join(
            left.select("repo", F.col("late").alias("path")).distinct(), ["repo", "path"], "left_anti"
        )
        taken = materialize(
            left.join(
                leads.select("repo", F.col("path").alias("early")), ["repo", "early"], "left_semi"
            ).select("repo", F.col("late").alias("path")).distinct(),
            "led",
        )
        led = taken if led is None else led.unionByName(taken)
        left = left.join(taken.select("repo", F.col("path").alias("late")), ["repo", "late"], "left_anti").join(
            taken.select("repo", F.col("path").alias("early")), ["repo", "early"], "left_anti"
        )
        left = materialize(left, "undecided")
    if led is not None:
        follows = pairs.join(led.select("repo", F.col("path").alias("late")), ["repo", "late"], "left_semi").join(
            led.select("repo", F.col("path").alias("early")), ["repo", "early"], "left_anti"
        ).groupBy("repo", F.col("late").alias("first_path")).agg(F.min("early").alias("leader"))
        reduced = reduced.join(follows, ["repo", "first_path"], "left")
    else:
        reduced = reduced.withColumn("leader", F.lit(None).cast("string"))
    clusters = reduced.select("repo", "set_id", F.coalesce("leader", "first_path").alias("cluster"))
    alone = sets.where("not (has_class and size(distinct_methods) > 0)").select("repo", "file_path", F.col("file_path").alias("cluster"))
    return able.select("repo", "set_id", "file_path").join(clusters, ["repo", "set_id"]).select("repo", "file_path", "cluster").unionByName(alone)


def common_suffix(low: Column, high: Column) -> Column:
    """Longest common ending, from the first and the last of the reversed names, if it has 4 bytes or more, else 'Pattern'; 'Unknown' without names."""
    shorter = F.least(F.length(low), F.length(high))
    lengths = F.filter(F.sequence(F.lit(0), shorter), lambda i: F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i))
    suffix = F.reverse(F.substr(low, F.lit(1), F.array_max(lengths)))
    return F.when(low.isNull(), "Unknown").when(F.octet_length(suffix) >= 4, suffix).otherwise("Pattern")


@dataclass
class Patterns:
    """found(repo, cluster, name, description, methods, canonical_file, member_count); members(repo, cluster, name, file_path), a row per file."""

    found: DataFrame
    members: DataFrame


def detect_patterns(symbols: DataFrame, min_cluster: int = MIN_CLUSTER, similarity: float = MIN_SIMILARITY) -> Patterns:
    """Clusters large enough, and the files in them.

    methods: those in at least n * 8 / 10 files, whole division, duplicates within a file counting. The name is the common
    ending of the members' class names. No list of members is gathered.
    """
    sig = file_signatures(symbols)
    member = materialize(
        cluster_files(sig, similarity).join(sig.select("repo", "file_path", "class_name", "methods"), ["repo", "file_path"]), "pattern-members"
    )
    backward = F.when(F.col("class_name") != "", F.reverse("class_name"))
    size = member.groupBy("repo", "cluster").agg(
        F.count("*").alias("member_count"), F.min("file_path").alias("canonical_file"), F.min(backward).alias("low"), F.max(backward).alias("high")
    ).where(F.col("member_count") >= min_cluster)
    size = size.select("repo", "cluster", "member_count", "canonical_file", common_suffix(F.col("low"), F.col("high")).alias("name"))
    counts = member.select("repo", "cluster", F.explode("methods").alias("method")).groupBy("repo", "cluster", "method").agg(F.count("*").alias("n"))
    common = counts.join(
        size.select("repo", "cluster", "member_count"), ["repo", "cluster"]
    ).where("n >= (member_count * 8) div 10").groupBy("repo", "cluster").agg(F.array_sort(F.collect_list("method")).alias("methods"))
    found = size.join(common, ["repo", "cluster"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    description = F.format_string("Classes following the %s pattern implement: %s", "name", F.array_join("methods", ", "))
    members = member.select("repo", "cluster", "file_path").join(size.select("repo", "cluster", "name"), ["repo", "cluster"])
    return Patterns(found.select("repo", "cluster", "name", description.alias("description"), "methods", "canonical_file", "member_count"), members)


def pattern_chunks(patterns: Patterns) -> DataFrame:
    """One searchable chunk per pattern: kind `pattern`, at its canonical file, weight 1.5. Its text names every member, as the form asks."""
    from srcatlas.functions.scalar import GUIDE_WEIGHT, chunk_id

    named = patterns.members.groupBy("repo", "cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("file_path")), lambda m: F.concat(F.lit("- "), m, F.lit("\n"))), "").alias("_list")
    )
    content = F.concat(
        F.format_string("# %s Pattern\n\n%s\n\n## Example Files\n", "name", "description"),
        F.col("_list"),
        F.format_string("\n## Canonical Example\n%s\n", "canonical_file"),
    )
    return patterns.found.join(named, ["repo", "cluster"]).select(
        chunk_id(F.col("repo"), F.lit("patterns"), F.col("name"), F.lit(0)).alias("id"), "repo", F.col("canonical_file").alias("file_path"), F.lit("doc").alias("chunk_type"), F.lit("pattern").alias("kind"),
        F.col("name").alias("symbol_name"), content.alias("content"), F.lit(GUIDE_WEIGHT).cast("float").alias("retrieval_weight"), F.lit(False).alias("is_test"),
    )


def mark_pattern_members(chunks: DataFrame, patterns: Patterns) -> DataFrame:
    """Chunks with `follows_pattern` set for members of a pattern; the first name counts where there are several."""
    member = patterns.members.groupBy("repo", "file_path").agg(F.min("name").alias("follows_pattern"))
    return chunks.drop("follows_pattern").join(member, ["repo", "file_path"], "left")
