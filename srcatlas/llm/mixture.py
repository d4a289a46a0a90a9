"""Mixing sources to target weights.

Two plans of shares. By targets: weights on the geometric path from the natural token shares q to the target weights p,
w(a) ~ q^(1-a) p^a; the shares asked for hold exactly at a = 1, and a total beyond what the repetition limits allow there
bisects a down to the largest exponent within them. By temperature: w(a) ~ q^a, with a bisected to the entropy of the
targets and, where a total is asked for, on towards 1 until the repetition limits hold. Either plan is realised as budgets
of tokens: whole passes over a hash permutation of a source, and a part of one more, taken block by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.tokens import TOKENIZER_FOLDER, count_tokens
from srcatlas.session import materialize

#: Bits of a draw key that number the blocks of a source's permutation, and of those within one block: whole blocks are taken
#: by their sums, only the one where a budget ends is looked into.
BLOCK_SHIFTS, BLOCKS = (52, 40), 4096


def entropy(shares: list[float]) -> float:
    return -sum(x * math.log(x) for x in shares if x > 0)


def tempered_shares(shares: list[float], target_entropy: float, steps: int = 80) -> tuple[float, list[float]]:
    """Exponent a >= 0 and shares ~ q^a whose entropy is the target (clipped to what a in [0, 64] can reach)."""

    def at(a: float) -> list[float]:
        top = max(shares)
        x = [(s / top) ** a if s > 0 else 0.0 for s in shares]
        return [v / sum(x) for v in x]

    lo, hi = 0.0, 64.0  # entropy falls as the exponent grows
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(at(mid)) > target_entropy else (lo, mid)
    return (lo + hi) / 2, at((lo + hi) / 2)


@dataclass
class Share:
    source: str
    target: float
    tokens: int
    max_repeats: int
    weight: float = 0.0
    budget: int = 0


def plan_budgets(rows: list[Share], total: int | None = None, steps: int = 80) -> tuple[float, list[Share]]:
    """Exponent of the path and the token budget of each source.

    Sources without tokens, without weight or that may not be taken get no budget; the others' weights are normalised.
    """
    live = [r for r in rows if r.tokens > 0 and r.target > 0 and r.max_repeats > 0]
    if not live:
        return 1.0, rows
    n, p = sum(r.tokens for r in live), sum(r.target for r in live)

    def weights(a: float) -> list[float]:
        x = [(r.tokens / n) ** (1 - a) * (r.target / p) ** a for r in live]
        return [v / sum(x) for v in x]

    def reach(w: list[float]) -> float:
        """Largest total within every repetition limit."""
        return min(r.tokens * r.max_repeats / v for r, v in zip(live, w))

    a = 1.0
    if total is not None and reach(weights(1.0)) < total:
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if reach(weights(mid)) >= total else (lo, mid)
        a = lo
    w = weights(a)
    size = min(reach(w), total if total is not None else math.inf)
    for r, v in zip(live, w):
        r.weight, r.budget = v, min(round(v * size), r.tokens * r.max_repeats)
    return a, rows


def tempered_budgets(rows: list[Share], total: int | None = None, steps: int = 80) -> tuple[float, list[Share]]:
    """Exponent and budgets by temperature: q^a with the entropy of the targets, nearer to q where the limits ask for it."""
    live = [r for r in rows if r.tokens > 0 and r.target > 0 and r.max_repeats > 0]
    if not live:
        return 1.0, rows
    n, p = sum(r.tokens for r in live), sum(r.target for r in live)
    a, w = tempered_shares([r.tokens / n for r in live], entropy([r.target / p for r in live]), steps)

    def weights(e: float) -> list[float]:
        x = [(r.tokens / n) ** e for r in live]
        return [v / sum(x) for v in x]

    def reach(v: list[float]) -> float:
        return min(r.tokens * r.max_repeats / x for r, x in zip(live, v))

    if total is not None and reach(w) < total and a < 1:
        lo, hi = a, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if reach(weights(mid)) >= total else (mid, hi)
        a, w = hi, weights(hi)
    size = min(reach(w), total if total is not None else math.inf)
    for r, v in zip(live, w):
        r.weight, r.budget = v, min(round(v * size), r.tokens * r.max_repeats)
    return a, rows


def _cut(rows: DataFrame, shift: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the blocks inside a budget, of the block where it ends (with what is left of it), and of those behind."""
    r = rows.withColumn("block", F.shiftrightunsigned("draw_key", shift).bitwiseAND(F.lit(BLOCKS - 1)))
    before = Window.partitionBy("mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy("mix_source", "block").agg(F.sum("n_tokens").alias("s")).withColumn("upto", F.coalesce(F.sum("s").over(before), F.lit(0)))
    placed = r.join(F.broadcast(sums), ["mix_source", "block"])  # at most BLOCKS rows per row of targets
    cols = rows.columns
    edge = placed.where("upto < rest and upto + s > rest").withColumn("rest", F.col("rest") - F.col("upto"))
    return placed.where("upto + s <= rest").select(*cols), edge.select(*cols), placed.where("upto >= rest").select(*cols)


def draw_mixture(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 42,
    folder: str = TOKENIZER_FOLDER,
    by_temperature: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) of a mixture whose sources have the token shares that `targets` asks for, or, `by_temperature`, natural
    shares tempered to the entropy of the targets.

    draws(mix_source, doc_id, n_tokens, pass_no, draw_key): one row per draw. Pass k of a source is a permutation of its
    documents by draw_key; the budget takes whole passes, then the longest prefix of one more that fits the rest, then the
    one document outside the prefix that brings the sum nearest to it. No document is drawn more than max_repeats times.
    shares(mix_source, target_weight, max_repeats, n_docs, source_tokens, natural_share, exponent, budget_tokens, drawn_tokens,
    actual_share, most_copies): one row per row of targets; a source without documents has zeros.

    Documents with null source, or without tokens (null and empty text), are never drawn; doc_id is taken as a key, of
    repeated rows one counts. Null weights count as 0, null max_repeats as 1. Empty tables give no draws.
    Per-source sums are pre-aggregated per block of the permutation, so a source that holds most rows is never sorted in one
    task: whole blocks go by their sums, then blocks of the block where the budget ends, and only the last is ordered by row.
    """
    t = targets.groupBy("mix_source").agg(
        F.sum("target_weight").alias("target_weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    ).where("mix_source is not null")
    asked = t.orderBy("mix_source").collect()  # a configuration table of a row per source
    wanted = documents.where(F.col("source").isin([r["mix_source"] for r in asked]))
    counted = materialize(
        count_tokens(wanted, folder).where("n_tokens > 0").groupBy("doc_id").agg(
            F.min("source").alias("mix_source"), F.max("n_tokens").alias("n_tokens")
        ),
        "token-counts",
    )
    stats = {r["mix_source"]: r for r in counted.groupBy("mix_source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")).collect()}
    rows = [
        Share(
            r["mix_source"], r["target_weight"] or 0.0, stats[r["mix_source"]]["tokens"] if r["mix_source"] in stats else 0, r["max_repeats"]
        ) for r in asked
    ]
    exponent, rows = (tempered_budgets if by_temperature else plan_budgets)(rows, total_tokens)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(r.source, r.budget // r.tokens if r.tokens else 0, r.budget % r.tokens if r.tokens else 0, r.budget) for r in rows],
        "mix_source string, whole int, rest bigint, budget bigint",
    )
    small = F.broadcast(plan)  # as many rows as targets

    key = F.xxhash64("doc_id", "pass_no", F.lit(seed)).alias("draw_key")
    docs = counted.join(small, "mix_source")
    whole = docs.where("whole > 0").select(
        "mix_source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("pass_no")
    ).select("*", key)
    last = docs.where("rest > 0").select("mix_source", "doc_id", "n_tokens", "rest", F.col("whole").alias("pass_no")).select("*", key)
    inside, edge, behind = _cut(last, BLOCK_SHIFTS[0])
    inner, edge, after = _cut(edge, BLOCK_SHIFTS[1])
    inside, behind = inside.unionByName(inner), behind.unionByName(after)
    run = Window.partitionBy("mix_source").orderBy("draw_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("run", F.sum("n_tokens").over(run))
    cols = ["mix_source", "doc_id", "n_tokens", "pass_no", "draw_key"]
    prefix = inside.select(*cols).unionByName(edge.where("run <= rest").select(*cols))
    drawn = small.select("mix_source", "rest").join(
        prefix.groupBy("mix_source").agg(F.sum("n_tokens").alias("s")), "mix_source", "left"
    ).select("mix_source", (F.col("rest") - F.coalesce("s", F.lit(0))).alias("gap"))
    outside = behind.select(*cols).unionByName(edge.where("run > rest").select(*cols))
    miss = F.abs(F.col("n_tokens") - F.col("gap"))
    filler = outside.join(F.broadcast(drawn), "mix_source").where(miss < F.col("gap")).groupBy("mix_source").agg(
        F.min_by(F.struct(*cols[1:]), F.struct(miss, "draw_key")).alias("x")
    ).select("mix_source", "x.*")
    draws = whole.select(*cols).unionByName(prefix).unionByName(filler.select(*cols))

    got = draws.groupBy("mix_source", "pass_no").agg(F.sum("n_tokens").alias("drawn")).groupBy("mix_source").agg(
        F.sum("drawn").alias("drawn_tokens"), F.count("*").alias("most_copies")
    )
    base = spark.createDataFrame(
        [
            (
                r.source,
                r.target,
                r.max_repeats,
                stats[r.source]["n_docs"] if r.source in stats else 0,
                r.tokens,
                r.tokens / max(1, sum(x.tokens for x in rows)),
                exponent,
                r.budget,
            ) for r in rows
        ],
        "mix_source string, target_weight double, max_repeats int, n_docs bigint, source_tokens bigint, natural_share double, exponent double, budget_tokens bigint",
    )
    filled = base.join(F.broadcast(got), "mix_source", "left").fillna(0, ["drawn_tokens", "most_copies"])
    everything = Window.partitionBy(F.lit(1))  # over the rows of targets
    shares = filled.withColumn(
        "actual_share", F.coalesce(F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(everything), F.lit(0)), F.lit(0.0))
    )
    return draws, shares
