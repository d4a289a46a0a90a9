"""The k most similar vectors of every vector: an inverted-file index scanned with adaptive dimensions.

A bounded sample gives the list centroids and nothing else; every usable vector is indexed. Vectors are normalised,
rotated by a random orthogonal matrix and read in blocks of columns. Within each probed list a hypothesis test on the
partial distance abandons a candidate as soon as its full distance is very unlikely to beat the query's k-th best.
Lists that lie together form a group, a group is one task, and a vector travels once to each group it probes.

Lists come in two levels. The number of lists of the first is bounded, since they are broadcast; a list that is to hold more
rows than a task should is divided by an index of its own, fitted on a bounded sample of its rows. Where even a list of the
second level is crowded, its rows are cut into slices and its queries into blocks, and a pair of both is one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.common import spread
from srcatlas.session import materialize

DIMENSION = 128
#: Rows that the centroids of a level are fitted on, about, at most: those of a share of the hashes of ids.
SAMPLE_ROWS = 40_000
#: Lists of one level, at most: their centroids are broadcast.
LEVEL_LISTS = 2048
ROWS_PER_LIST = 256
ROWS_PER_GROUP = 8_000
#: A list expected to hold more rows than this gets an index of its own; one within such an index is cut into slices.
ROWS_PER_SLICE = 16_000
PROBES = 4
#: Confidence of the test: a candidate is abandoned when its scaled partial distance exceeds the bound by (1 + e / sqrt(d)).
TEST_EPSILON = 2.1
BLOCKS = (32, 64, 128)


def usable(vector: Column, dimension: int = DIMENSION) -> Column:
    """Finite, of the right dimension and not all zero."""
    top, low = F.array_max(vector), F.array_min(vector)
    finite = ~F.isnan(top) & (top < F.lit(float("inf"))) & (low > F.lit(float("-inf")))
    full = ~F.exists(vector, lambda x: x.isNull())
    return F.coalesce((F.size(vector) == dimension) & full & finite & ((top != 0) | (low != 0)), F.lit(False))


@dataclass
class Index:
    rotation: np.ndarray  # dimension x dimension, orthogonal
    centroids: np.ndarray  # lists x dimension, rotated, unit length
    expected: np.ndarray  # rows per list
    slices: np.ndarray  # slices per list, 0 where the list has an index of its own
    first: np.ndarray  # number of a list's first cell; a list of s slices has s * s cells
    group: np.ndarray  # group per cell
    n_groups: int


def rotation_matrix(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, lists: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; also the sample rows per centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(a, kind="stable")
        starts = np.searchsorted(a[order], np.arange(len(c)))
        n = np.bincount(a, minlength=len(c))
        full = n > 0
        s = np.zeros_like(c)
        s[full] = np.add.reduceat(x[order], starts[full], axis=0)
        s[~full] = x[rng.choice(len(x), int((~full).sum()))]
        c = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    return c, n


def group_lists(c: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """Groups of neighbouring lists of about equal weight: halve along the widest direction until there are enough."""
    out = np.zeros(len(c), np.int32)
    todo = [(np.arange(len(c)), groups, 0)]
    while todo:
        rows, parts, base = todo.pop()
        if parts <= 1 or len(rows) < 2:
            out[rows] = base
            continue
        left = parts // 2
        mid = c[rows] - c[rows].mean(0)
        axis = np.linalg.svd(mid, full_matrices=False)[2][0]
        order = rows[np.argsort(mid @ axis, kind="stable")]
        w = np.cumsum(weight[order])
        cut = int(np.clip(np.searchsorted(w, w[-1] * left / parts) + 1, 1, len(order) - 1))
        todo += [(order[:cut], left, base), (order[cut:], parts - left, base + left)]
    return out


def fit_index(sample: np.ndarray, n: int, tasks: int, seed: int, deeper: bool = False, rows_per_slice: int | None = None) -> Index:
    """An index for n rows from a sample of them; with `deeper`, crowded lists are left to indexes of their own."""
    rot = rotation_matrix(sample.shape[1], seed)
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32) @ rot
    lists = int(np.clip(n // ROWS_PER_LIST, 1, min(LEVEL_LISTS, max(1, len(x) // 8))))
    c, count = fit_centroids(x, lists, seed)
    expected = count / max(1, count.sum()) * n
    slices = np.maximum(1, np.ceil(expected / (rows_per_slice or ROWS_PER_SLICE))).astype(np.int32)
    if deeper:
        slices[slices > 1] = 0
    cells = slices * slices
    first = np.concatenate([[0], np.cumsum(cells)[:-1]]).astype(np.int32)
    alone = np.flatnonzero(slices == 1)
    n_groups = int(min(max(1, len(alone)), max(tasks, -(-n // ROWS_PER_GROUP))))
    group = np.zeros(int(cells.sum()), np.int32)
    if len(alone):
        group[first[alone]] = group_lists(c[alone], expected[alone] + 1e-9, n_groups)
    crowded = np.concatenate(
        [np.arange(first[i], first[i] + cells[i]) for i in np.flatnonzero(slices > 1)] or [np.zeros(0, np.int64)]
    ).astype(np.int64)
    group[crowded] = n_groups + np.arange(len(crowded))  # each pair of a slice and a block of queries is a group
    return Index(rot, c.astype(np.float32), expected, slices, first, group, n_groups + len(crowded))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<float> or of equally long binary values."""
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten()).reshape(len(column), -1)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, DIMENSION), np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that neither very long nor very short vectors overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


HASHED = "id string, h struct<a:bigint,b:bigint>, v bigint"


def _hash_rows(bits: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of whole numbers: a sum of mixed products with random odd factors."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, bits.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    x = (bits.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * factors
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))).sum(1)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, two hashes of the direction, a hash of the vector)."""
    for b in batches:
        if b.num_rows:
            v = _matrix(b.column(1)).astype(np.float32)
            wide = v.astype(np.float64)
            direction = np.rint(wide / np.abs(wide).max(1, keepdims=True) * 1e6).astype(np.int64).view(np.uint64)
            h = pa.StructArray.from_arrays([pa.array(_hash_rows(direction, k)) for k in (1, 2)], ["a", "b"])
            yield pa.RecordBatch.from_arrays([b.column(0), h, pa.array(_hash_rows(v.view(np.uint32), 3))], ["id", "h", "v"])


ROUTED = "coarse int, grp bigint, home int, cells binary, alone boolean, id string, vec binary"


def _targets(ix: Index, unit: np.ndarray, salt: np.ndarray, lives: np.ndarray, whole: np.ndarray, probes: int, base: np.ndarray) -> tuple[list, ...]:
    """Where vectors go in an index: (row, coarse list or -1, group, cell it lives in or -1, cells it asks, whether it goes nowhere else).

    `lives`: whether a vector lives in this index or only asks it; `whole`: whether it goes to no other index; `base`: added
    to the numbers of groups.
    """
    v = unit @ ix.rotation
    sims = v @ ix.centroids.T
    k = min(probes, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    row, coarse, group, home, asked, alone = [], [], [], [], [], []
    for i in range(len(v)):
        by: dict[int, tuple[int, list[int]]] = {}
        deeper = []
        for r, li in enumerate(near[i].tolist()):
            s, at = int(ix.slices[li]), int(ix.first[li])
            here = r == 0 and bool(lives[i])
            if s == 0:
                deeper.append((li, here))
            elif s == 1:
                g = int(ix.group[at])
                live, cells = by.get(g, (-1, []))
                by[g] = (at if here else live, [*cells, at])
            else:
                mine, block = int(salt[i] % s), int(salt[i] // s % s)
                for b in range(s) if here else ():
                    by[int(ix.group[at + mine * s + b])] = (at + mine * s + b, [])
                for j in range(s):
                    cell = at + j * s + block
                    g = int(ix.group[cell])
                    by[g] = (by.get(g, (-1, []))[0], [cell])
        once = bool(whole[i]) and len(by) + len(deeper) == 1
        for g, (live, cells) in by.items():
            row.append(i), coarse.append(-1), group.append(g + int(base[i])), home.append(live), asked.append(
                np.asarray(cells, np.int32).tobytes()
            ), alone.append(once)
        for li, here in deeper:
            row.append(i), coarse.append(li), group.append(-1), home.append(0 if here else -1), asked.append(b""), alone.append(once)
    return row, coarse, group, home, asked, alone


def _route(index_bc, probes: int):
    """(id, vector, salt) -> one row per group, and per list with an index of its own, that the vector lives in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_matrix(b.column(1)))
            n = len(unit)
            row, coarse, group, home, asked, alone = _targets(
                index_bc.value, unit, np.asarray(b.column(2)).astype(np.int64), np.ones(n, bool), np.ones(n, bool), probes, np.zeros(n, np.int64)
            )
            size = unit.shape[1] * 4
            for lo in range(0, len(row), 1 << 20):  # offsets of a batch are of 32 bits
                part = slice(lo, lo + (1 << 20))
                flat = pa.Array.from_buffers(
                    pa.binary(),
                    len(row[part]),
                    [
                        None,
                        pa.py_buffer(np.arange(0, (len(row[part]) + 1) * size, size, dtype=np.int32)),
                        pa.py_buffer(np.ascontiguousarray(unit[row[part]])),
                    ],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(coarse[part], pa.int32()),
                        pa.array(group[part], pa.int64()),
                        pa.array(home[part], pa.int32()),
                        pa.array(asked[part], pa.binary()),
                        pa.array(alone[part]),
                        b.column(0).take(pa.array(row[part])),
                        flat,
                    ],
                    ["coarse", "grp", "home", "cells", "alone", "id", "vec"],
                )

    return run


def _fit_deeper(expected: dict[int, float], seed: int):
    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        sample = np.stack([np.frombuffer(v, np.float32) for v in rows.sort_values("id")["vec"]])
        index = fit_index(sample, int(expected[key[0]]), 1, seed + 1)
        return pd.DataFrame({"coarse": [key[0]], "index": [pickle.dumps(index)]})

    return fit


def _route_deeper(probes: int):
    def route(key, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        columns = ["coarse", "grp", "home", "cells", "alone", "id", "vec"]
        if not len(rows) or not len(fitted):
            return pd.DataFrame({c: [] for c in columns})
        unit = np.stack([np.frombuffer(v, np.float32) for v in rows["vec"]])
        base = np.full(len(rows), (int(key[0]) + 1) << 32, np.int64)
        row, coarse, group, home, asked, alone = _targets(
            pickle.loads(fitted["index"].iloc[0]),
            unit,
            rows["salt"].to_numpy(),
            (rows["home"] >= 0).to_numpy(),
            rows["alone"].to_numpy(),
            probes,
            base,
        )
        taken = rows.iloc[row]
        return pd.DataFrame(
            {
                "coarse": coarse,
                "grp": group,
                "home": home,
                "cells": asked,
                "alone": alone,
                "id": taken["id"].to_numpy(),
                "vec": taken["vec"].to_numpy(),
            },
            columns=columns,
        )

    return route


def _divide(routed: DataFrame, index: Index, probes: int, seed: int) -> DataFrame:
    """Rows of crowded lists, routed on by the indexes of these lists; each task holds one part of one list."""
    big = np.flatnonzero(index.slices == 0)
    expected = {int(i): float(index.expected[i]) for i in big}
    sizes = routed.sparkSession.createDataFrame(
        [(i, max(1, round(n / SAMPLE_ROWS)), max(1, round(n * (1 + probes) / ROWS_PER_SLICE))) for i, n in expected.items()],
        "coarse int, every int, parts int",
    )
    rows = routed.where("coarse >= 0").join(F.broadcast(sizes), "coarse")  # at most a row per list
    sample = rows.where("home >= 0").where(F.pmod(F.xxhash64("id"), F.col("every")) == 0).select("coarse", "id", "vec")
    fitted = sample.groupBy("coarse").applyInPandas(_fit_deeper(expected, seed), "coarse int, index binary")
    parted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))).withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("parts")).cast("int")
    )
    copies = fitted.join(F.broadcast(sizes), "coarse").select("coarse", "index", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return parted.select(
        "coarse", "part", "home", "alone", "id", "vec", "salt"
    ).groupBy("coarse", "part").cogroup(copies.groupBy("coarse", "part")).applyInPandas(_route_deeper(probes), ROUTED)


def _keep_best(best_d: np.ndarray, best_i: np.ndarray, q: np.ndarray, c: np.ndarray, d: np.ndarray, rank: np.ndarray) -> None:
    """Merge candidate triples into the k best per query; ties go to the lower rank of the id."""
    k = best_d.shape[1]
    touched, inv = np.unique(q, return_inverse=True)
    qq = np.concatenate([inv, np.repeat(np.arange(len(touched)), k)])
    cc = np.concatenate([c, best_i[touched].ravel()])
    dd = np.concatenate([d, best_d[touched].ravel()])
    order = np.lexsort((np.where(cc >= 0, rank[cc], np.iinfo(np.int64).max), dd, qq))
    qq, cc, dd = qq[order], cc[order], dd[order]
    at = np.arange(len(qq)) - np.searchsorted(qq, np.arange(len(touched)))[qq]
    keep = at < k
    best_d[touched[qq[keep]], at[keep]] = dd[keep]
    best_i[touched[qq[keep]], at[keep]] = cc[keep]


def scan_cells(
    x: np.ndarray, home: np.ndarray, cells: list[np.ndarray], rank: np.ndarray, k: int, epsilon: float = TEST_EPSILON
) -> tuple[np.ndarray, np.ndarray]:
    """k nearest rows of every row among the rows living in the cells it asks for, by squared distance of unit vectors."""
    n, dim = x.shape
    best_d, best_i = np.full((n, k), np.inf, np.float32), np.full((n, k), -1, np.int64)
    by_cell = np.argsort(home, kind="stable")
    by_cell = by_cell[home[by_cell] >= 0]
    names, starts = np.unique(home[by_cell], return_index=True)
    members = dict(zip(names.tolist(), np.split(by_cell, starts[1:])))
    blocks = [b for b in BLOCKS if b < dim] + [dim]
    norm = {b: np.einsum("ij,ij->i", x[:, :b], x[:, :b]) for b in blocks}
    asks: dict[tuple[int, int], list[int]] = {}
    for i, cs in enumerate(cells):
        for r, cell in enumerate(cs.tolist()):
            asks.setdefault((r, cell), []).append(i)
    for r, cell in sorted(asks):
        base = members.get(cell)
        if base is None:
            continue
        rows = np.asarray(asks[r, cell])
        for lo in range(0, len(rows), 1024):
            for bo in range(0, len(base), 8192):
                q, c = rows[lo : lo + 1024], base[bo : bo + 8192]
                limit = best_d[q, -1]
                if np.isinf(limit).all():
                    part = norm[dim][q][:, None] + norm[dim][c][None, :] - 2 * (x[q] @ x[c].T)
                    part[q[:, None] == c[None, :]] = np.inf
                    kk = min(k, len(c))
                    pick = np.argpartition(part, kk - 1, axis=1)[:, :kk]
                    edge = np.take_along_axis(part, pick, 1).max(1)
                    qi, ci = np.nonzero(part <= edge[:, None])
                    ok = np.isfinite(part[qi, ci])
                    qi, ci = qi[ok], ci[ok]
                    dist = part[qi, ci]
                else:
                    d0 = blocks[0]
                    part = norm[d0][q][:, None] + norm[d0][c][None, :] - 2 * (x[q, :d0] @ x[c, :d0].T)
                    qi, ci = np.nonzero(part <= (limit * (d0 / dim) * (1 + epsilon / np.sqrt(d0)) ** 2)[:, None])
                    ok = q[qi] != c[ci]
                    qi, ci = qi[ok], ci[ok]
                    dist = part[qi, ci]
                    for a, z in zip(blocks, blocks[1:]):
                        diff = x[q[qi], a:z] - x[c[ci], a:z]
                        dist = dist + np.einsum("ij,ij->i", diff, diff)
                        bound = limit[qi] * ((z / dim) * (1 + epsilon / np.sqrt(z)) ** 2 if z < dim else 1.0)
                        ok = dist <= bound
                        qi, ci, dist = qi[ok], ci[ok], dist[ok]
                if len(qi):
                    _keep_best(best_d, best_i, q[qi], c[ci], dist.astype(np.float32), rank)
    return best_d, best_i


def _scan_group(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).select(["grp", "home", "cells", "alone", "id"])
        x = np.concatenate([_matrix(b["vec"]) for b in got])
        del got
        ids = np.asarray(t["id"].to_pylist(), object)
        grp, home = np.asarray(t["grp"]), np.asarray(t["home"])
        names, alone = t["cells"].to_pylist(), np.asarray(t["alone"])
        for g in np.unique(grp):
            rows = np.flatnonzero(grp == g)
            _, once = np.unique(ids[rows].astype(str), return_index=True)  # repeated rows of one id
            rows = rows[np.sort(once)]
            rank = np.argsort(np.argsort(ids[rows].astype(str), kind="stable"), kind="stable")
            d, i = scan_cells(np.ascontiguousarray(x[rows]), home[rows], [np.frombuffer(names[r], np.int32) for r in rows], rank, k)
            for lo in range(0, len(rows), 4096):
                part = i[lo : lo + 4096]
                hit = part >= 0
                ends = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
                near = pa.ListArray.from_arrays(ends, pa.array(ids[rows][part[hit]], pa.string()))
                dist = pa.ListArray.from_arrays(ends, pa.array(d[lo : lo + 4096][hit], pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows][lo : lo + 4096], pa.string()), pa.array(alone[rows][lo : lo + 4096]), near, dist],
                    ["id", "alone", "near", "dist"],
                )

    return run


def nearest_vectors(
    chunks: DataFrame, k: int = 5, probes: int = PROBES, dimension: int = DIMENSION, seed: int = 11, id_col: str = "id", vector_col: str = "vector"
) -> DataFrame:
    """(id, near_id, cosine): the k most similar other rows of every usable row, approximately (recall is measured in tests).

    * unusable vectors (null, empty, of another dimension, with null, NaN or infinite components, all zero) take no part;
    * rows with the same id are one row: if their usable vectors differ, the smallest vector counts;
    * of rows with vectors of one direction (to six digits of the largest component; lengths are free), the ones with the
      lowest ids are the nearest to each other; groups of more than k + 1 such copies are reduced to those before the scan,
      so a group holding a third of all rows costs little;
    * fewer than k others give fewer rows; an empty table gives none; null ids take no part.
    """
    spark = chunks.sparkSession
    raw = chunks.select(
        F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")
    ).where(F.col("id").isNotNull() & usable(F.col("vector"), dimension))
    hashed = raw.mapInArrow(_hash_batches, HASHED)
    per_id = hashed.groupBy("id").agg(F.min("h").alias("h"), (F.min("v") != F.max("v")).cast("int").alias("bad"))
    per_h = per_id.groupBy("h").agg(F.count("*").alias("c"), F.sum("bad").alias("bad"))
    extra = F.greatest(F.col("c") - (k + 1), F.lit(0))
    n, bad, crowded = per_h.agg(F.sum("c"), F.sum("bad"), F.sum(extra)).head()
    if not n:
        return spark.createDataFrame([], "id string, near_id string, cosine double")
    if bad:
        raw = raw.groupBy("id").agg(F.min("vector").alias("vector"))
    copies = None
    if crowded:
        # light pass over (id, hash): the lowest k + 1 ids of each crowded direction stay, the others follow them
        light = raw.mapInArrow(_hash_batches, HASHED).select("id", "h").distinct()
        hot = light.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > k + 1).select("h")
        in_hot = materialize(light.join(hot, "h", "left_semi"), "copies")
        # the lowest ids of salted parts first, so no direction is sorted whole in one task
        part = F.pmod(F.xxhash64("id"), F.lit(64))
        first = in_hot.withColumn("r", F.row_number().over(Window.partitionBy("h", part).orderBy("id"))).where(F.col("r") <= k + 1)
        lowest = first.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
        followers = in_hot.join(lowest.select("id"), "id", "left_anti")
        near = lowest.where(F.col("r") <= k).groupBy("h").agg(F.collect_list("id").alias("near"))  # k ids a direction
        copies = followers.join(near, "h").select("id", F.explode("near").alias("near_id"), F.lit(1.0).alias("cosine"))
        raw = raw.join(followers.select("id"), "id", "left_anti")
        n = n - crowded

    every = -(-n // SAMPLE_ROWS)
    took = raw.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").toArrow()  # about SAMPLE_ROWS rows at most
    if not took.num_rows:
        took = raw.select("vector").limit(1).toArrow()
    sample = np.concatenate([_matrix(c) for c in took["vector"].chunks if len(c)]).astype(np.float32)
    index = fit_index(_unit(sample), n, spark.sparkContext.defaultParallelism, seed, deeper=True)
    index_bc = spark.sparkContext.broadcast(index)  # at most LEVEL_LISTS centroids
    salted = spread(raw, 1).select("id", "vector", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)).alias("salt"))
    routed = salted.mapInArrow(_route(index_bc, probes), ROUTED)
    if (index.slices == 0).any():
        routed = materialize(routed, "routed")
        routed = routed.where("coarse < 0").unionByName(_divide(routed, index, probes, seed))
        tasks = max(index.n_groups, -(-n // ROWS_PER_GROUP))
        grouped = routed.repartition(tasks, "grp")
    else:
        grouped = routed.repartitionById(index.n_groups, F.col("grp").cast("int"))
    found = grouped.select("grp", "home", "cells", "alone", "id", "vec").mapInArrow(
        _scan_group(k), "id string, alone boolean, near array<string>, dist array<float>"
    )
    pairs = F.arrays_zip(F.col("dist"), F.col("near"))
    # a vector whose probes lie in one group is done; the others merge a few short lists
    one = found.select("id", "alone", pairs.alias("p"))
    merged = one.where(~F.col("alone")).groupBy("id").agg(F.flatten(F.collect_list("p")).alias("p"))
    best = one.where("alone").select("id", F.explode("p").alias("x")).unionByName(
        merged.select("id", F.explode(F.slice(F.array_sort("p"), 1, k)).alias("x"))
    )
    out = best.select("id", F.col("x.near").alias("near_id"), (1 - F.col("x.dist").cast("double") / 2).alias("cosine"))
    return out.unionByName(copies) if copies is not None else out


def similar_pairs(chunks: DataFrame, k: int = 5, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: distinct pairs of which one is among the k nearest of the other."""
    n = nearest_vectors(chunks, k, **options)
    return n.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()
