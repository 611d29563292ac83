"""Near copies among vectors by a pivot-permutation index.

Each vector is described by its ``prefix`` nearest reference points (pivots), in order.
The pivots are rows of the table, the first by a hash that lie apart; their number grows
with the square root of the rows.  A vector stands on the inverted lists of its ``post``
nearest pivots.  Two vectors of a list are candidates if they share at least ``shared``
pivots of their prefixes, which is counted for all of a list at once as a product of
its incidence matrix; only candidates are verified, by their cosine in double precision.
A link counts in the first list that both ends stand on.  Lists are cut into pairs of
blocks, so a list that a third of all vectors are on is spread over many tasks; a task
returns counts and a spanning forest, never the pairs.

Exact copies are one class from the start.  Vectors that are null, zero, or hold null or
non-finite components link with nothing, as do vectors of different lengths; rows with a
null vec_id are returned alone.  Every row is a vector of its own, also where rows share
a vec_id.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.base import block_pairs, forest, materialise, numbered, two_sides, whole_groups
from rolesieve.llm.components import connected_components


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, v (array<double>) and ``more`` of the rows whose vector has a direction."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), *more).where("vec_id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.coalesce(sound, F.lit(False)))


def unit(v) -> np.ndarray:
    """Rows of unit length; scaled first, so that squares neither overflow nor vanish."""
    m = np.stack([np.asarray(x, np.float64) for x in v])
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def choose_pivots(reps: DataFrame, density: float, apart: float) -> dict[int, np.ndarray]:
    """Pivots by length of vector: ``density`` times the square root of that length's rows, no two nearer than ``apart``."""
    out: dict[int, np.ndarray] = {}
    for dims, n in reps.groupBy(F.size("v")).count().collect():  # a row a length of vector
        wanted = max(8, int(density * n**0.5))
        some = reps.where(F.size("v") == dims).orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(2 * wanted).select("v").toPandas()["v"]
        m = unit(some)
        chosen = np.zeros((0, dims))
        for lo in range(0, len(m), 256):
            part = m[lo : lo + 256]
            part = part[(part @ chosen.T).max(1, initial=-1) < apart]
            keep = np.ones(len(part), bool)
            near = part @ part.T >= apart
            for i in range(len(part)):
                if keep[i]:
                    keep[i + 1 :] &= ~near[i, i + 1 :]
            chosen = np.concatenate([chosen, part[keep]])
        out[dims] = chosen[:wanted]
    return out


def permutations(reps: DataFrame, points: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """rep, copies, v, near array<int>: the numbers of the nearest pivots, nearest first."""
    sent = reps.sparkSession.sparkContext.broadcast(points)  # some multiple of the square root of the table

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["v"].map(len).to_numpy()
            for d in np.unique(size):
                part = pdf[size == d]
                p = sent.value[int(d)]
                near = []
                for lo in range(0, len(part), 1024):
                    s = -(unit(part["v"].iloc[lo : lo + 1024]) @ p.T)
                    k = min(prefix, s.shape[1])
                    best = np.argpartition(s, k - 1, axis=1)[:, :k]
                    near.append(np.take_along_axis(best, np.argsort(np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1))
                yield pd.DataFrame({"rep": part["rep"], "copies": part["copies"], "v": part["v"], "near": list(np.concatenate(near).astype(np.int32))})

    return reps.select("rep", "copies", "v").mapInPandas(run, "rep long, copies long, v array<double>, near array<int>")


def links_of_list(m: np.ndarray, near: np.ndarray, side: np.ndarray, pivot: int, cosine: float, post: int, shared: int) -> np.ndarray:
    """Symmetric matrix of the links of one task whose first common list is that of ``pivot``."""
    left, right = two_sides(side)
    linked = np.zeros((len(m), len(m)), bool)
    if not len(left) or not len(right):
        return linked
    names, at = np.unique(near, return_inverse=True)
    has = np.zeros((len(m), len(names)), np.float32)
    has[np.arange(len(m))[:, None], at.reshape(near.shape)] = 1
    lists = np.sort(near[:, :post], axis=1)
    least = min(shared, near.shape[1])
    for lo in range(0, len(left), 512):
        rows = left[lo : lo + 512]
        candidate = has[rows] @ has[right].T >= least
        if not side[0]:
            candidate &= rows[:, None] < right
        i, j = np.nonzero(candidate)
        if 10 * len(i) > candidate.size:
            score = (m[rows] @ m[right].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", m[rows[i[k : k + 50_000]]], m[right[j[k : k + 50_000]]]) for k in range(0, len(i), 50_000)] or [np.zeros(0)])
        i, j = rows[i[score >= cosine]], right[j[score >= cosine]]
        for k in range(0, len(i), 50_000):
            x, y = lists[i[k : k + 50_000]], lists[j[k : k + 50_000]]
            common = (x[:, :, None] == y[:, None, :]).any(2)
            first = x[np.arange(len(x)), common.argmax(1)] == pivot
            linked[i[k : k + 50_000][first], j[k : k + 50_000][first]] = True
    return linked | linked.T


def near_vectors(vectors: DataFrame, cosine: float = 0.95, density: float = 4.0, apart: float = 0.7, prefix: int = 16, post: int = 6, shared: int = 3, block: int = 2048) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (vec_id = component_id)."""
    vectors = numbered(vectors.select(F.col("vec_id").cast("long"), "embedding"), "row", "embeddings")
    good = usable(vectors, "row")
    first = F.min(F.struct("vec_id", "row")).alias("first")
    reps = materialise(good.groupBy("v").agg(first, F.count("*").alias("copies")).select("v", "first", F.col("first.row").alias("rep"), "copies"), "vectors")
    described = materialise(permutations(reps, choose_pivots(reps, density, apart), prefix), "permutations")
    stands = F.explode(F.slice("near", 1, post)).alias("pivot")
    length = described.select(stands, F.size("v").alias("dims")).groupBy("pivot", "dims").agg(F.count("*").alias("members"))
    rows = described.select("rep", "copies", "v", "near", stands, F.size("v").alias("dims")).join(length, ["pivot", "dims"])
    tasks = block_pairs(rows, ["pivot", "dims"], "members", "rep", block)
    tasks = tasks.select("task", "side", "pivot", "rep", "copies", "near", "v").repartition("task").sortWithinPartitions("task", "side", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "task", 2 * block):
            task = pdf["task"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a < 2:
                    continue
                part = pdf.iloc[a:b]
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                linked = links_of_list(unit(part["v"]), np.stack(part["near"].to_list()), part["side"].to_numpy(), int(part["pivot"].iloc[0]), cosine, post, shared)
                many = linked @ copies
                hit = np.flatnonzero(many)
                if not len(hit):
                    continue
                yield pd.DataFrame({"rep": rep[hit], "links": many[hit], "other": pd.array([None] * len(hit), "Int64")})
                ties = np.array(forest(linked), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"rep": rep[ties[:, 0]], "links": 0, "other": pd.array(rep[ties[:, 1]], "Int64")})

    found = materialise(tasks.mapInPandas(run, "rep long, links long, other long"), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    told = reps.join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    told = materialise(told.select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "told")
    least = told.groupBy("component").agg(F.min("first.vec_id").alias("component_id"))
    of = good.join(told.join(least, "component"), "v").select("row", "vec_id", "n_links", "component_id")
    rest = vectors.join(of.select("row"), "row", "left_anti").select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of.unionByName(rest).drop("row").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
