"""Approximate nearest neighbours by learned partitions.

Vectors of one length are an index of their own.  A bounded sample of it (``per_part``
rows for each partition, ``most`` at most) is tied to its nearest neighbours; the neighbour
graph is cut into partitions of equal size by moving vertices to where most of their
neighbours are as long as there is room.  A small network learns the partition of a
vector; it files every row of the table, and sends a query to its most probable
partitions, whose rows are reranked by exact cosine.  The partitions grow with the square
root of the rows.  How many of them a query tries is set on part of the sample that the
network has not seen: the least number that finds ``recall`` of the true neighbours
there.  Partitions of very many rows, and the queries that try one, are cut into blocks.
A length with too few rows in the sample is one partition, searched whole.  A query that
found fewer than ``k`` in its partitions is asked once more, in all of them.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
null vec_ids.  Ties go to the smaller vec_id; with repeated vec_ids each row is a query and
a candidate of its own, but never a candidate for its own vec_id; fewer than ``k``
candidates give fewer rows, an empty table none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.base import materialise
from rolesieve.llm.pivot_index import unit, usable


@dataclass
class Router:
    layers: list[np.ndarray]
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, the most probable first."""
        w1, b1, w2, b2 = self.layers
        return np.argsort(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2), axis=1, kind="stable")


def neighbours(x: np.ndarray, k: int, among: np.ndarray | None = None) -> np.ndarray:
    """Nearest rows of ``among`` (or of x itself, without the row) by cosine."""
    y, out = x if among is None else among, []
    for lo in range(0, len(x), 512):
        s = x[lo : lo + 512] @ y.T
        if among is None:
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15, seed: int = 3) -> np.ndarray:
    """Label of each vertex; no label has more than ``slack`` times the mean."""
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    label = np.full(n, -1)
    for _ in range(6):  # a first cut by balanced means
        score = x @ centre.T
        label[:] = -1
        size = np.zeros(parts, int)
        best = np.argsort(-score, axis=1)
        for i in np.argsort(-(np.take_along_axis(score, best[:, :1], 1)[:, 0])):
            for p in best[i]:
                if size[p] < room:
                    label[i], size[p] = p, size[p] + 1
                    break
        for p in range(parts):
            if size[p]:
                c = x[label == p].sum(0)
                centre[p] = c / (np.linalg.norm(c) + 1e-12)
    both = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    both = [np.array(b) for b in both]
    for _ in range(rounds):  # fewer cut edges
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[both[i]], minlength=parts)
            votes[(size >= room) & (np.arange(parts) != label[i])] = -1
            p = int(votes.argmax())
            if votes[p] > votes[label[i]]:
                size[label[i]] -= 1
                size[p] += 1
                label[i] = p
                moved += 1
        if moved < n // 200:
            break
    return label


def fit_router(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, hidden: int = 64, epochs: int = 40, seed: int = 5) -> list[np.ndarray]:
    """Train on each vertex's own partition and those of its neighbours."""
    rng = np.random.default_rng(seed)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), label] += 0.5
    d = x.shape[1]
    layers = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [0 * a for a in layers], [0 * a for a in layers], 0
    scale = d**0.5
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            b = order[lo : lo + 256]
            z = x[b] * scale
            h = np.maximum(z @ layers[0] + layers[1], 0)
            s = h @ layers[2] + layers[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[b]) / len(b)
            back = g @ layers[2].T * (h > 0)
            t += 1
            for i, gr in enumerate([z.T @ back, back.sum(0), h.T @ g, g.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                layers[i] = layers[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    layers[0] = layers[0] * scale
    return layers


def one_partition(dims: int) -> Router:
    return Router([np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)


def train_one(x: np.ndarray, parts: int, k: int, recall: float) -> Router:
    """The router of a sample of unit vectors."""
    parts = max(1, min(parts, len(x) // 20))
    if parts == 1:
        return one_partition(x.shape[1])
    test = min(2000, max(20, len(x) // 5))
    seen, held = x[test:], x[:test]
    graph = neighbours(seen, min(10, len(seen) - 1))
    label = balanced_partition(graph, seen, parts)
    router = Router(fit_router(seen, label, graph, parts), parts)
    filed = router.order(seen)[:, 0]
    true = filed[neighbours(held, min(k, len(seen)), seen)]
    place = np.argsort(router.order(held), axis=1)  # when each partition is tried
    tried = np.take_along_axis(place, true, 1)
    share = [(tried < p).mean() for p in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(share) >= min(recall, share[-1])))
    return router


def train(vectors: DataFrame, k: int, recall: float, per_part: int, most: int) -> dict[int, Router]:
    """A router for each length of vector in the sample, its rows the first by a hash of vec_id."""
    n = vectors.count()
    some = vectors.withColumn("at", F.xxhash64("vec_id", F.lit(6))).orderBy("at", "vec_id").limit(sample_of(n, per_part, most)).select("v").toPandas()["v"]
    out = {}
    for dims, mine in some.groupby(some.map(len)):
        out[int(dims)] = train_one(unit(mine), parts_of(n * len(mine) // len(some), len(mine), per_part), k, recall)
    return out


def parts_of(n: int, sampled: int, per_part: int) -> int:
    """Partitions for n rows: 16, or the 14th of their square root, as far as the sample can tell them apart."""
    return min(max(16, int(n**0.5 / 14)), max(1, sampled // per_part))


def sample_of(n: int, per_part: int, most: int) -> int:
    return min(most, per_part * max(16, int(n**0.5 / 14)))


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, per_part: int = 250, most: int = 40_000, block: int = 4096, asking: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``."""
    good = usable(vectors)
    routers = train(good, k, recall, per_part, most)
    sent = vectors.sparkSession.sparkContext.broadcast(routers)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["v"].map(len).to_numpy()
            for d in np.unique(size):
                part = pdf[size == d]
                r = sent.value.get(int(d)) or one_partition(int(d))
                order = r.order(unit(part["v"])).astype(np.int32)
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "dims": int(d), "part": order[:, 0], "probes": list(order[:, : r.probes])})

    routed = good.mapInPandas(route, "vec_id long, v array<double>, dims int, part int, probes array<int>")
    filed = materialise(routed.withColumn("row", F.monotonically_increasing_id()), "filed")
    queries = filed.where(F.col("vec_id") % every == 0)
    blocks = filed.groupBy("dims", "part").agg(F.count("*").alias("n"))
    blocks = blocks.select("dims", "part", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    base = filed.join(blocks, ["dims", "part"]).select("dims", "part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v")

    def rerank(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, m = rows["vec_id"].to_numpy(), unit(rows["v"])
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            for lo in range(0, len(queries), 256):
                part = queries.iloc[lo : lo + 256]
                q = part["query_id"].to_numpy()
                s = unit(part["q"]) @ m.T
                s[q[:, None] == ids] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, 1)
                ok = score > -np.inf
                of = np.broadcast_to(np.arange(len(q))[:, None], best.shape)[ok]
                out.append(pd.DataFrame({"row": part["row"].to_numpy()[of], "query_id": q[of], "vec_id": ids[best][ok], "score": score[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})

    def ask(pairs: DataFrame) -> DataFrame:
        """The ``k`` best of (row, query_id, q, dims, part) by query row; the pairs of a partition are dealt to blocks of queries."""
        load = pairs.groupBy("dims", "part").agg(F.ceil(F.count("*") / asking).cast("int").alias("shares"))
        pairs = pairs.join(blocks, ["dims", "part"]).join(load, ["dims", "part"])
        pairs = pairs.select("row", "query_id", "q", "dims", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), F.col("shares")).cast("int").alias("share"))
        rows = base.join(load, ["dims", "part"]).select("dims", "part", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "v")
        keys = ["dims", "part", "block", "share"]
        asked = pairs.withColumnsRenamed({x: f"asked_{x}" for x in keys})
        found = asked.groupBy(*(f"asked_{x}" for x in keys)).cogroup(rows.groupBy(*keys)).applyInPandas(rerank, "row long, query_id long, vec_id long, score double")
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asked = queries.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dims", F.explode("probes").alias("part"))
    first = materialise(ask(asked), "nearest")
    full = first.groupBy("row").count().where(F.col("count") >= k).select("row")
    short = queries.join(full, "row", "left_anti").select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dims")
    out = ["query_id", "rank", "vec_id", "score"]
    if short.isEmpty():
        return first.select(*out)
    short = materialise(short, "short")
    again = ask(short.join(blocks.select("dims", "part"), "dims"))
    return first.join(short.select("row"), "row", "left_anti").select(*out).unionByName(again.select(*out))
