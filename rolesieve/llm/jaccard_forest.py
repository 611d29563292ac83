"""Near-copy join of documents: n-gram Jaccard similarity by a MinHash LSH forest.

A document is the set of its runs of ``words`` words (lower case, split at ASCII white
space; a shorter text is one run of all its words; 64-bit hashes stand for the runs).
Documents of equal sets are one class from the start.  Each class has a signature of
trees * depth minima, and every tree of the forest is the prefix trie of the classes'
slices of it: a node at depth k holds the classes whose first k minima agree.

The descent starts at the leaves.  At each depth the pairs inside the nodes that the
signature estimate (with six standard deviations of room) and the set sizes allow are
weighed: a pair of similarity s meets in some tree with probability
P = 1 - (1 - s**k)**trees, so one pair met stands for 1 / P pairs.  What was met over what
that stands for is the recall of the depth on this table; while it is short of
``recall``, or nothing was met at all, the prefixes are shortened by one, down to the
depth at which even pairs of exactly ``similarity`` reach it.

A node is cut into pairs of blocks, so no task holds more than two blocks of it.  A pair
is looked at in the first tree in which it meets, and only classes with such a pair are
sent to verification, which compares whole sets and returns counts and a spanning
forest, never the pairs.  Where no links are counted, parts that are joined already are not
compared again (``joined``), so a group of near copies costs rows in proportion to its size.

Every row is a document of its own, also where rows share a doc_id: links count rows,
and exactly one row of a class is kept, the first by doc_id.  Texts that are null or
without words, and rows with a null doc_id, link with nothing and are kept.  An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.base import block_pairs, discard, forest, materialise, numbered, two_sides, whole_groups
from rolesieve.llm.components import connected_components

_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_INV = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_up, _down = _powers(_P, 1 << 16), _powers(_INV, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) <= n:
        _up, _down = _powers(_P, n + n // 4), _powers(_INV, n + n // 4)
    return _up, _down


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    h = word_hashes(text)
    n = min(words, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out + np.uint64(n)))


def meeting(similarity, depth: int, trees: int):
    """Probability that a pair meets in some tree at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The deepest prefix at which pairs of the least similarity meet with the wanted probability."""
    while depth > 1 and meeting(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def signatures(docs: DataFrame, words: int, minima: int) -> DataFrame:
    """row, doc_id, n (runs), key (of the whole set), signature (uint32 minima); documents without words have n 0."""
    rng = np.random.default_rng(11)
    a = rng.integers(1, _M, minima, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, d, t in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                s = shingle_set(t, words) if isinstance(t, str) else np.zeros(0, np.uint64)
                if len(s):
                    low = np.full(minima, _M, np.uint64)
                    for lo in range(0, len(s), 4096):
                        low = np.minimum(low, (a[:, None] * s[None, lo : lo + 4096]).min(1))
                    sig = (low >> np.uint64(32)).astype("<u4").tobytes()
                else:
                    sig = b""
                rows.append((r, d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "n", "key", "signature"])

    return docs.mapInPandas(run, "row long, doc_id long, n long, key binary, signature binary")


def _pairs_of(task: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal tasks."""
    start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    return start, np.diff(np.append(start, len(task)))


def nodes_of(reps: DataFrame, trees: int, depth: int, at: int) -> DataFrame:
    """rep, tree, prefix, members: the trie nodes of two classes or more at a depth."""
    word = lambda t: F.substring("signature", 4 * depth * t + 1, 4 * at)
    spread = reps.select("rep", F.posexplode(F.array(*[F.xxhash64(word(t)) for t in range(trees)])).alias("tree", "prefix"))
    size = spread.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where("members > 1")
    return materialise(spread.join(size, ["tree", "prefix"]).select("rep", "tree", "prefix", "members"), "prefixes")


def signed(rows: DataFrame, reps: DataFrame) -> DataFrame:
    return rows.join(reps.select("rep", "n", "signature"), "rep").select("task", "side", "tree", "rep", "part", "n", "signature")


def node_tasks(reps: DataFrame, trees: int, depth: int, at: int, block: int) -> DataFrame:
    """task, side, tree, rep, part, n, signature: the nodes as pairs of blocks; pairs inside a part (here none) are not looked at."""
    rows = block_pairs(nodes_of(reps, trees, depth, at), ["tree", "prefix"], "members", "rep", block)
    return signed(rows.withColumn("part", F.col("rep")), reps)


def star_tasks(rows: DataFrame, reps: DataFrame, order: Column, block: int) -> DataFrame:
    """As ``node_tasks``, but each class of a node meets only the node's first by ``order``: a row for each class and head, tree -1."""
    head = rows.groupBy("tree", "prefix").agg(F.min(F.struct(order.alias("order"), "rep", "part")).alias("head"))
    pairs = rows.join(head, ["tree", "prefix"]).where("part <> head.part").select("rep", "part", F.col("head.rep").alias("head"), F.col("head.part").alias("of")).distinct()
    pairs = materialise(pairs, "stars")
    size = pairs.groupBy("head").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = pairs.join(size, "head").withColumn("task", F.xxhash64("head", F.pmod(F.xxhash64("rep"), "blocks")))
    heads = dealt.select("task", F.lit(1).alias("side"), F.col("head").alias("rep"), F.col("of").alias("part")).distinct()
    dealt = dealt.select("task", F.lit(2).alias("side"), "rep", "part").unionAll(heads)
    return signed(dealt.withColumn("tree", F.lit(-1)), reps)


def rest_tasks(rows: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """As ``node_tasks``, for all pairs of different parts: blocks of a node's largest part meet only the blocks of the others."""
    size = rows.groupBy("tree", "prefix", "part").agg(F.count("*").alias("size"))
    whole = size.groupBy("tree", "prefix").agg(F.sum("size").alias("members"), F.max(F.struct("size", "part")).alias("top"))
    one, big = F.col("members") <= block, F.col("part") == F.col("top.part")
    rows = rows.join(whole, ["tree", "prefix"])
    rows = rows.withColumns({"bigs": F.ceil(F.col("top.size") / block), "smalls": F.greatest(F.lit(1), F.ceil((F.col("members") - F.col("top.size")) / block))})
    at = lambda blocks: F.pmod(F.xxhash64("rep"), blocks)
    own = F.when(one, F.lit(0)).when(big, at("bigs")).otherwise(F.col("bigs") + at("smalls"))
    met = F.when(one, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(big, F.col("bigs")).otherwise(F.lit(0)), F.col("bigs") + F.col("smalls") - 1))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(met))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return signed(rows.select(F.xxhash64("tree", "prefix", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side.alias("side"), "tree", "rep", "part"), reps)


def hooked(edges: DataFrame) -> DataFrame:
    """(node, component): a class that each class reaches in two steps down; equal ones are joined, different ones may be."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
    return up.join(up.select(F.col("node").alias("up"), F.col("up").alias("component")), "up").select("node", "component")


def still_mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of three classes or more that hold more than one part, by the parts known now (a star tries all of two)."""
    labels = labels.select(F.col("node").alias("rep"), F.col("component").alias("now"))
    rows = materialise(rows.join(labels, "rep", "left").select("tree", "prefix", "rep", F.coalesce("now", "rep").alias("part")), "parts")
    several = rows.groupBy("tree", "prefix").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members")).where("lo < hi and members > 2")
    return materialise(rows.join(several.select("tree", "prefix", "members"), ["tree", "prefix"]), "mixed")


def worth_verifying(tree: int, sig: np.ndarray, n: np.ndarray, side: np.ndarray, part: np.ndarray, at: int, depth: int, similarity: float):
    """(i, j, estimate, trees met) of the pairs of a task that first meet in this tree (-1: in any) and may be similar enough."""
    minima = sig.shape[1]
    least = similarity - 6 * (similarity * (1 - similarity) / minima) ** 0.5
    left, right = two_sides(side)
    out = []
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        same = sig[rows][:, None, :] == sig[right]
        share = same.mean(2)
        ok = (share >= least) & (np.minimum(n[rows][:, None], n[right]) >= similarity * np.maximum(n[rows][:, None], n[right]) - 1e-9)
        ok &= part[rows][:, None] != part[right]
        if not side[0]:
            ok &= rows[:, None] < right
        i, j = np.nonzero(ok)
        if len(i):
            met = same[i, j].reshape(len(i), -1, depth)[:, :, :at].all(2)
            first = met.any(1) & (met.argmax(1) == tree) if tree >= 0 else np.ones(len(i), bool)
            out.append((rows[i[first]], right[j[first]], share[i, j][first], met.sum(1)[first]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, int)] * 4


def met_pairs(tasks: DataFrame, trees: int, depth: int, at: int, similarity: float) -> DataFrame:
    """(task, side, tree, rep, part, met, due) for each class with a pair to verify in a task.

    ``met`` is how many pairs the class met first in this task (each pair counted at one of
    its ends) and ``due`` how many such pairs the table must hold for that many to meet.
    """
    minima = trees * depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "task"):
            rep, n, side, tree, task, part = (pdf[c].to_numpy() for c in ("rep", "n", "side", "tree", "task", "part"))
            sig = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(len(pdf), minima)
            start, size = _pairs_of(task)
            two = start[size == 2]  # tasks of two rows, all at once
            same = sig[two] == sig[two + 1]
            share, met = same.mean(1), same.reshape(len(two), trees, depth)[:, :, :at].all(2)
            least = similarity - 6 * (similarity * (1 - similarity) / minima) ** 0.5
            ok = (share >= least) & (np.minimum(n[two], n[two + 1]) >= similarity * np.maximum(n[two], n[two + 1]) - 1e-9) & ((tree[two] < 0) | met.any(1) & (met.argmax(1) == tree[two])) & (part[two] != part[two + 1]) & ((side[two] == 0) | (side[two] != side[two + 1]))
            found = [(two[ok], two[ok] + 1, share[ok])]
            for s, k in zip(start[size > 2], size[size > 2]):
                i, j, e, _ = worth_verifying(int(tree[s]), sig[s : s + k], n[s : s + k], side[s : s + k], part[s : s + k], at, depth, similarity)
                found.append((s + i, s + j, e))
            i, j, e = (np.concatenate(x) for x in zip(*found))
            count = np.bincount(i, minlength=len(pdf))
            due = np.bincount(i, weights=1 / meeting(np.maximum(e, similarity), at, trees), minlength=len(pdf))
            need = np.zeros(len(pdf), bool)
            need[i] = need[j] = True
            need = np.flatnonzero(need)
            yield pd.DataFrame({"task": task[need], "side": side[need], "tree": tree[need], "rep": rep[need], "part": part[need], "met": count[need], "due": due[need]})

    dealt = tasks.repartition("task").sortWithinPartitions("task", "side", "rep")
    return dealt.mapInPandas(run, "task long, side int, tree int, rep long, part long, met long, due double")


def descend(reps: DataFrame, trees: int, depth: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, int]:
    """The classes to verify by task, from the first depth whose recall on this table suffices, and that depth."""
    shortest = prefix_depth(trees, depth, similarity, recall)
    at = depth
    while True:
        found = materialise(met_pairs(node_tasks(reps, trees, depth, at, block), trees, depth, at, similarity), "met")
        met, due = found.agg(F.sum("met"), F.sum("due")).first()
        if at <= shortest or (met and met >= recall * due):
            return found, at
        discard(found)
        at -= 1


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by slices of the incidence matrix."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def verified(docs: DataFrame, found: DataFrame, reps: DataFrame, trees: int, depth: int, at: int, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links of the classes, verified on the whole sets: (rep, links) and spanning edges (a, b)."""
    wanted = materialise(found.select("rep").distinct(), "wanted")  # its size is known before the texts move
    texts = docs.select(F.col("row").alias("rep"), "text").join(wanted, "rep").join(reps.select("rep", "copies", "n", "signature"), "rep")
    rows = found.select("task", "side", "tree", "rep", "part").join(texts, "rep")
    rows = rows.repartition("task").sortWithinPartitions("task", "side", "rep")
    minima = trees * depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "task", 1_000):
            start, size = _pairs_of(pdf["task"].to_numpy())
            rep, copies, side, tree, n, part = (pdf[c].to_numpy() for c in ("rep", "copies", "side", "tree", "n", "part"))
            sig = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(len(pdf), minima)
            out = []
            for s, k in zip(start, size):
                i, j, _, _ = worth_verifying(int(tree[s]), sig[s : s + k], n[s : s + k], side[s : s + k], part[s : s + k], at, depth, similarity)
                if not len(i):
                    continue
                sets = [shingle_set(t, words) for t in pdf["text"].iloc[s : s + k]]
                m = np.array([len(x) for x in sets], float)
                if len(i) > 4 * k:
                    both = overlaps(sets)[i, j]
                else:
                    both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], float)
                sure = both >= similarity * (m[i] + m[j] - both) - 1e-9
                i, j = i[sure], j[sure]
                linked = np.zeros((k, k), bool)
                linked[i, j] = linked[j, i] = True
                many = linked @ copies[s : s + k]
                hit = np.flatnonzero(many)
                out.append(pd.DataFrame({"rep": rep[s + hit], "links": many[hit], "other": None}))
                out.append(pd.DataFrame([(rep[s + x], 0, rep[s + y]) for x, y in forest(linked)], columns=["rep", "links", "other"]))
            if out:
                got = pd.concat([x for x in out if len(x)] or out[:1])
                yield got.astype({"rep": "int64", "links": "int64", "other": "Int64"})

    links = materialise(rows.mapInPandas(run, "rep long, links long, other long"), "links")
    count = links.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    return count, links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def joined(docs: DataFrame, reps: DataFrame, trees: int, depth: int, at: int, words: int, similarity: float, block: int) -> DataFrame:
    """(node, component) of the classes that links join, without the links inside what is joined already.

    In each node all classes are compared with one head, what that leaves apart in nodes of more
    than a block with another head, and in the end all pairs that are still of different parts.
    """
    nodes = nodes_of(reps, trees, depth, at)
    rows, tried = nodes.withColumn("part", F.col("rep")), []

    def compare(tasks: DataFrame) -> DataFrame:
        tried.append(verified(docs, materialise(met_pairs(tasks, trees, depth, at, similarity), "met"), reps, trees, depth, at, words, similarity)[1])
        return reduce(DataFrame.unionAll, tried)

    rows = still_mixed(rows, hooked(compare(star_tasks(rows, reps, F.col("rep"), block))))
    large = rows.where(F.col("members") > block)
    if not large.isEmpty():
        rows = still_mixed(rows, hooked(compare(star_tasks(large, reps, F.xxhash64("rep", "tree"), block))))
    if not rows.isEmpty():
        compare(rest_tasks(rows.drop("members"), reps, 4 * block))
    return connected_components(reduce(DataFrame.unionAll, tried))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, trees: int = 16, depth: int = 4, recall: float = 0.99998, block: int = 256, row: str | None = None, links: bool = True) -> DataFrame:
    """One row a document: doc_id, n_links, class_id (smallest doc_id reachable by links), kept (the one row of its class).

    ``row`` names a column of ``docs`` that is a key of its rows, if it has one; the result then has it too.
    Without ``links`` there is no n_links: the classes are the same, found without comparing all pairs of a class
    and at the depth at which pairs of exactly ``similarity`` reach the recall.
    """
    if row is None:
        docs = numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "row", "documents")
    else:
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(row).cast("long").alias("row"))
    sigs = materialise(signatures(docs.select("row", "doc_id", "text"), words, trees * depth), "signatures")
    real = sigs.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "row")).alias("first")
    reps = real.groupBy("key").agg(first, F.count("*").alias("copies"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    reps = materialise(reps.select("key", F.col("first.row").alias("rep"), "first", "copies", "n", "signature"), "reps")
    if links:
        found, at = descend(reps, trees, depth, similarity, recall, block)
        counted, edges = verified(docs, found, reps, trees, depth, at, words, similarity)
        classes = connected_components(edges)
    else:
        classes = joined(docs, reps, trees, depth, prefix_depth(trees, depth, similarity, recall), words, similarity, block)
        counted = classes.select(F.col("node").alias("rep"), F.lit(0).cast("long").alias("links"))
    classes = classes.select(F.col("node").alias("rep"), "component")
    of_key = reps.join(counted, "rep", "left").join(classes, "rep", "left").select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    of_key = materialise(of_key, "classes")
    least = of_key.groupBy("component").agg(F.min("first").alias("least"))
    of_key = of_key.join(least, "component").select("key", "n_links", "least")
    members = sigs.select("row", "doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = members.where("key is not null").join(of_key, "key").select("row", "doc_id", "n_links", F.col("least.doc_id").alias("class_id"), (F.col("least.row") == F.col("row")).alias("kept"))
    alone = members.where("key is null").select("row", "doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    out = out.unionByName(alone)
    out = out if links else out.drop("n_links")
    return out.drop("row") if row is None else out.withColumnRenamed("row", row)
