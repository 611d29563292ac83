"""Ranked lexical search for many items at once, with the sums that items share made once.

An item's score of a document is a sum over the item's terms, so two items that hold the
same set of terms hold the same partial sum.  Such sets are mined among the items of a
block: the two addends that most items have together become a node, whose own sum is an
addend from then on, until no two addends stand together in two items.  The nodes form a
graph in which every item is a short sum of nodes, and a node may feed many others.

For the documents the block's terms are counted once and written (documents as blocks of
postings).  A task then takes a block of documents, fills one accumulator for each term,
adds up one for each node, in the order in which nodes were mined, and each item's score
from these.  Scores are integers, so the order of the sums does not show.  Only the best
of each item leave a task.

Items come in blocks of a bounded number of bytes; what is sent to every task (terms,
graph) is at most a few times that.  Each block reads the texts once more, which its own
scores outweigh by far.  The blocks are mined in tasks; the driver holds one at a time.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.base import discard, materialise, numbered

#: Bytes that end a term become spaces, A-Z become a-z; all bytes of characters beyond ASCII belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
POSTINGS = "docs array<long>, lengths array<long>, kinds array<int>, terms array<int>, counts array<long>, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, repeats included."""
    return text.translate(TERM_BYTES).split()


class Plan:
    """Terms of a block of items and the graph of their shared sums.

    Addends are numbered: terms first, then terms that an item repeats (``repeats``: number of
    the term, how often), then nodes (``nodes``: the two addends of each), in ``rounds`` whose nodes rest on
    earlier ones only.  ``sums`` lists each item's addends, ``items`` the (row, item_id) of each.
    """

    def __init__(self, items: list[tuple[int, int | None, bytes]], piece: int = 64):
        self.items = [(row, item_id) for row, item_id, _ in items]
        self.terms: dict[bytes, int] = {}
        counted = []
        for _, _, text in items:
            counted.append(Counter(self.terms.setdefault(t, len(self.terms)) for t in terms_of(text)))
        repeats: dict[tuple[int, int], int] = {}
        sets = [{t if n == 1 else repeats.setdefault((t, n), len(self.terms) + len(repeats)) for t, n in c.items()} for c in counted]
        self.repeats = np.array(list(repeats), np.int64).reshape(-1, 2)
        self.top = len(self.terms) + len(repeats)
        self.nodes, self.rounds = np.empty((0, 2), np.int64), []
        while len(pairs := self._disjoint(sets, piece)):
            new = {}
            for i, (a, b) in enumerate(pairs.tolist(), self.top):
                new[a] = (b, i)
            for s in sets:
                for a in [a for a in s if a in new and new[a][0] in s]:
                    b, i = new[a]
                    s -= {a, b}
                    s.add(i)
            self.rounds.append((self.top, self.top + len(pairs)))
            self.nodes = np.concatenate([self.nodes, pairs])
            self.top += len(pairs)
        self.sums = [np.array(sorted(s), np.int64) for s in sets]

    @staticmethod
    def _disjoint(sets: list[set], piece: int) -> np.ndarray:
        """Pairs of addends that stand together in two items or more, the most frequent first, no addend twice.

        An item of many shared addends is looked at in pieces, so its pairs stay in proportion to its length.
        """
        often = Counter(a for s in sets for a in s)
        keys = []
        for s in sets:
            shared = sorted((a for a in s if often[a] > 1), key=lambda a: (-often[a], a))
            for lo in range(0, len(shared), piece):
                x = np.sort(np.array(shared[lo : lo + piece], np.int64))
                i, j = np.triu_indices(len(x), 1)
                keys.append((x[i] << 32) | x[j])
        pairs, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64),) * 2
        pairs, n = pairs[n > 1], n[n > 1]
        used, out = set(), []
        for p in pairs[np.argsort(-n, kind="stable")].tolist():
            a, b = p >> 32, p & 0xFFFFFFFF
            if a not in used and b not in used:
                used |= {a, b}
                out.append((a, b))
        return np.array(out, np.int64).reshape(-1, 2)

    def scores(self, contribution: np.ndarray, term: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores (items x documents) of a block of documents from the contributions of their postings."""
        acc = np.zeros((self.top, n_docs), np.int64)
        acc[term, doc] = contribution
        lo = len(self.terms)
        acc[lo : lo + len(self.repeats)] = acc[self.repeats[:, 0]] * self.repeats[:, 1:]
        for a, b in self.rounds:
            pairs = self.nodes[a - lo - len(self.repeats) : b - lo - len(self.repeats)]
            np.add(acc[pairs[:, 0]], acc[pairs[:, 1]], out=acc[a:b])
        return np.stack([acc[s].sum(0) for s in self.sums])


class _Best:
    """The k best documents of each item: highest score first, equal ones by ascending doc_id, null last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n_items)]

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        for i in np.flatnonzero(scores.max(1, initial=0) >= self.least):
            new = np.flatnonzero(scores[i] >= self.least[i])
            s = scores[i][new]
            if len(s) > self.k:  # those equal to the k-th stay until ids decide
                few = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                new, s = new[few], s[few]
            s, d, n = (np.concatenate(x) for x in zip(self.held[i], (s, ids[new], null[new])))
            order = np.lexsort([d, n, -s])[: self.k]
            self.held[i] = s[order], d[order], n[order]
            if len(order) == self.k:
                self.least[i] = s[order[-1]]


def _flat(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def count_postings(docs: DataFrame, terms: dict[bytes, int], block: int = 1 << 20, most: int = 4096) -> DataFrame:
    """Documents in blocks: how many terms each has, and how often it has each of ``terms`` (``kinds``: how many of them)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).to_pylist()]
            lo = size = 0
            lengths, kinds, found, counts = [], [], [], []
            for hi in range(1, len(texts) + 1):
                words = terms_of(texts[hi - 1])
                mine = [(known[t], n) for t, n in Counter(words).items() if t in known]
                lengths.append(len(words))
                kinds.append(len(mine))
                found += [t for t, _ in mine]
                counts += [n for _, n in mine]
                size += len(texts[hi - 1])
                if size < block and hi - lo < most and hi < len(texts):
                    continue
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [one(ids.slice(lo, hi - lo).to_pylist(), pa.int64()), one(lengths, pa.int64()), one(kinds, pa.int32()), one(found, pa.int32()), one(counts, pa.int64())]
                    + [pa.array([sum(n > 0 for n in lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())],
                    names=[c.split()[0] for c in POSTINGS.split(", ")],
                )
                lo, size = hi, 0
                lengths, kinds, found, counts = [], [], [], []

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(work, POSTINGS)


def _document_counts(postings: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the block stands; partitions send sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in postings.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _best_of_block(postings: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int, cells: int) -> DataFrame:
    """(item_row, item_id, doc_id, score): at most k rows for each item and task."""
    sent = postings.sparkSession.sparkContext.broadcast((plan, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = sent.value
        best = _Best(len(plan.items), k)
        step = max(1, cells // max(1, plan.top))
        for batch in batches:
            docs, lengths, kinds, terms, counts = batch.columns
            for row in range(batch.num_rows):
                listed = docs[row].values
                null, ids = listed.is_null().to_numpy(zero_copy_only=False), listed.fill_null(np.iinfo(np.int64).max).to_numpy()
                n, many, term, tf = _flat(lengths, row), _flat(kinds, row), _flat(terms, row), _flat(counts, row)
                m = 75 + (25 * n * n_docs) // max(1, n_terms)
                doc = np.repeat(np.arange(len(n)), many)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                ends = np.concatenate([[0], np.cumsum(many)])
                for lo in range(0, len(n), step):
                    hi = min(len(n), lo + step)
                    p = slice(ends[lo], ends[hi])
                    best.add(plan.scores(part[p], term[p], doc[p] - lo, hi - lo), ids[lo:hi], null[lo:hi])
        for (row, item_id), (s, d, n) in zip(plan.items, best.held):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(s), pa.int64()), pa.array([item_id] * len(s), pa.int64()), pa.array(d, mask=n), pa.array(s)], names=["item_row", "item_id", "doc_id", "score"])

    return postings.select("docs", "lengths", "kinds", "terms", "counts").mapInArrow(work, "item_row long, item_id long, doc_id long, score long")


def mined_plans(items: DataFrame, blocks: int) -> DataFrame:
    """(block, plan) of ``items`` (item_row, item_id, text): one task mines a block."""

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r), None if pd.isna(i) else int(i), (t or "").encode()) for r, i, t in zip(pdf["item_row"], pdf["item_id"], pdf["text"])]
        return pd.DataFrame({"block": pdf["block"].iloc[:1].astype("int64"), "plan": [pickle.dumps(Plan(rows))]})

    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)))
    return keyed.groupBy("block").applyInPandas(mine, "block long, plan binary")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 1 << 20, cells: int = 1 << 22) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are stretches of letters and digits, A-Z in lower case, with all characters beyond
    ASCII taken as letters.  A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's
    m is 75 + 25 n N div L, and a term adds weight * (10^9 tf div (1000 tf + 12 m)) for each time it
    stands in the item.  N counts the documents with a term, L and n are terms with repeats.

    Documents of score 0 are left out, so items without a known term (null and empty texts)
    have no rows.  Equal scores go by ascending doc_id, null last.  Rows of ``docs`` are documents
    each, and rows of ``items`` are items each, whatever their ids; further columns are ignored;
    either table may be empty.  Texts of any length are counted whole.  ``cells`` bounds the
    accumulators that a task holds (8 bytes each).
    """
    spark = docs.sparkSession
    items = numbered(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), "item_row", "items")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // block_bytes))
    plans = materialise(mined_plans(items, blocks), "plans")
    parts, wide = [], []
    for block in range(blocks):
        row = plans.where(F.col("block") == block).head()
        if row is None:
            continue
        plan = pickle.loads(row["plan"])
        wide.append(materialise(count_postings(docs, plan.terms), "postings"))
        n_docs, n_terms = (int(x or 0) for x in wide[-1].agg(F.sum("n_docs"), F.sum("n_terms")).head())
        df = _document_counts(wide[-1], len(plan.terms))
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        parts.append(materialise(_best_of_block(wide[-1], plan, weights, n_docs, n_terms, k, cells), "best"))
        discard(wide.pop())
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
