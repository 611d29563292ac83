"""Packing token sequences by cutting-stock column generation.

A text's ids, closed by an end id, are cut into full sequences and one remainder.
Remainders of at most a 32nd of a sequence are joined to bundles of a quarter to a half, by
running sums within salted groups; from there on a bundle counts as one remainder.  Only the
histogram of lengths (at most ``capacity`` numbers, whatever the input) reaches the driver.  Lengths are taken as they
are where there are at most 128; else they are cut to 128 classes, each counted at its longest, such that the tokens
added by that are the fewest possible.  A linear program over patterns, each a multiset of classes
that fits in a sequence, is solved by column generation: the duals of the restricted
program price the lengths, and a knapsack dynamic program finds the pattern of greatest
worth, until none is worth more than a sequence.  The solution is rounded down, what is
left is packed by largest fit, and the patterns are handed to remainders by their rank
among those of the same class.  Ranks come from counts per (length, salt) and a row
number within each, so no class, however common, has to meet in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.llm.base import materialise, partitions
from rolesieve.llm.toxic_crf import slices

#: Characters of which it is known how the tokenizer's normalizer and splitter treat them.
_LETTERS = "a-zß-öø-ÿā-įıĳ-ɏ"
STRANGE = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-įıĲ-ɏ‘-”–—…€]")
UNIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\t-\r 0-9{_LETTERS}]+")


class CachedTokenizer:
    """Ids of whole texts by the tokenizers library, each distinct unit of its splitter once.

    The splitter's units never touch one another, so a text's ids are those of its units.
    Units new to a worker go to the library in one string, where the end-of-word pieces tell
    them apart.  Texts with characters outside the known ones, or with the vocabulary's
    special strings, go to it whole.
    """

    def __init__(self, path: str, cache: int = 220_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache, self.new, self.old = cache, {}, {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for piece, i in self.library.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, units: list[str]) -> list[bytes]:
        ids = np.frombuffer(self.whole(" ".join(units)), dtype="<u4")
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(units) or (len(ids) and cut[-1] != len(ids)):
            return [self.whole(u) for u in units]
        raw, start = ids.tobytes(), 0
        out = []
        for end in (4 * cut).tolist():
            out.append(raw[start:end])
            start = end
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, as the library's encode(text, add_special_tokens=False) has them."""
        if len(self.new) > self.cache:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found: list = []
        holes: list[list[tuple[int, str]]] = []
        missing: set[str] = set()
        for t in texts:
            if STRANGE.search(t) or any(x in t for x in self.special):
                found.append([self.whole(t)])
                holes.append([])
                continue
            units = UNIT.findall(t.lower())
            ids = list(map(new.get, units))
            hole = [(i, units[i]) for i, v in enumerate(ids) if v is None] if None in ids else []
            missing.update([u for _, u in hole])
            found.append(ids)
            holes.append(hole)
        fresh = []
        for u in missing:
            if (v := old.get(u)) is not None:
                new[u] = v
            else:
                fresh.append(u)
        for lo in range(0, len(fresh), 5000):
            part = fresh[lo : lo + 5000]
            new.update(zip(part, self.learn(part)))
        for ids, hole in zip(found, holes):
            for i, u in hole:
                ids[i] = new[u]
        return [np.frombuffer(b"".join(ids), dtype="<u4") for ids in found]


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def cut_batches(batches: Iterator[pa.RecordBatch], t: CachedTokenizer, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    close = np.array([end], dtype="<u4")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for batch in batches:
        for part, texts in slices(batch):
            rows = []
            for d, ids in zip(part["doc_id"].to_pylist(), t.encode_batch(texts)):
                ids = np.concatenate([ids, close])
                rows += [(d, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def pieces(docs: DataFrame, model: str, capacity: int = 2048, end: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each text cut after every ``capacity`` ids.

    A null or empty text is its end id alone.  Rows with the same doc_id stay apart pieces.
    """
    run = lambda batches: cut_batches(batches, tokenizer(model), capacity, end)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of lengths within ``capacity`` of greatest worth.

    As many states at a time as the shortest length has: none of them rests on another.
    """
    step = int(lengths.min())
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    padded = np.concatenate([np.full(int(lengths.max()), -np.inf), best])  # states below 0 are worth nothing at all
    shift = int(lengths.max())
    for lo in range(step, capacity + 1, step):
        hi = min(capacity + 1, lo + step)
        worth = values[:, None] + padded[shift + np.arange(lo, hi)[None, :] - lengths[:, None]]
        i = worth.argmax(0)
        found = worth[i, np.arange(hi - lo)]
        upto = np.maximum.accumulate(np.concatenate([[best[lo - 1]], found]))
        new = found > upto[:-1] + 1e-12
        best[lo:hi], last[lo:hi] = upto[1:], np.where(new, i, -1)
        padded[shift + lo : shift + hi] = best[lo:hi]
    pattern, c = np.zeros(len(lengths), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(lengths[last[c]])
    return best[capacity], pattern


def classes_of(lengths: np.ndarray, demand: np.ndarray, most: int) -> np.ndarray:
    """The class of each of the ascending ``lengths``, named by its longest: ``most`` at most, with the fewest tokens added."""
    n = len(lengths)
    if n <= most:
        return lengths.copy()
    count, tokens = np.cumsum(demand, dtype=float), np.cumsum(demand * lengths, dtype=float)
    before = np.concatenate([[0], count[:-1]]), np.concatenate([[0], tokens[:-1]])
    # added[i, j]: lengths i to j as one class
    added = lengths[None, :] * (count[None, :] - before[0][:, None]) - (tokens[None, :] - before[1][:, None])
    added[np.tril_indices(n, -1)] = np.inf
    least, starts = added[0].copy(), [np.zeros(n, int)]
    for _ in range(most - 1):
        option = np.concatenate([[0], least[:-1]])[:, None] + added
        starts.append(option.argmin(0))
        least = option[starts[-1], np.arange(n)]
    out, j = np.empty(n, lengths.dtype), n - 1
    for start in reversed(starts):
        if j < 0:
            break
        out[start[j] : j + 1] = lengths[j]
        j = int(start[j]) - 1
    return out


def largest_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Fill one sequence after another with the largest lengths that still fit; equal fillings are made together."""
    left, out = demand.astype(np.int64).copy(), []
    order = np.argsort(-lengths)
    while left.any():
        room, pattern = capacity, np.zeros(len(lengths), np.int64)
        for i in order:
            if left[i] and lengths[i] <= room:
                n = min(int(left[i]), room // int(lengths[i]))
                pattern[i] = n
                room -= n * int(lengths[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        out.append((times, pattern))
    return out


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000, most: int = 128, tolerance: float = 1.5e-3) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """[(uses, pattern)] that meet the demand of each class exactly, the classes, and the class of each of the ascending ``lengths``.

    The program has a row for each class (``classes_of``).  It ends when the bound that the duals give
    (Farley's) shows it within ``tolerance`` of the optimum over these classes.
    """
    of = classes_of(lengths, demand, most)
    classes, at = np.unique(of, return_inverse=True)
    need = np.bincount(at, weights=demand).astype(float)
    cap, m = capacity, len(classes)
    basis = np.diag([cap // int(c) for c in classes]).astype(float)
    inverse, bound = np.linalg.inv(basis), 0.0
    for k in range(rounds):
        duals = inverse.sum(0)
        worth, pattern = price(duals, classes, cap)
        x, way = inverse @ need, inverse @ pattern
        bound = max(bound, x.sum() / max(worth, 1.0))
        if worth <= 1 + 1e-6 or x.sum() <= bound * (1 + tolerance):
            break
        up = way > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
        else:  # change of one column
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    uses = np.floor(np.maximum(0, np.linalg.solve(basis, need)) + 1e-7).astype(np.int64)
    chosen = [(int(u), basis[:, j].astype(np.int64)) for j, u in enumerate(uses) if u]
    left = need.astype(np.int64) - sum((u * p for u, p in chosen), np.zeros(m, np.int64))
    while (left < 0).any():  # rounding noise: give back
        j = next(j for j, (u, p) in enumerate(chosen) if (p[left < 0] > 0).any())
        u, p = chosen[j]
        chosen[j] = (u - 1, p)
        left += p
    chosen = [(u, p) for u, p in chosen if u]
    chosen += largest_fit(classes, left, cap)
    return chosen, classes, of


def bundled(short: DataFrame, capacity: int) -> DataFrame:
    """Adds salt, bundle and at: runs of short remainders of a half, three eighths or a quarter of a sequence by salt, and each one's place in its run.

    A run starts wherever the running sum of its salt passes the next multiple of that width
    less a 256th of a sequence, so that runs fill a sequence among themselves; three
    widths leave the program room to fill up longer remainders.
    """
    widths = F.array(*(F.lit(max(1, capacity * k // 8 - capacity // 256)) for k in (4, 3, 2)))
    salted = short.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(2 * partitions(short.sparkSession))))
    order = Window.partitionBy("salt").orderBy("doc_id", "start", "length", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("length").over(order), F.lit(0))
    return salted.withColumn("at", at).withColumn("bundle", F.floor(F.col("at") / widths[(F.col("salt") % 3).cast("int")]))


def assign(remainders: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for each remainder or bundle (doc_id, start, length < capacity, ...)."""
    spark = remainders.sparkSession
    hist = remainders.groupBy("length").count().toPandas()  # at most ``capacity`` rows
    if hist.empty:
        return remainders.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    hist = hist.sort_values("length")
    lengths, demand = hist["length"].to_numpy(), hist["count"].to_numpy()
    plan, classes, of = cutting_stock(lengths, demand, capacity)
    # slots of a class in the order of ranks: (first rank, uses, copies a use, first sequence)
    slots, sequence, taken = [], 0, dict.fromkeys(classes.tolist(), 0)
    for uses, pattern in plan:
        for i in np.flatnonzero(pattern):
            c, copies = int(classes[i]), int(pattern[i])
            slots.append((c, taken[c], uses * copies, copies, sequence))
            taken[c] += uses * copies
        sequence += uses
    table = spark.createDataFrame(pd.DataFrame(slots, columns=["cls", "first", "n", "copies", "sequence"]))  # bounded by the histogram
    known = spark.createDataFrame(pd.DataFrame({"length": lengths, "cls": of}))
    ranked = rank_within(remainders.join(F.broadcast(known), "length"), "cls")
    placed = ranked.join(F.broadcast(table), (ranked.cls == table.cls) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["first"] + table["n"]))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("copies")))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*remainders.columns, F.col("sequence_id").cast("long"), F.coalesce(offset, F.lit(0)).cast("long").alias("offset"))


def rank_within(rows: DataFrame, group: str, salts: int | None = None) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each value of ``group``, ordered by salt, doc_id and start.

    ``group`` has a bounded number of values; the salts grow with the partitions, so
    that even one value that all rows share is counted and numbered in many tasks.
    """
    salts = salts or 2 * partitions(rows.sparkSession)
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(salts)))
    counts = rows.groupBy(group, "deal").count()
    before = F.sum("count").over(Window.partitionBy(group).orderBy("deal").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "deal", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy(group, "deal").orderBy("doc_id", "start", "length")) - 1
    return rows.withColumn("local", local).join(counts, [group, "deal"]).withColumn("rank", F.col("before") + F.col("local")).drop("deal", "local", "before")


def pack_documents(docs: DataFrame, model: str, capacity: int = 2048, end: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full pieces are sequences of their own, numbered after those of the remainders by
    negative ids.  Ties are ordered by doc_id and start; repeated rows are packed each; an
    empty table gives no rows; further columns are ignored; a null doc_id is packed like any other.
    """
    cut = materialise(pieces(docs, model, capacity, end), "pieces")
    full = rank_within(cut.where(F.col("length") == capacity).withColumn("one", F.lit(0)), "one")
    full = full.select(*cut.columns, (-F.col("rank") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = F.lit(None).cast("long")
    long = cut.where((F.col("length") < capacity) & (F.col("length") > capacity // 32)).withColumn("salt", none)
    short = materialise(bundled(cut.where((F.col("length") < capacity) & (F.col("length") <= capacity // 32)), capacity), "short")
    bundles = short.groupBy("salt", "bundle").agg(F.sum("length").alias("length"))
    bundles = bundles.select(none.alias("doc_id"), F.col("bundle").alias("start"), "length", none.alias("ids_crc32"), none.alias("doc_tokens"), "salt")
    placed = materialise(assign(long.unionByName(bundles), capacity), "placed")
    base = short.groupBy("salt", "bundle").agg(F.min("at").alias("base"))
    to = placed.where("salt is not null").select("salt", F.col("start").alias("bundle"), "sequence_id", "offset").join(base, ["salt", "bundle"])
    short = short.join(to, ["salt", "bundle"]).select(*cut.columns, "sequence_id", (F.col("offset") + F.col("at") - F.col("base")).alias("offset"))
    return placed.where("salt is null").select(*full.columns).unionByName(short).unionByName(full)
