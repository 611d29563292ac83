"""Runs of repeated words, found on a grammar of each document.

The words of a document are numbered and Re-Pair builds its grammar: the pair of
neighbours that occurs most often becomes a nonterminal, again and again, until no pair
occurs twice.  Pairs that do not touch are replaced in one round, ties in an order by
hash, so a round takes a share of what is left and not one pair.  The symbols left over
are joined two by two, so that each document ends as one root.

A run that lies inside the words of a nonterminal, but in neither child, crosses the
border of the two.  These are looked for once for each nonterminal, whatever its number
of occurrences: a run of four periods has two of them on one side of the border, so it
shows as a square there and is extended from it.  Equality of stretches is told by
prefix sums of a random hash and confirmed word by word; a wrong one brings a new hash.
Runs then go down the derivation to every position of their nonterminal, and stretches
of one period that share a period are united.  All this takes n log n for n words, on
any text, and is done for some hundred documents at once with numpy.

Documents are independent: no shuffle, no state, a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.base import free_name

SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
PRIME = (1 << 31) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Nonterminals of a batch of documents: children, first position, size, and the rounds that made them."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        """``words``: numbers 0, 1, ... that two documents never share; ``doc``: the document of each, ascending."""
        self.terminals = int(words.max()) + 1 if len(words) else 0
        room = self.terminals + len(words)
        self.left, self.right, self.first = (np.zeros(room, np.int64) for _ in range(3))
        self.size = np.ones(room, np.int64)
        self.top, self.rounds = self.terminals, []
        self._complete(*self._repair(words.astype(np.int64), np.arange(len(words)), doc))

    def _add(self, left, right, first) -> np.ndarray:
        new = np.arange(self.top, self.top + len(left))
        self.rounds.append((self.top, self.top + len(left)))
        self.left[new], self.right[new], self.first[new] = left, right, first
        self.size[new] = self.size[left] + self.size[right]
        self.top += len(left)
        return new

    def _repair(self, sym, at, doc):
        """Replace pairs until none occurs twice in a document; documents leave as they are finished."""
        done, salt = [], 0
        while len(sym):
            taken, pair = self._chosen(sym, salt)
            salt += 1
            if taken is None:
                break
            if len(taken):
                kinds, start, inverse = np.unique(pair, return_index=True, return_inverse=True)
                new = self._add(kinds >> 32, kinds & 0xFFFFFFFF, at[taken[start]])
                sym[taken] = new[inverse]
                active = np.zeros(int(doc[-1]) + 1, bool)
                active[doc[taken]] = True
                left = np.ones(len(sym), bool)
                left[taken + 1] = False
                sym, at, doc = sym[left], at[left], doc[left]
                live = active[doc]
                if not live.all():
                    done.append((sym[~live], at[~live], doc[~live]))
                    sym, at, doc = sym[live], at[live], doc[live]
        done.append((sym, at, doc))
        sym, at, doc = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        return sym[order], at[order], doc[order]

    @staticmethod
    def _chosen(sym, salt):
        """Positions of the pairs to replace in this round, and the pairs; None where no pair occurs twice.

        A position is taken where its pair occurs more often than the pairs that touch it.
        """
        pair = (sym[:-1] << 32) | sym[1:]
        usable = np.ones(len(pair), bool)
        same = sym[:-1] == sym[1:]
        if same.any():  # in a a a only every second pair counts
            i = np.arange(len(pair))
            begins = same & ~np.concatenate([[False], same[:-1]])
            usable &= ~(same & (((i - np.maximum.accumulate(np.where(begins, i, 0))) & 1) == 1))
        mixed = (pair.view(np.uint64) + np.uint64(salt)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        slot = (mixed >> np.uint64(64 - max(4, (4 * len(pair)).bit_length()))).astype(np.int64)
        idx = np.flatnonzero(usable & (np.bincount(slot[usable], minlength=1)[slot] > 1)) if len(pair) else np.empty(0, np.int64)
        if not len(idx):
            return None, None
        kinds, inverse, count = np.unique(pair[idx], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if not twice.any():
            return None, None
        idx, inverse = idx[twice], inverse[twice]
        rank = (count[inverse] << 31) | (mixed[idx] >> np.uint64(33)).astype(np.int64)
        around = np.zeros(len(pair) + 2, np.int64)
        around[idx + 1] = rank
        won = (rank > around[idx]) & (rank >= around[idx + 2])
        idx, inverse = idx[won], inverse[won]
        enough = np.bincount(inverse, minlength=len(kinds))[inverse] > 1
        return idx[enough], pair[idx[enough]]

    def _complete(self, sym, at, doc):
        """Join what is left two by two, to one root a document."""
        while len(sym):
            begins = np.concatenate([[True], doc[1:] != doc[:-1]])
            i = np.arange(len(sym))
            even = ((i - np.maximum.accumulate(np.where(begins, i, 0))) & 1) == 0
            pairs = np.flatnonzero(even[:-1] & ~begins[1:])
            if not len(pairs):
                break
            sym[pairs] = self._add(sym[pairs], sym[pairs + 1], at[pairs])
            keep = np.ones(len(sym), bool)
            keep[pairs + 1] = False
            sym, at, doc = sym[keep], at[keep], doc[keep]
        self.roots, self.starts = sym, at


class _Stretches:
    """Whether two stretches of words are equal, by a random hash."""

    def __init__(self, words: np.ndarray, kinds: int, seed: int):
        rng = np.random.default_rng(seed)
        power = np.ones(len(words) + 1, np.int64)
        base, n = int(rng.integers(1 << 20, PRIME)), 1
        while n < len(power):
            step = min(n, len(power) - n)
            power[n : n + step] = power[:step] * pow(base, n, PRIME) % PRIME
            n += step
        value = rng.integers(1, PRIME, kinds)[words] if len(words) else np.empty(0, np.int64)
        self.power, self.sums = power, np.concatenate([[0], np.cumsum(value * power[:-1] % PRIME)])

    def equal(self, i, q, n):
        """Whether the n words from i on are those from i + q on."""
        s = self.sums
        return (s[i + n] - s[i]) % PRIME * self.power[q] % PRIME == (s[i + q + n] - s[i + q]) % PRIME

    def common(self, i, q, most, back=False):
        """The number of words, at most ``most``, that agree from i and i + q on (``back``: before them)."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) >> 1, low)
            good = self.equal(i - mid if back else i, q, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def crossing_runs(words: np.ndarray, g: Grammar, seed: int, block: int = 1 << 20):
    """(nonterminal, start, end, period) of the runs that cross the border of each nonterminal, at its first position.

    None where the hash called different stretches equal.
    """
    h = _Stretches(words, g.terminals, seed)
    ids = np.arange(g.terminals, g.top)
    ids = ids[g.size[ids] >= 6]
    border, begin = g.first[ids] + g.size[g.left[ids]], g.first[ids]
    end = begin + g.size[ids]
    found = []
    for right in (True, False):  # two periods right of the border, or left of it
        most = np.minimum((end - border if right else border - begin) // 2, g.size[ids] // 4)
        upto = np.cumsum(most)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + block, "right")))
            n = most[lo:hi]
            k = np.repeat(np.arange(lo, hi), n)
            q = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + 1
            b = border[k]
            near = words[b] == words[b + q] if right else words[b - 1] == words[b - 1 - q]
            k, q, b = k[near], q[near], b[near]
            near = h.equal(b if right else b - 2 * q, q, q)
            k, q, b = k[near], q[near], b[near]
            if right:
                s, e = b - h.common(b, q, b - begin[k], back=True), b + q + h.common(b, q, end[k] - b - q)
            else:
                s, e = b - q - h.common(b - q, q, b - q - begin[k], back=True), b + h.common(b - q, q, end[k] - b)
            long = (s < b) & (b < e) & (e - s >= np.maximum(6, 4 * q))
            found.append(np.stack([ids[k[long]], s[long], e[long], q[long]]))
            lo = hi
    x, s, e, q = np.concatenate(found, 1) if found else np.empty((4, 0), np.int64)
    order = np.lexsort([q, e, s, x])
    x, s, e, q = x[order], s[order], e[order], q[order]
    least = np.ones(len(x), bool)  # one stretch with several periods: they are multiples of the least
    least[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    x, s, e, q = x[least], s[least], e[least], q[least]
    for a, b, p in zip(s.tolist(), e.tolist(), q.tolist()):
        if not np.array_equal(words[a : b - p], words[a + p : b]):
            return None
    return x, s, e, q


def all_positions(g: Grammar, x, s, e, q):
    """(start, end, period) of each run at every position of its nonterminal in the derivation."""
    holds = np.zeros(g.top, bool)
    holds[x] = True
    for lo, hi in g.rounds:
        holds[lo:hi] |= holds[g.left[lo:hi]] | holds[g.right[lo:hi]]
    first, last = np.searchsorted(x, np.arange(g.top)), np.searchsorted(x, np.arange(g.top), "right")
    sym, at, out = g.roots, g.starts, [np.empty((3, 0), np.int64)]
    while True:
        live = holds[sym]
        sym, at = sym[live], at[live]
        if not len(sym):
            return np.concatenate(out, 1)
        n = last[sym] - first[sym]
        k = np.repeat(np.arange(len(sym)), n)
        r = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[sym[k]]
        move = at[k] - g.first[sym[k]]
        out.append(np.stack([s[r] + move, e[r] + move, q[r]]))
        inner = sym >= g.terminals
        sym, at = sym[inner], at[inner]
        sym, at = np.concatenate([g.left[sym], g.right[sym]]), np.concatenate([at, at + g.size[g.left[sym]]])


def united(s, e, q):
    """Maximal stretches: those of one period that share at least a period become one; sorted by start, then period."""
    if not len(s):
        return s, e, q
    order = np.lexsort([s, q])
    s, e, q = s[order], e[order], q[order]
    base = int(e.max()) + 1
    reach = np.maximum.accumulate(q * base + e) - q * base  # periods ascend, so the maximum stays inside one
    begins = np.ones(len(s), bool)
    begins[1:] = (q[1:] != q[:-1]) | (reach[:-1] - s[1:] < q[1:])
    i = np.flatnonzero(begins)
    s, e, q = s[i], reach[np.append(i[1:], len(reach)) - 1], q[i]
    order = np.lexsort([q, s])
    return s[order], e[order], q[order]


def runs_of(words: np.ndarray, doc: np.ndarray):
    """(start, end, period) of all runs of a batch, in positions of the batch."""
    if not len(words):
        return (np.empty(0, np.int64),) * 3
    g = Grammar(words, doc)
    seed = 1
    while (crossing := crossing_runs(words, g, seed)) is None:
        seed += 1
    return united(*all_positions(g, *crossing))


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as fractions; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (d := r[1] * best[2] - best[1] * r[2]) > 0 or d == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def _batch(texts: list[bytes]) -> list[tuple]:
    """n_words, runs, best and collapsed text of each text."""
    split = [t.split() for t in texts]  # bytes are split at exactly the six characters \\x20 and \\x09-\\x0D
    numbers, total = [], 0
    for ws in split:
        known = {w: i for i, w in enumerate(dict.fromkeys(ws), total)}
        numbers.append(np.array(list(map(known.__getitem__, ws)), np.int64))
        total += len(known)
    sizes = np.array([len(ws) for ws in split], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    s, e, q = runs_of(words, np.repeat(np.arange(len(texts)), sizes))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, s + q, 1)
    np.add.at(step, e, -1)
    kept = np.cumsum(step)[:-1] == 0
    of = np.searchsorted(begin, s, "right") - 1
    runs: dict[int, list] = {}
    for d, a, b, p in zip(of.tolist(), s.tolist(), e.tolist(), q.tolist()):
        runs.setdefault(d, []).append((a - int(begin[d]), b - a, p))
    out = []
    for d, ws in enumerate(split):
        mine = runs.get(d, [])
        if mine:
            ws = [ws[i] for i in np.flatnonzero(kept[begin[d] : begin[d + 1]])]
        out.append((int(sizes[d]), mine, _best(mine), b" ".join(ws)))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", block: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` with n_words, runs, best and collapsed.

    Words are the stretches without white space (space, \\t, \\n, \\v, \\f, \\r), numbered from 0.
    ``runs`` holds each maximal stretch whose smallest period is q and whose length is at least
    6 and 4 * q, by start, then period; ``best`` the run of greatest length / period (null: no
    run); ``collapsed`` the words that stand in no run after its first q words, joined by spaces.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Rows are kept one to
    one, repeats included, with all their columns; should ``docs`` have columns named like the new
    ones, the new ones get underscores in front.  An empty table gives an empty one.  A text may
    have any length: about ``block`` bytes of texts, at least one text, are worked on at a time.
    """
    names = free_name(docs, "n_words", "runs", "best", "collapsed")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_run = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lo = size = 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size < block and hi < len(texts):
                    continue
                n, runs, best, collapsed = zip(*_batch(texts[lo:hi]))
                new = [
                    pa.array(n, pa.int64()),
                    pa.array([[as_run(r) for r in x] for x in runs], pa.list_(run_type)),
                    pa.array([as_run(x) for x in best], run_type),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns[:-1] + new, names=[*batch.schema.names[:-1], *names])
                lo, size = hi, 0

    (raw,) = free_name(docs, "raw")
    others = [c for c in docs.columns if c != text]
    fields = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"`{n}` {f.split(' ', 1)[1]}" for n, f in zip(names, SCHEMA.split(", "))])
    return docs.select(*others, F.col(text).cast("string").cast("binary").alias(raw)).mapInArrow(work, fields)


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a stretch of its words repeated to the end, for the documents whose hash ends in 0.

    With h the unsigned CRC-32 of the decimal doc_id and g = h div 10: if h % 10 = 0, each word
    i >= a becomes word a + (i - a) % p of the text, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    The words of such texts are joined by single spaces; all other texts stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def rewritten(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        moved = F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    once = F.element_at(F.transform(F.array(words), rewritten), 1)  # so that the words are cut once
    return F.when(h % 10 == 0, once).otherwise(text)
