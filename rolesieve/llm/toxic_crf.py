"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Sequences are the lines of a text, whole, tags are toxic and other.  A token's emission is
the sum of the weights of its word, its prefixes, its suffix and its shape (hashed), of
whether it repeats the word before it, and of its neighbouring words; transitions link
neighbouring tags.  Tokens are labelled from the document labels: in a toxic training
document, those with a word, prefix, shape or repetition far more frequent in toxic than in
other training documents.  The model and the document regression over its marginals are
fitted on a bounded sample of labelled rows (``sample``, the smallest by a hash of doc_id);
every text is scored whole.

Long lines are laid out in rows of ``ROW`` tokens; what a row passes on to the next is a
product of 2 x 2 matrices, so the marginals are those of the whole line.

Null and empty texts have no tokens; their score is that of a document without toxic mass.
Every row is scored, whatever its doc_id; an empty table gives no rows; further columns
are ignored.  A doc_id with labels of both kinds teaches nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.jaccard_forest import mix, shingle_set

TOKEN = re.compile(r"\w+|\n")
#: Of every emission: tokens are mostly not toxic.
BASE = -3.0
#: Tokens in a row of the layout.
ROW = 64


def shape(token: str, low: str) -> str:
    """^ for a token all in capitals, ^~ for capitals inside, nothing for other tokens."""
    if token[1:] == low[1:]:
        return ""
    return "^" if token.isupper() else "^~"


def parts(token: str) -> list[str]:
    """The word, its prefixes and its shape, by which tokens are labelled and weighed."""
    low = token.lower()
    out = ["=" + low, *(low[:k] for k in range(4, min(9, len(low))))]
    form = shape(token, low)
    return [*out, form] if form else out


#: The part of a token that repeats the one before it.
REPEATS = "="

_crc = zlib.crc32
_WORD, _SUFFIX, _BEFORE, _AFTER = (_crc(x) for x in (b"=", b"-", b"<", b">"))


def own_features(low: str, raw: bytes, form: str) -> list[int]:
    """Hashes of a lower-case word (``raw``: its bytes): the word, its suffix, its prefixes, its shape."""
    out = [_crc(raw, _WORD), _crc(low[-3:].encode(), _SUFFIX)]
    if len(low) > 4:
        h = _crc(low[:4].encode())
        out.append(h)
        for c in low[4 : min(8, len(low) - 1)]:  # a longer prefix continues the hash of the shorter
            h = _crc(c.encode(), h)
            out.append(h)
    if form:
        out.append(_crc(form.encode()))
    return out


@dataclass
class Lexicon:
    """Numbers of tokens and what they weigh, learnt as texts come; cleared when it holds ``most``."""

    keys: np.ndarray  # sorted hashes of the features that training has seen
    weights: np.ndarray
    most: int = 100_000

    def __post_init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"\n": 0}
        self.folds: dict[str, int] = {}
        self.fold = np.zeros(1 << 17, np.int32)  # number of the lower-case word
        self.weight = np.zeros((3, 1 << 17), np.float32)  # own, as the word before, as the word after

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.clear()
        get = self.number.get
        at = list(map(get, words))
        if None in at:
            self.learn([words[i] for i, k in enumerate(at) if k is None])
            at = list(map(get, words))
        return np.array(at, np.int32)

    def learn(self, words: list[str]) -> None:
        first, number, folds = len(self.number), self.number, self.folds
        feats, size, fold, before, after = [], [], [], [], []
        for w in words:
            if w in number:
                continue
            number[w] = len(number)
            low = w.lower()
            raw = low.encode()
            f = own_features(low, raw, shape(w, low))
            feats += f
            size.append(len(f))
            fold.append(folds.setdefault(low, len(folds)))
            before.append(_crc(raw, _BEFORE))
            after.append(_crc(raw, _AFTER))
        last = len(number)
        while last > len(self.fold):
            self.fold = np.concatenate([self.fold, np.zeros_like(self.fold)])
            self.weight = np.concatenate([self.weight, np.zeros_like(self.weight)], 1)
        self.fold[first:last] = fold
        self.weight[0, first:last] = np.add.reduceat(self.of(feats), np.cumsum([0, *size[:-1]]))
        self.weight[1, first:last], self.weight[2, first:last] = self.of(before), self.of(after)

    def of(self, hashes: list[int]) -> np.ndarray:
        """Weights of features; nothing for those that training has not seen."""
        h = np.array(hashes, np.uint32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], np.float32(0))


@dataclass
class Sequences:
    """Token emissions of many texts laid out as a matrix; a sequence is one row or several in turn."""

    token_row: np.ndarray  # of each token
    token_col: np.ndarray
    length: np.ndarray  # of each row
    goes_on: np.ndarray  # whether a row is followed by the next in its sequence

    @staticmethod
    def of(breaks: np.ndarray) -> Sequences:
        """``breaks``: for each token, whether a sequence starts with it."""
        n = len(breaks)
        start = np.flatnonzero(breaks)
        line = np.cumsum(breaks) - 1
        col = np.arange(n) - start[line] if n else np.zeros(0, int)
        more = (col % ROW == 0) & (col > 0)
        row = np.cumsum(breaks | more) - 1
        length = np.bincount(row, minlength=row[-1] + 1 if n else 0)
        goes_on = np.zeros(len(length), bool)
        goes_on[row[more] - 1] = True
        return Sequences(row, col % ROW, length, goes_on)

    def passed_on(self, e: np.ndarray, place: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row (in layout order) the odds that reach it from the row before and the row after; nan at the ends."""
        t, n = e.shape
        ahead, back = np.full(n, np.nan), np.full(n, np.nan)
        whole = np.flatnonzero(self.goes_on)
        if not len(whole):
            return ahead, back
        inside = np.unique(np.concatenate([whole, whole + 1]))
        length, more = self.length[inside], self.goes_on[inside]
        start = np.r_[True, ~more[:-1]]
        grow, w = e[:, place[inside]], np.exp(trans)
        # each row as one step, from the tag before it to that of its last token; no tag stands before a line
        one = np.zeros((len(inside), 2, 2))
        one[:, 0, 0] = one[:, 1, 1] = 1
        one[start] = np.stack([np.ones((start.sum(), 2)), np.repeat(grow[0, start][:, None], 2, 1)], 2)
        for k in range(t):
            at = np.flatnonzero((length > k) & ~(start & (k == 0)))
            if len(at):
                new = one[at, :, :1] * w[0] + one[at, :, 1:] * w[1]
                new[:, :, 1] *= grow[k, at][:, None]
                one[at] = new / new.max((1, 2), keepdims=True)
        depth = np.arange(len(inside)) - np.maximum.accumulate(np.where(start, np.arange(len(inside)), 0))
        after = one[:, 0, :].copy()  # of the rows that start a line: weights of the tags at their ends
        upto = np.ones((len(inside), 2))  # weights of the tags before the row
        by_depth = [np.flatnonzero(depth == k) for k in range(depth.max() + 1)]
        for at in by_depth[1:]:
            ahead[place[inside[at]]] = after[at - 1, 1] / after[at - 1, 0]
            v = (after[at - 1][:, :, None] * one[at]).sum(1)
            after[at] = v / v.max(1, keepdims=True)
        for at in by_depth[:0:-1]:
            last = np.where(more[at][:, None], upto[np.minimum(at + 1, len(inside) - 1)], 1.0)
            u = (one[at] * last[:, None, :]).sum(2)
            upto[at] = u / u.max(1, keepdims=True)
            back[place[inside[at - 1]]] = upto[at, 1] / upto[at, 0]
        return ahead, back

    def marginals(self, emission: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """P(toxic) of each token by forward-backward; with ``pairs`` also the expected transition counts."""
        order = np.argsort(-self.length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        ln = self.length[order]
        n, t = len(order), int(ln[0]) if len(order) else 0
        e = np.ones((t, n))  # odds, not logarithms: a step is then a quotient of two sums, bounded by those of the transitions
        e[self.token_col, place[self.token_row]] = np.exp(np.clip(emission, -30, 30))
        live = np.searchsorted(-ln, -np.arange(t), side="left")  # rows longer than each column
        trans = np.clip(trans - trans.max(), -30, 0)
        w00, w01, w10, w11 = np.exp(trans).ravel()
        fwd, bwd = np.ones((t, n)), np.ones((t, n))
        ahead, back = self.passed_on(e, place, trans)
        if t:
            fwd[0] = e[0]
            on = np.flatnonzero(~np.isnan(ahead))
            fwd[0, on] *= (ahead[on] * w11 + w01) / (ahead[on] * w10 + w00)
            on = np.flatnonzero(~np.isnan(back))
            bwd[ln[on] - 1, on] = back[on]
        for k in range(1, t):
            a = fwd[k - 1, : live[k]]
            fwd[k, : live[k]] = (a * w11 + w01) / (a * w10 + w00) * e[k, : live[k]]
        for k in range(t - 2, -1, -1):
            b = bwd[k + 1, : live[k + 1]] * e[k + 1, : live[k + 1]]
            bwd[k, : live[k + 1]] = (b * w11 + w10) / (b * w01 + w00)
        at = self.token_col, place[self.token_row]
        marg = fwd[at] * bwd[at]
        marg /= 1 + marg
        if not pairs:
            return marg
        counts = np.zeros((2, 2))

        def add(a: np.ndarray, b: np.ndarray) -> None:
            each = np.stack([np.full(len(a), w00), b * w01, a * w10, a * b * w11])
            counts[:] += (each / each.sum(0)).sum(1).reshape(2, 2)

        for k in range(1, t):
            add(fwd[k - 1, : live[k]], bwd[k, : live[k]] * e[k, : live[k]])
        left = np.flatnonzero(self.goes_on)
        if len(left):
            right = place[left + 1]
            add(fwd[self.length[left] - 1, place[left]], bwd[0, right] * e[0, right])
        return marg, counts


def line_starts(ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each token that is no line end starts a line; ``ends`` and ``doc`` are of all tokens."""
    line, doc = np.cumsum(ends)[~ends], doc[~ends]
    return np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]


@dataclass
class ToxicModel:
    keys: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    regression: np.ndarray
    base: float = BASE

    def __post_init__(self):
        self.lexicon = Lexicon(self.keys, self.weights)
        self.repeats = float(self.lexicon.of([_crc(REPEATS.encode())])[0])

    def fields(self) -> tuple:
        """What makes the model anew in a task; features of next to no weight are left out."""
        told = np.abs(self.weights) >= 0.02
        told[:1] = True
        return self.keys[told], self.weights[told].astype(np.float32), self.trans, self.regression, self.base

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each token, number of the token in its text, P(toxic)); line ends are no tokens."""
        words: list[str] = []
        size = []
        for t in texts:
            found = TOKEN.findall(t)
            words += found
            size.append(len(found))
        at = self.lexicon.numbers(words)
        del words
        doc = np.repeat(np.arange(len(texts)), size)
        starts = line_starts(at == 0, doc)
        doc, at = doc[at > 0], at[at > 0]
        if not len(at):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        fold, (own, before, after) = self.lexicon.fold[at], self.lexicon.weight[:, at].astype(float)
        follows = np.flatnonzero(~starts[1:]) + 1
        em = own + self.base
        em[follows] += before[follows - 1] + self.repeats * (fold[follows] == fold[follows - 1])
        em[follows - 1] += after[follows]
        p = Sequences.of(starts).marginals(em, self.trans)
        first = np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1]
        nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
        return doc, nth, p

    def summary(self, texts: list[str], tagged=None) -> np.ndarray:
        """One row of regression inputs a document, from the marginals alone."""
        doc, _, p = tagged or self.tag(texts)
        n = len(texts)
        tokens = np.bincount(doc, minlength=n).astype(float)
        mass = np.bincount(doc, weights=p, minlength=n)
        sure = np.bincount(doc, weights=p > 0.5, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, doc, p)
        return np.stack([np.ones(n), np.log1p(mass), np.log1p(sure), np.log((mass + 0.2) / (tokens + 10)), np.log((sure + 0.2) / (tokens + 10)), top, np.log1p(np.minimum(sure, 6)) * np.log((sure + 0.2) / (tokens + 10))], axis=1)

    def score(self, texts: list[str], tagged=None) -> np.ndarray:
        return 1 / (1 + np.exp(-self.summary(texts, tagged) @ self.regression))


def label_parts(sets: list[set[str]], toxic: np.ndarray, least: int = 3, odds: float = 2.5) -> set[str]:
    """Parts far more frequent in toxic documents than in the others."""
    inside, outside = Counter(), Counter()
    for each, y in zip(sets, toxic):
        if y:
            inside.update(each)
    inside = Counter({x: c for x, c in inside.items() if c >= least})
    for each, y in zip(sets, toxic):
        if not y:
            outside.update(each & inside.keys())
    ratio = (toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1)
    expected = {x: ratio * (outside[x] + 0.5) for x in inside}  # were it as frequent there as in the others
    return {x for x, c in inside.items() if np.log(c / expected[x]) > odds and c - expected[x] > 4 * (expected[x] + 1) ** 0.5}


def copies_once(texts: list[str], toxic: np.ndarray) -> list[int]:
    """Places of the texts without copies of one another within a label, which would make hints of chance words.

    A copy has one of three minima over the 5-word runs in common with a text before it; of
    similarity 0.8 it goes unseen once in 125.
    """
    seen: set = set()
    out = []
    for i, (t, y) in enumerate(zip(texts, toxic)):
        runs = shingle_set(t)
        keys = {(bool(y), k, int(h.min())) for k, h in enumerate((runs, ~runs, mix(runs ^ np.uint64(1))))} if len(runs) else {(bool(y), -1, 0)}
        if seen.isdisjoint(keys):
            out.append(i)
        seen |= keys
    return out


def fit_field(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.5) -> ToxicModel | None:
    """The field alone; None where no token tells toxic documents from others."""
    vocab: dict[str, int] = {"\n": 0}
    found = []
    for text in texts:  # one at a time, so that only numbers of tokens add up
        words = TOKEN.findall(text)
        found.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in found])
    ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    starts = line_starts(ids == 0, doc)
    doc, ids = doc[ids > 0], ids[ids > 0] - 1
    names = list(vocab)[1:]
    lower: dict[str, int] = {}
    folded = np.array([lower.setdefault(w.lower(), len(lower)) for w in names] or [0], np.int32)[ids]
    again = np.r_[False, folded[1:] == folded[:-1]][: len(ids)] & ~starts
    del found, lower, folded
    of = [frozenset(parts(w)) for w in names]
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = [set().union(*(of[i] for i in np.unique(ids[a:b]))) | ({REPEATS} if again[a:b].any() else set()) for a, b in zip(edge[:-1], edge[1:])]
    hints = label_parts(sets, toxic)
    del sets
    hinted = np.array([not hints.isdisjoint(x) for x in of] or [False])
    if not len(ids) or not (hinted.any() or REPEATS in hints):
        return None
    gold = toxic[doc] & (hinted[ids] | (again & (REPEATS in hints)))
    del doc, of
    seq = Sequences.of(starts)
    follows = np.flatnonzero(~starts[1:])
    seen = np.bincount(2 * gold[follows] + gold[follows + 1], minlength=4).reshape(2, 2)
    lows = [w.lower() for w in names]
    feats = [own_features(low, low.encode(), shape(w, low)) for w, low in zip(names, lows)]
    owner = np.repeat(np.arange(len(feats), dtype=np.int32), [len(f) for f in feats])
    every = [np.fromiter((h for f in feats for h in f), np.uint32, len(owner)), *(np.array([_crc(low.encode(), mark) for low in lows], np.uint32) for mark in (_BEFORE, _AFTER)), np.array([_crc(REPEATS.encode())], np.uint32)]
    del feats, vocab, names, lows
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    flat, before, after, repeats = np.split(at.astype(np.int32), np.cumsum([len(x) for x in every[:-1]]))
    repeats = int(repeats[0])
    del every, at
    n, weights, trans = len(keys), np.zeros(len(keys)), np.zeros((2, 2))
    decay = np.full(n, 0.01)
    decay[before] = decay[after] = 20.0  # a toxic word has chance neighbours
    decay[flat] = 0.01
    n_words = len(hinted)
    g2, t2 = np.full(n, 1e-6), np.full((2, 2), 1e-6)
    here, there = ids[follows], ids[follows + 1]
    for _ in range(rounds):
        per_word = np.bincount(owner, weights=weights[flat], minlength=n_words) + BASE
        em = per_word[ids] + weights[repeats] * again
        em[follows + 1] += weights[before][here]
        em[follows] += weights[after][there]
        p, pairs = seq.marginals(em, trans, pairs=True)
        miss = gold - p
        grad = np.bincount(flat, weights=np.bincount(ids, weights=miss, minlength=n_words)[owner], minlength=n)
        grad += np.bincount(before, weights=np.bincount(here, weights=miss[follows + 1], minlength=n_words), minlength=n)
        grad += np.bincount(after, weights=np.bincount(there, weights=miss[follows], minlength=n_words), minlength=n)
        grad[repeats] += miss[again].sum()
        grad -= decay * weights
        tgrad = seen - pairs - 0.01 * trans
        g2 += grad**2
        t2 += tgrad**2
        weights += rate * grad / np.sqrt(g2)
        trans += 0.3 * rate * tgrad / np.sqrt(t2)
    return ToxicModel(keys, weights.astype(np.float32), trans, np.zeros(7))


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, aside: int = 4) -> ToxicModel:
    """Train the field on tokens labelled from the documents, then the document regression.

    The regression is fitted on every ``aside``-th text, which the field has not seen, so that it
    knows what chance hits look like.  ``share``: the part of toxic rows among all labelled
    ones, where ``texts`` has another.
    """
    toxic = np.asarray(toxic).astype(bool)
    one = copies_once(texts, toxic)
    texts, toxic = [texts[i] for i in one], toxic[one]
    unseen = np.zeros(len(texts), bool)
    for y in (False, True):
        unseen[np.flatnonzero(toxic == y)[aside - 1 :: aside]] = True
    if unseen[toxic].sum() < 20:  # too few to spare
        unseen[:] = False
    seen = [t for t, u in zip(texts, unseen) if not u]
    model = fit_field(seen, toxic[~unseen])
    if model is None:
        share = toxic.mean() if share is None and len(toxic) else share or 0.0
        model = ToxicModel(np.zeros(1, np.uint32), np.zeros(1, np.float32), np.zeros((2, 2)), np.zeros(7))
        model.regression[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    if unseen.any():
        texts, toxic = [t for t, u in zip(texts, unseen) if u], toxic[unseen]
    x, y = model.summary(texts), toxic.astype(float)
    weight = np.ones(len(y))
    if share is not None and 0 < share < 1 and 0 < y.sum() < len(y):
        weight = np.where(toxic, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * beta)
    model.regression = beta
    return model



def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, test: int, sample: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` rows of class 0 and 1 outside the test fold, the first by a hash.

    A row with doc_id d is in the test fold if crc32(d as text) mod ``fold`` is ``test``;
    null labels and doc_ids, and texts that are null, teach nothing.
    """
    seen = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != test)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    seen = seen.withColumn("at", F.xxhash64("doc_id"))
    picked = [seen.where(F.col("label") == y).orderBy("at", "doc_id").limit(sample[y]).select("doc_id", "label") for y in (0, 1)]
    return texts_of(docs, picked[0].unionAll(picked[1]))


def texts_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """Texts of a bounded set of rows: their ids go to the texts, not the texts to the ids."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return rows.join(F.broadcast(few), "doc_id").orderBy("doc_id")


def train(docs: DataFrame, labels: DataFrame, fold: int = 4, test: int = 2, sample: tuple[int, int] = (2000, 800)) -> ToxicModel:
    """Fit on at most ``sample`` labelled rows of class 0 and 1 outside the test fold."""
    rows = labelled_sample(docs, labels, "toxic", fold, test, sample).select("text", "label").toPandas()
    outside = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != test))
    share = outside.agg(F.avg("toxic")).first()[0]
    return fit(rows["text"].tolist(), rows["label"].to_numpy(), share)


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """Score each row's whole text and name its offending offsets.

    Returns doc_id, score, predicted, n_spans and spans array<struct<start,end,score>>
    (code points of the text; tokens whose marginal passes 1/2, neighbours joined).
    One row for each input row, whatever its doc_id.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(model.fields())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ToxicModel(*weights.value)
        for pdf in batches:
            for part in sliced(pdf):
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                tagged = m.tag(texts)
                spans: list[list] = [[] for _ in texts]
                doc, nth, p = tagged
                hot = np.flatnonzero(p > 0.5)
                for d in np.unique(doc[hot]):
                    at = [x.span() for x in TOKEN.finditer(texts[d]) if x[0] != "\n"]  # the scan that made the tokens
                    for i in hot[doc[hot] == d]:
                        k = int(nth[i])
                        (a, b), q = at[k], float(p[i])
                        if spans[d] and spans[d][-1]["nth"] == k - 1:
                            spans[d][-1].update(end=b, nth=k, score=max(q, spans[d][-1]["score"]))
                        else:
                            spans[d].append({"start": a, "end": b, "score": q, "nth": k})
                score = m.score(texts, tagged)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": score, "predicted": (score >= threshold).astype(int), "n_spans": [len(s) for s in spans], "spans": [[{k: v for k, v in x.items() if k != "nth"} for x in s] for s in spans]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int, n_spans long, spans array<struct<start:long,end:long,score:double>>")


def cuts(lengths: list[int], most: int = 500, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows, from one place to another, of at most ``most`` rows and, but for single longer ones, ``size`` characters of text."""
    lo = 0
    while lo < len(lengths):
        hi, total = lo, 0
        while hi < len(lengths) and hi - lo < most and (hi == lo or total + lengths[hi] <= size):
            total += lengths[hi]
            hi += 1
        yield lo, hi
        lo = hi


def sliced(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo, hi in cuts([len(t) if isinstance(t, str) else 0 for t in pdf["text"]]):
        yield pdf.iloc[lo:hi]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows and their texts (null: empty); only those of one run are Python strings at a time."""
    for lo, hi in cuts(pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()):
        part = batch.slice(lo, hi - lo)
        yield part, [t or "" for t in part["text"].to_pylist()]


def passing(batches: Iterator[pa.RecordBatch], score, passes) -> Iterator[pa.RecordBatch]:
    """The rows, with all their columns, whose texts pass; ``score(texts)`` is called run by run."""
    for batch in batches:
        for part, texts in slices(batch):
            yield part.filter(pa.array(passes(score(texts))))


def accepted(docs: DataFrame, score, passes) -> DataFrame:
    """The rows of ``docs`` that are ``passing``; ``score()`` makes the scorer of a task."""
    return docs.mapInArrow(lambda batches: passing(batches, score(), passes), docs.schema)


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.3) -> DataFrame:
    """Documents that score below ``threshold``, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model.fields())
    return accepted(docs, lambda: ToxicModel(*sent.value).score, lambda s: s < threshold)
