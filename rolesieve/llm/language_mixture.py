"""The languages of a document, as a mixture.

A language is a model of the characters of a word, each given the three before it; the
orders are smoothed into one another.  A document is a bag of words, each of which comes
from one of its languages, with a share for each language.  The shares are estimated by
expectation-maximisation: words are given to languages by share times likelihood, and the
shares become what each language was given.  All learned languages start with equal
shares; then the languages are ranked by share and the set of the first 1, 2, ... is taken
whose log likelihood, less ``penalty`` * log(words) for each language beyond the first, is
greatest.  The language of the greatest share in that set is the prediction.

Counts are taken over all training documents, by tasks for themselves and then added up;
n-grams go to a table of 2 ** bits slots a language, so the model has a fixed size (4 bytes
a slot and language) that every task may hold.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = 4
_START, _END = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> Counter:
    """The words of a text in lower case and how often each stands there; a word may hold signs that are no letters (``letters``)."""
    return Counter(LETTERS.findall(text.lower()))


def letters(word: str) -> str:
    """``word`` without such signs (superscripts, fractions) as the pattern takes for letters."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class _Grams:
    """Slots of the character n-grams that end at each place of some words, start and end marked."""

    def __init__(self, words: list[str], bits: int):
        code = np.frombuffer("".join(f"{_START}{w}{_END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        self.begin = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(code)) - self.begin[self.word]
        self.slots, h = [], np.zeros(len(code), np.uint64)
        for n in range(ORDERS):
            before = np.concatenate([[np.uint64(0)], h[:-1]])  # where n > place the hash runs over a border; such places are not used
            h = (before * _MIX + code + np.uint64(n + 1)) * _MIX
            h ^= h >> np.uint64(31)
            self.slots.append(((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64))


@dataclass
class Mixture:
    """``counts`` (slots x languages) and ``totals`` (characters and word ends) of the learned ``languages``."""

    languages: list[str]
    counts: np.ndarray
    totals: np.ndarray
    bits: int
    smoothing: float = 4.0
    penalty: float = 1.5
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihood (words x languages) of each word; 0 for a word without letters."""
        words = [letters(w) for w in words]
        g, k = _Grams(words, self.bits), self.smoothing
        p = np.full((len(g.word), len(self.languages)), 1e-3)
        seen = self.totals[None, :]
        for n, slots in enumerate(g.slots):
            count = self.counts[slots].astype(np.float64)
            valid = (g.place >= n)[:, None]
            p = np.where(valid, (np.minimum(count, seen) + k * p) / (seen + k), p)
            seen = np.concatenate([self.totals[None, :], count[:-1]])  # a context is the n-gram that ends one place before
        logs = np.log(p)
        logs[g.place == 0] = 0
        out = np.add.reduceat(logs, g.begin, axis=0) if len(words) else np.zeros((0, len(self.languages)))
        out[[not w for w in words]] = 0
        return out


def _count_batch(words: Counter, bits: int) -> tuple[np.ndarray, int]:
    kinds = [(w, n) for x, n in words.items() if (w := letters(x))]
    out = np.zeros(1 << bits)
    if not kinds:
        return out, 0
    g = _Grams([w for w, _ in kinds], bits)
    times = np.array([n for _, n in kinds], np.float64)[g.word]
    for n, slots in enumerate(g.slots):
        out += np.bincount(slots[g.place >= n], times[g.place >= n], minlength=1 << bits)
    return out, int(times[g.place > 0].sum())


def train(docs: DataFrame, bits: int = 18, **choices) -> Mixture:
    """Learn the languages of ``docs`` (text, lang) from all its rows; rows without text or lang say nothing.

    What comes to the driver is the model: 4 * 2 ** bits bytes a language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle():
            for lang, words in held.items():
                grams, total = _count_batch(words, bits)
                grams = np.append(grams, total)
                sums[lang] = sums[lang] + grams if lang in sums else grams
            held.clear()

        def rows():
            for lang, grams in sums.items():
                slot = np.flatnonzero(grams)
                yield pd.DataFrame({"lang": lang, "slot": slot, "n": grams[slot]})
            sums.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > 200_000:
                settle()
            if len(sums) > 20:
                yield from rows()
        settle()
        yield from rows()

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << bits) + 1)
        out[pdf["slot"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "grams": [out[:-1].astype(np.float32).tobytes()], "total": [float(out[-1])]})

    labelled = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    summed = labelled.mapInPandas(count, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sorted(r for r in summed.groupBy("lang").applyInPandas(table, "lang string, grams binary, total double").collect() if r["total"])
    counts = np.stack([np.frombuffer(r["grams"], np.float32) for r in rows], 1) if rows else np.zeros((1 << bits, 0), np.float32)
    return Mixture([r["lang"] for r in rows], np.ascontiguousarray(counts), np.array([r["total"] for r in rows], np.float64), bits, **choices)


class _Words:
    """Likelihoods of words that a worker has met, relative to the best language of each."""

    def __init__(self, model: Mixture, most: int = 400_000):
        self.model, self.most = model, most
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most:
            self.at, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            logs = self.model.log_likelihoods(new)
            self.at.update((w, i) for i, w in enumerate(new, len(self.table)))
            self.table = np.concatenate([self.table, np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))])
        return self.table[list(map(self.at.__getitem__, words))]


_words: dict[str, _Words] = {}


def _em(like: np.ndarray, times: np.ndarray, begin: np.ndarray, share: np.ndarray, rounds: int, close: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares after EM and log likelihood, each a document; ``like`` and ``times`` are its words from ``begin`` on."""
    size = np.diff(np.append(begin, len(times)))
    total = np.add.reduceat(times, begin)
    share, loglik = share.copy(), np.zeros(len(begin))
    live, doc = np.arange(len(begin)), np.repeat(np.arange(len(begin)), size)
    for k in range(rounds):
        given = like * share[live][doc]
        whole = given.sum(1)
        starts = np.cumsum(size[live]) - size[live]
        loglik[live] = np.add.reduceat(times * np.log(whole), starts)
        new = np.add.reduceat(given * (times / whole)[:, None], starts, axis=0) / total[live][:, None]
        moved = np.abs(new - share[live]).max(1) > close
        share[live] = new
        if not moved.any():
            break
        if moved.sum() < 0.7 * len(live):  # the rest goes on without those that stand still
            keep = moved[doc]
            like, times, live = like[keep], times[keep], live[moved]
            doc = np.repeat(np.arange(len(live)), size[live])
    return share, loglik


def shares(model: Mixture, like: np.ndarray, times: np.ndarray, begin: np.ndarray, rounds: int = 40, close: float = 1e-3) -> np.ndarray:
    """Shares (documents x languages) of the languages in each document's chosen set, 0 for the others."""
    n_docs, n_langs = len(begin), like.shape[1]
    size, total = np.diff(np.append(begin, len(times))), np.add.reduceat(times, begin)
    full, _ = _em(like, times, begin, np.full((n_docs, n_langs), 1 / n_langs), rounds, close)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best, value = np.zeros_like(full), np.full(n_docs, -np.inf)
    for many in range(1, n_langs + 1):
        # a further language is tried where it was given more than a word's half
        tried = np.flatnonzero((full * (place == many - 1)).sum(1) * total > 0.5) if many > 1 else np.arange(n_docs)
        if not len(tried):
            break
        rows = np.repeat(np.isin(np.arange(n_docs), tried), size)
        start = np.where(place[tried] < many, np.maximum(full[tried], 1e-6), 0)
        start /= start.sum(1, keepdims=True)
        got, loglik = _em(like[rows], times[rows], np.cumsum(size[tried]) - size[tried], start, rounds if many > 1 else 1, close)
        loglik -= model.penalty * (many - 1) * np.log(total[tried] + 1)
        better = loglik > value[tried]
        best[tried[better]], value[tried[better]] = got[better], loglik[better]
    return best


def predict_languages(docs: DataFrame, model: Mixture, block: int = 1 << 20) -> DataFrame:
    """doc_id, lang_pred, score, languages: the mixture of each row's whole ``text``.

    ``languages`` holds the chosen languages with their shares of the words, greatest first;
    ``lang_pred`` is the first of them and ``score`` its share.  Equal shares go by name.  Texts that are
    null, empty or without a letter are ``und`` with score 0 and no languages, and so is
    every text where nothing was learned.  Rows are kept one to one, repeats and null doc_ids
    included; further columns are ignored; an empty table gives an empty one.  Long texts
    are read whole: about ``block`` characters of texts, at least one text, at a time.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def several(known: _Words, texts: list[str]) -> list[list[dict]]:
        names, words, times, size = known.model.languages, [], [], []
        for t in texts:
            c = {w: n for w, n in words_of(t).items() if w.isalpha() or letters(w)} if names else {}
            words += c
            times += c.values()
            size.append(len(c))
        out: list[list[dict]] = [[] for _ in texts]
        size = np.array(size, np.int64)
        filled = np.flatnonzero(size)
        if len(filled):
            found = shares(known.model, known.rows(words), np.array(times, np.float64), (np.cumsum(size) - size)[filled])
            for i, s in zip(filled.tolist(), found):
                out[i] = [{"lang": names[j], "share": min(1.0, float(s[j]))} for j in np.argsort(-s, kind="stable").tolist() if s[j] > 0]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        if model.key not in _words:
            _words.clear()  # one model at a time stays in a worker
            _words[model.key] = _Words(model)
        known = _words[model.key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = size = 0
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size < block and hi < len(texts):
                    continue
                got = several(known, texts[lo:hi])
                first = [x[0] if x else {"lang": "und", "share": 0.0} for x in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([x["lang"] for x in first]), pa.array([x["share"] for x in first]), pa.array(got, kind)],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )
                lo, size = hi, 0

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
