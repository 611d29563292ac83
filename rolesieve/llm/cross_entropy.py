"""Cross-entropy difference between a target and a background language model.

Both are interpolated bigram models over one vocabulary, that of the whole table:

    p(w | h) = weight * c(h w) / c(h) + (1 - weight) * (r * c(w) + add) / (r * N + add * V)

with the counts c and N of the target documents for one and of all other documents for the
other (an unseen h leaves only the second part, with its whole mass).  The two are matched
in size by weight: r is the smaller of the two N over the model's own, so that both are
smoothed as models of one size, and no document is left out of the counts (1 where one of
them has none).  A document never vouches for itself: its own counts are taken off the
model that it belongs to (off N too, while r stays).  Every document counts with a start
and an end mark.  A document's score is the mean over its tokens (end mark included) of
target loss minus background loss, in nats: the lower, the more like the target.

Counts are of 64-bit hashes, whole, and grow with the table.  Batches of documents (a
number of bytes each) send the counts of their distinct words and bigrams to buckets by
hash; a bucket adds them up and answers each batch in the order it asked, so that a gram
however frequent costs one number a batch.  Buckets grow in number with the bytes of the table.  Words are lower-cased and split at ASCII white space.  Null and empty texts have
the end mark alone; a model without documents (no target, no background, or only
the document that is scored) is uniform; an empty table gives no rows; rows that share a
doc_id are scored each (and stand in one batch), each without its own counts alone; a null
doc_id is no target; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.base import batched, buckets_of, materialise
from rolesieve.llm.jaccard_forest import _P, mix, word_hashes

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)


class Grams:
    """Tokens of a batch: contexts, predicted words and their distinct grams."""

    def __init__(self, texts: list[str]):
        words = [word_hashes(t) if t else np.zeros(0, np.uint64) for t in texts]
        size = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(size)
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.word = np.full(int(ends[-1]) if len(ends) else 0, END)
        place = np.ones(len(self.word), bool)
        place[ends - 1] = False
        self.word[place] = np.concatenate(words)
        self.context = np.concatenate([[START], self.word[:-1]])
        self.context[ends[:-1]] = START
        self.of_word, self.of_context, self.of_pair = mix(self.word), mix(self.context), mix(self.context * np.uint64(_P) + self.word + np.uint64(1))
        self.kinds = (np.unique(np.concatenate([self.of_word, mix(np.array([START]))])), np.unique(self.of_pair))

    def counts(self, kind: int, chosen: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct gram in the chosen tokens; the start mark counts once a document."""
        grams = self.kinds[kind]
        out = np.bincount(np.searchsorted(grams, (self.of_pair if kind else self.of_word)[chosen]), minlength=len(grams))
        if not kind:
            out[np.searchsorted(grams, mix(np.array([START]))[0])] += int((self.context[chosen] == START).sum())
        return out

    def own(self, grams: np.ndarray) -> np.ndarray:
        """For each token, how often its gram (a number) stands in its document."""
        _, at, n = np.unique(self.doc * (int(grams.max(initial=0)) + 1) + grams, return_inverse=True, return_counts=True)
        return n[at]


def _asked(grams: np.ndarray, buckets: int):
    """(bucket, places) in the order in which a batch asks and is answered; ``grams`` are sorted."""
    to = (grams >> np.uint64(32)).astype(np.int64) * buckets >> 32
    used, begin = np.unique(to, return_index=True)
    return [(int(b), np.arange(lo, hi)) for b, lo, hi in zip(used, begin, [*begin[1:], len(to)])]


def _steps(grams: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences, in as few bytes each as the largest needs."""
    step = np.diff(grams, prepend=np.uint64(0))
    width = max(1, -(-int(step[1:].max(initial=np.uint64(0))).bit_length() // 8))
    return bytes([width]) + grams[:1].tobytes() + step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _sums(blob: bytes) -> np.ndarray:
    width = blob[0]
    few = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(few) + 1, 8), np.uint8)
    step[0] = np.frombuffer(blob, np.uint8, 8, 1)
    step[1:, :width] = few
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def _pack(counts: np.ndarray) -> bytes:
    """A byte a count, those of 255 and more whole after them, in Huffman codes: most counts are 0 or 1."""
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return code.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()) + code.flush()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    blob = zlib.decompress(blob, -15)
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=n).astype(np.int64)
    return out


def _texts(pdf: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in pdf["text"]]


def gathered(rows: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, kind, background, target) totals in the asked order; rows without a batch sum up a bucket."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            g = Grams(_texts(left))
            wanted = left["doc_id"].isin(right["target_id"]).to_numpy()[g.doc]
            for kind in (0, 1):
                grams = g.kinds[kind]
                both = g.counts(kind, ~wanted), g.counts(kind, wanted)
                out += [(b, kind, int(left["batch"].iloc[0]), _steps(grams[at]), *(_pack(c[at]) for c in both)) for b, at in _asked(grams, buckets)]
        return pd.DataFrame(out, columns=["bucket", "kind", "batch", "numbers", "background", "target"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [_sums(x) for x in pdf["numbers"]]
        ends = np.cumsum([0, *map(len, h)])
        _, at = np.unique(np.concatenate(h), return_inverse=True)
        total = [np.bincount(at, weights=np.concatenate([_unpack(x, len(y)) for x, y in zip(pdf[c], h)])) for c in ("background", "target")]
        out = [(b, *(_pack(t[at[lo:hi]].astype(np.int64)) for t in total)) for b, lo, hi in zip(pdf["batch"], ends[:-1], ends[1:])]
        out = pd.DataFrame(out, columns=["batch", "background", "target"], dtype=object)
        out.insert(1, "bucket", pdf["bucket"].iloc[0])
        out.insert(2, "kind", pdf["kind"].iloc[0])
        sums = pd.DataFrame([(len(total[0]), int(total[0].sum()), int(total[1].sum()))], columns=["distinct", "n_background", "n_target"])
        return pd.concat([out, sums]).assign(bucket=pdf["bucket"].iloc[0], kind=pdf["kind"].iloc[0])

    sent = rows.groupBy("batch").cogroup(target.groupBy("target_batch")).applyInPandas(send, "bucket int, kind int, batch long, numbers binary, background binary, target binary")
    return sent.groupBy("bucket", "kind").applyInPandas(answer, "batch long, bucket int, kind int, background binary, target binary, distinct long, n_background long, n_target long")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, weight: float = 0.7, add: float = 0.1, size: int = 2_000_000) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference; ``target_ids`` has the doc_id of the target documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows that cannot be target documents are dealt by their text
    rows, n, batches = batched(rows, "text", size, F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))
    target = target_ids.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id is not null").distinct()
    target = target.withColumn("target_batch", F.pmod(F.xxhash64("target_id"), F.lit(batches)).cast("long"))
    buckets = buckets_of(spark, 2, batches, size)
    answers = materialise(gathered(rows, target, buckets), "grams")
    sums = answers.where("batch is null and kind = 0").agg(F.sum("distinct"), F.sum("n_background"), F.sum("n_target")).first()
    starts = rows.join(target.select(F.col("target_id").alias("doc_id")), "doc_id", "left_semi").count() if n else 0
    vocabulary = (sums[0] or 1) - 1  # without the start mark
    totals = tuple(float((s or 0) - e) for s, e in zip(sums[1:], (n - starts, starts)))
    matched = tuple(min(totals) / t if min(totals) else 1.0 for t in totals)

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n_tokens", "target_loss", "background_loss"]
        if not len(left):
            return pd.DataFrame({c: [] for c in [*names, "difference"]})
        g = Grams(_texts(left))
        got = {(b, k): (x, y) for b, k, x, y in zip(right["asked_bucket"], right["kind"], right["background"], right["target"])}
        mine = left["doc_id"].isin(right["target_id"].dropna()).to_numpy().astype(int)[g.doc]  # the model of each token's document
        counts = []
        for kind in (0, 1):
            c = np.zeros((2, len(g.kinds[kind])))
            for b, at in _asked(g.kinds[kind], buckets):
                for row, blob in enumerate(got[b, kind]):
                    c[row, at] = _unpack(blob, len(at))
            counts.append(c)
        word, context = np.searchsorted(g.kinds[0], g.of_word), np.searchsorted(g.kinds[0], g.of_context)
        pair = np.searchsorted(g.kinds[1], g.of_pair)
        tokens = np.bincount(g.doc, minlength=len(left))
        own = g.own(context), g.own(word), g.own(pair), tokens[g.doc]
        out = {"doc_id": left["doc_id"].to_numpy(), "n_tokens": tokens}
        for row, name in ((1, "target_loss"), (0, "background_loss")):
            h, one, two, size = (c - o * (mine == row) for c, o in zip((counts[0][row][context], counts[0][row][word], counts[1][row][pair], totals[row]), own))
            w = np.where(h > 0, weight, 0.0)
            single = (matched[row] * one + add) / (matched[row] * size + add * vocabulary)
            loss = -np.log(w * two / np.maximum(h, 1) + (1 - w) * single)
            out[name] = np.bincount(g.doc, weights=loss, minlength=len(left)) / tokens
        out = pd.DataFrame(out)
        return out.assign(difference=out["target_loss"] - out["background_loss"])

    told = answers.where("batch is not null").select(F.col("batch").alias("asked"), F.col("bucket").alias("asked_bucket"), "kind", "background", "target", F.lit(None).cast("long").alias("target_id"))
    none = F.lit(None)
    told = told.unionAll(target.select("target_batch", none.cast("int"), none.cast("int"), none.cast("binary"), none.cast("binary"), "target_id"))
    scored = rows.groupBy("batch").cogroup(told.groupBy("asked")).applyInPandas(apply, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
    return scored
