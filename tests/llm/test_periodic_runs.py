"""Runs of repeated words against a plain search, on odd texts and on texts made to be slow."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rolesieve.llm import periodic_runs as P


def plain_runs(ws):
    n, got = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                got.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in got.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def plain_planted(doc_id, ws):
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def random_words(rng):
    n, kinds = rng.choice([0, 1, 5, 6, 7, 8, 20, 60, 200]), rng.choice([1, 2, 3, 5, 50])
    ws = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 4 else 0):
        a = rng.randrange(n)
        p, e = rng.randrange(1, max(2, (n - a) // 3 + 1)), rng.randrange(a, n)
        for i in range(a, e + 1):
            ws[i] = ws[a + (i - a) % p]
    return ws


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(5)
    for _ in range(15):
        docs = [random_words(rng) for _ in range(60)]
        for ws, (n, runs, best, collapsed) in zip(docs, P._batch([" ".join(ws).encode() for ws in docs])):
            want = plain_runs(ws)
            assert (n, runs, collapsed.decode()) == (len(ws), want, plain_collapsed(ws, want))
            assert best == (min(want, key=lambda r: (-r[1] / r[2], r[0], r[2])) if want else None)


def test_a_wrong_hash_is_found_out(monkeypatch):
    """With a hash of almost no bits stretches look equal that are not; another is drawn and the result stays exact."""
    ws = [random.Random(i // 7).choice("abcde") for i in range(400)] + ["x", "y"] * 20
    want, honest, seeds = plain_runs(ws), P._Stretches, []

    class Weak(honest):
        def __init__(self, words, kinds, seed):
            seeds.append(seed)
            super().__init__(words % 2 if seed < 3 else words, kinds, seed)

    monkeypatch.setattr(P, "_Stretches", Weak)
    assert P._batch([" ".join(ws).encode()])[0][1] == want and seeds == [1, 2, 3]


@pytest.mark.parametrize("ws", [["a"] * 300_000, ["a", "b", "c"] * 60_000, [str(i) for i in range(60_000)] * 2, (["a"] * 999 + ["b"]) * 200], ids=["one", "three", "square", "blocks"])
def test_texts_that_repeat_without_end(ws):
    began = time.time()
    ((n, runs, best, _),) = P._batch([" ".join(ws).encode()])
    assert n == len(ws) and time.time() - began < 20
    period = {300_000: 1, 180_000: 3, 120_000: None, 200_000: 1000}[n]
    assert (0, n, period) in runs if period else not runs


def test_every_nonterminal_is_looked_at_once():
    """1,024 repeats of a passage are one nonterminal each for 1, 2, 4, ... of them: no more than 20 borders."""
    import numpy as np

    words = np.tile(np.arange(7), 1024)
    g = P.Grammar(words, np.zeros(len(words), np.int64))
    assert g.top - g.terminals < 20 and g.size[g.roots].tolist() == [len(words)]


ODD = [None, "", " \t\n", "a", "a a a a a a", "x " * 5, "naïve ½ café 🙂 " * 9, "x" * 5000, "a\x0bb\x0cc\x1cd\x00 " * 8, "und und und und und und Ende", "y z " * 60_000]


def test_odd_texts_and_columns(spark):
    rows = [(i, t, "r", 7, 0.5) for i, t in enumerate(ODD)] + [(4, "a a a a a a", None, None, None), (None, "b b b b b b b", "n", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, best int, _runs double")
    got = P.periodic_runs(docs)
    assert got.columns == ["doc_id", "runs", "best", "_runs", "n_words", "__runs", "_best", "collapsed"]
    got = got.collect()
    assert len(got) == len(rows)
    cut = lambda t: [w.decode() for w in (t or "").encode().split()]
    want = {(i, t, x): plain_runs(cut(t)[:800]) for i, t, x, *_ in rows}
    texts = {(r[0], r[2]): r[1] for r in rows}
    for r in got:
        t = texts[r["doc_id"], r["runs"]]
        runs = [tuple(x) for x in r["__runs"]]
        assert r["n_words"] == len(cut(t))
        if len(cut(t)) <= 800:
            assert runs == want[r["doc_id"], t, r["runs"]] and r["collapsed"] == plain_collapsed(cut(t), runs)
        else:
            assert runs == [(0, 120_000, 2)] and r["collapsed"] == "y z" and tuple(r["_best"]) == runs[0]
    assert P.periodic_runs(docs.limit(0)).count() == 0
    assert P.periodic_runs(docs, block=1).count() == len(rows)


def test_planted_texts(spark):
    rng = random.Random(2)
    rows = [(i, " \n".join(random_words(rng)) if i % 9 else None) for i in range(300)] + [(None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", P.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    moved = 0
    for r in got:
        ws = (r["text"] or "").split()
        want = plain_planted(r["doc_id"], ws)
        moved += want != ws
        assert (r["new"] or "").split() == want
    assert moved > 5
