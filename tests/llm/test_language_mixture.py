"""Language mixtures against plain counting and a plain EM, planted mixtures, held-out rows and odd texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesieve.llm import language_mixture as M
from rolesieve.llm.queries import op13_language_mixture


def plain_counts(texts):
    grams, total = Counter(), 0
    for t in texts:
        for w in M.LETTERS.findall(t.lower()):
            x = "\x02" + w + "\x03"
            total += len(x) - 1
            grams.update(x[i - n : i] for n in range(1, 5) for i in range(n, len(x) + 1))
    return grams, total


def plain_word(w, grams, total, k=4.0):
    """Log likelihood of a word: each character after at most three, orders smoothed into one another."""
    x, out = "\x02" + w + "\x03", 0.0
    for i in range(1, len(x)):
        p = 1e-3
        for n in range(1, min(4, i + 1) + 1):
            seen = total if n == 1 else grams[x[i - n + 1 : i]]
            p = (grams[x[i - n + 1 : i + 1]] + k * p) / (seen + k)
        out += math.log(p)
    return out


def plain_shares(like, times, penalty):
    """EM of 500 rounds on all languages, then on each set of the first ones; the set of greatest penalised likelihood."""

    def em(share):
        for _ in range(500):
            given = like * share
            share = (given / given.sum(1, keepdims=True) * times[:, None]).sum(0) / times.sum()
        return share, float((times * np.log((like * share).sum(1))).sum())

    n = like.shape[1]
    order = np.argsort(-em(np.full(n, 1 / n))[0], kind="stable")
    options = []
    for many in range(1, n + 1):
        start = np.zeros(n)
        start[order[:many]] = 1 / many
        share, loglik = em(start)
        options.append((loglik - penalty * (many - 1) * math.log(times.sum() + 1), -many, share))
    return max(options, key=lambda o: o[:2])[2]


ROWS = {
    "aa": ["the cat and the dog were there then", "that is the other thing with them"],
    "bb": ["der hund und die katze waren dort", "das ist nicht der andere mit dem"],
    "cc": ["le chien et la chatte sont ici", "ce que nous avons pour les autres"],
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for lang, ts in ROWS.items() for i, t in enumerate(ts)] + [(9, None, "aa"), (10, "zzz zzz", None), (11, "123 !", "dd"), (12, "", "aa")]
    return M.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), bits=22)


def test_counts_and_word_likelihoods(model):
    assert model.languages == ["aa", "bb", "cc"]
    words = ["the", "hund", "chats", "x", "ünicode", "them" * 30, "漢字"]
    got = model.log_likelihoods(words)
    for j, lang in enumerate(model.languages):
        grams, total = plain_counts(ROWS[lang])
        assert model.totals[j] == total
        assert np.allclose(got[:, j], [plain_word(w, grams, total) for w in words], atol=1e-6)


def test_shares_against_a_plain_em(model):
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(40):
        n, mix = int(rng.integers(1, 60)), rng.dirichlet([0.4] * 3)
        like = np.exp(-rng.exponential(1.5, (n, 3)))
        like[np.arange(n), rng.choice(3, n, p=mix)] = 1
        docs.append((like, rng.integers(1, 6, n).astype(float)))
    size = [len(t) for _, t in docs]
    got = M.shares(model, np.concatenate([x for x, _ in docs]), np.concatenate([t for _, t in docs]), np.cumsum(size) - size, rounds=500, close=1e-9)
    for s, (like, times) in zip(got, docs):
        want = plain_shares(like, times, model.penalty)
        assert np.allclose(s, want, atol=2e-3), (s, want)


def test_planted_mixtures(spark, model):
    """Sentences of two languages in known shares; one foreign word makes no second language."""
    rng = random.Random(1)
    pick = lambda lang, n: " ".join(rng.choice(" ".join(ROWS[lang]).split()) for _ in range(n))
    rows = [(1, pick("aa", 60) + " " + pick("bb", 40)), (2, pick("cc", 100)), (3, pick("bb", 50) + " hund the katze"), (4, pick("aa", 30) + ". " + pick("cc", 70))]
    got = {r["doc_id"]: r for r in M.predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    share = lambda i: {x["lang"]: x["share"] for x in got[i]["languages"]}
    assert got[1]["lang_pred"] == "aa" and share(1) == pytest.approx({"aa": 0.6, "bb": 0.4}, abs=0.06)
    assert share(2) == {"cc": pytest.approx(1.0)} and share(3) == {"bb": pytest.approx(1.0)}
    assert got[4]["lang_pred"] == "cc" and share(4) == pytest.approx({"cc": 0.7, "aa": 0.3}, abs=0.06)


ODD = [None, "", " \n", "123 4,5 !?", "²³ ½", "a", "The CAT and the dog", "x" * 50_000, "the dog " * 40_000, "漢字かな", "🙂 ②", "é", "wort_wort und1die"]


def test_odd_texts(spark, model):
    rows = [(i, t, "en", 0.5, "w") for i, t in enumerate(ODD)] + [(6, "the dog", None, None, None), (None, "der hund", "x", 1.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, languages string")
    got = M.predict_languages(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] == (r["languages"][0]["lang"] if r["languages"] else "und")
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] != 6}
    assert {i for i, lang in by.items() if lang == "und"} == {0, 1, 2, 3, 4, 10}
    assert by[8] == "aa" and by[None] == "bb"
    assert M.predict_languages(docs.limit(0), model).count() == 0
    assert [(r["lang_pred"], r["score"]) for r in M.predict_languages(docs, M.train(docs.limit(0).withColumn("lang", F.lit("x")))).distinct().select("lang_pred", "score").distinct().collect()] == [("und", 0.0)]


def test_equal_rows_get_equal_results_in_any_block(spark, model):
    docs = spark.createDataFrame([(i, ["the dog und die", "le chien the", "der hund"][i % 3]) for i in range(60)], "doc_id long, text string")
    wide = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in M.predict_languages(docs, model).collect()}
    single = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in M.predict_languages(docs.repartition(4), model, block=1).collect()}
    assert wide == single and all(wide[i] == wide[i % 3] for i in wide)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op13_language_mixture(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right >= 0.97
