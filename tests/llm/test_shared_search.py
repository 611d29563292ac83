"""Ranked search with shared sums against a plain scorer."""

import random
import re
from collections import Counter
from math import floor, log

import pytest

from rolesieve.llm import shared_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k=20):
    """(item_id, rank, doc_id, score), sorted."""
    counted = [(d, Counter(cut(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in counted:
            score = 0
            for t in cut(text):
                if c[t]:
                    m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(rng, n, words=60):
    pick = lambda: rng.choice(["the", "The", "of"]) if rng.random() < 0.3 else f"w{min(rng.randrange(words), rng.randrange(words))}"
    return [" ".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes, cells", [(1 << 20, 1 << 22), (400, 300)], ids=["one block", "many blocks"])
def test_against_a_plain_scorer(spark, block_bytes, cells):
    rng = random.Random(3)
    texts = corpus(rng, 300)
    docs = [(i, t) for i, t in enumerate(texts + texts[:40] * 2)]  # copies: equal scores, more than fit
    items = [(i, t) for i, t in enumerate(corpus(rng, 25) + ["the of the", "w1 w1 w1 w2", "unknown", ""])]
    got = S.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, cells=cells)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(got) == plain_search(docs, items)


def test_odd_rows(spark):
    """Null texts and ids, rows that share an id, marks and letters of all kinds, a very long text, further columns."""
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "Größe ÄB 12x"), (4, "größe äb 12X"), (None, "a b c"), (5, "a\x00b\x7fc`d{e"), (6, "a b c"), (None, "a"), (7, "a " * 100_000), (8, "naïve—dash 🙂"), (9, "𐐀 zz")]
    items = [(1, "a b c"), (1, "größe GRÖßE"), (2, None), (None, "a"), (3, "naïve—dash 🙂 𐐀"), (4, "12x")]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, score string")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, block int")
    assert rows(S.ranked_search(d, q)) == plain_search(docs, items)
    assert rows(S.ranked_search(d, q, k=2)) == plain_search(docs, items, 2)
    for no_docs, no_items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert S.ranked_search(no_docs, no_items).count() == 0


def test_shared_sums():
    """Three items share a set of four terms: it is summed once, and each item ends as few addends."""
    items = [(0, 10, b"a b c d e"), (1, 11, b"d c b a f a"), (2, 12, b"a b c d"), (3, 13, b"b c d f"), (4, 14, b"")]
    p = S.Plan(items)
    assert list(p.terms) == [b"a", b"b", b"c", b"d", b"e", b"f"] and p.repeats.tolist() == [[0, 2]]
    lo, made = len(p.terms) + len(p.repeats), {}

    def spell(x):
        if x < len(p.terms):
            return Counter([x])
        if x < lo:
            t, n = p.repeats[x - len(p.terms)].tolist()
            return Counter({t: n})
        return sum((made.setdefault(y, spell(y)) for y in p.nodes[x - lo].tolist()), Counter())

    for (_, _, text), s in zip(items, p.sums):
        assert sum(map(spell, s.tolist()), Counter()) == Counter(p.terms[t] for t in S.terms_of(text))
    assert len(p.nodes) + sum(max(0, len(s) - 1) for s in p.sums) < sum(len(set(t.split())) - 1 for _, _, t in items[:4])
    assert all(max(pair) < a for a, b in p.rounds for pair in p.nodes[a - lo : b - lo].tolist())


def test_long_items_are_mined_in_pieces():
    text = b" ".join(b"t%d" % i for i in range(1000))
    p = S.Plan([(0, 0, text), (1, 1, text)], piece=16)
    assert max(len(s) for s in p.sums) <= 1000 // 16 + 1 and len(p.nodes) >= 900
