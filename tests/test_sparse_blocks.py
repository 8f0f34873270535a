"""Sparse vectors by blocks of pages, and term counts without the rare terms: against plain Python on rows of their own."""

import math
import random
from collections import Counter, defaultdict

import pytest

from rankloom.operators import sparse, vectors


def _pages(n, words=40, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        base = random.Random(i // 5).choices(vocab, k=12)  # five pages share most words
        rows.append((f"s{i % 2}", f"p{i:03d}", " ".join(base[:9] + rng.choices(vocab, k=3))))
    return rows


def _vectors(rows, max_features):
    """{site: {page: {term: weight}}} by the rule."""
    tf = defaultdict(lambda: defaultdict(Counter))
    for site, page, text in rows:
        w = [x for x in text.split() if len(x) >= 2]
        tf[site][page].update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    out = {}
    for site, pages in tf.items():
        total, df = Counter(), Counter()
        for c in pages.values():
            total.update(c)
            df.update(c.keys())
        kept = sorted(total, key=lambda t: (-total[t], t))[:max_features]
        docs = sum(r[0] == site for r in rows)
        idf = {t: math.log((1 + docs) / (1 + df[t])) + 1 for t in kept}
        out[site] = {}
        for page, c in pages.items():
            x = {t: n * idf[t] for t, n in c.items() if t in idf}
            norm = math.sqrt(sum(v * v for v in x.values()))
            if x:
                out[site][page] = {t: v / norm for t, v in x.items()}
    return out


def _weights(spark, rows, max_features=8192):
    return vectors.tfidf(spark.createDataFrame(rows, "site string, page string, text string"), max_features)


@pytest.mark.parametrize("guess", [0, 1, 10**6])
def test_vocabulary_is_whole_whatever_the_estimate(spark, monkeypatch, guess):
    rows = _pages(60) + [("s0", "p000", "w1 w2 w3"), ("s0", "leer", None), (None, "x", "w1 w2"), ("s1", None, "w1 w2 w2")]
    least = spark.createDataFrame([("s0", guess), ("s1", guess)], "site string, least long")
    monkeypatch.setattr(vectors, "_guess", lambda pages, n: least)
    want = _vectors([r for r in rows if r[0] and r[2]] + [("s0", "leer", "")], 30)
    got = {(r.site, r.page, r.term): r.weight for r in _weights(spark, rows, 30).collect()}
    flat = {(s, p, t): w for s, pages in want.items() for p, ts in pages.items() for t, w in ts.items()}
    assert got.keys() == flat.keys()
    assert all(abs(got[k] - flat[k]) < 1e-9 for k in flat)


def test_rare_terms_are_not_stored(spark):
    rows = [("s", f"p{i:03d}", f"gross klein mittel einmal{i} nur{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "site string, page string, text string")
    tf, counts = vectors._kept_counts(pages, 3)
    assert {"gross", "klein", "mittel"} <= {r.term for r in counts.collect()}
    assert tf.count() < 400 * 6  # of nine terms a page, four are the page's own


@pytest.mark.parametrize("block_pages", [7, 8192])
def test_blocks_lose_no_pair(spark, monkeypatch, block_pages):
    monkeypatch.setattr(sparse, "LEAST_PAGES", 10)
    rows = _pages(90)
    weights, threshold = _weights(spark, rows), 0.5
    want = set()
    for site, pages in _vectors(rows, 8192).items():
        for a in pages:
            for b in pages:
                s = sum(w * pages[b].get(t, 0) for t, w in pages[a].items())
                if a < b and s >= threshold:
                    want.add((site, a, b, round(s, 6)))
    packed = sparse._packed(weights, sparse.distinct_sparse(weights))
    got = [(r.site, r.a, r.b, round(r.sim, 6)) for r in sparse._pairs_of(packed, threshold, block_pages).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_a_dense_group_costs_its_size(spark):
    rows = [("s", f"p{i:03d}", "alles gleich hier im text bis auf das letzte wort " + f"nr{i}") for i in range(80)]
    weights = _weights(spark, rows)
    packed = sparse._packed(weights, sparse.distinct_sparse(weights))
    assert sparse._pairs_of(packed, 0.3).count() == 80 * 79 // 2
    assert sparse.sparse_forest(packed, 0.3).count() < 80
    pages = spark.createDataFrame(rows, "site string, page string, text string")
    assert {r.cluster for r in sparse.sparse_clusters(pages, weights, 0.3).collect()} == {"p000"}


def test_a_page_is_sent_for_half_the_blocks_and_meets_each_once(spark, monkeypatch):
    """Two, three, four and seven blocks: every pair of pages is compared in one task, and no page is sent to every block."""
    monkeypatch.setattr(sparse, "LEAST_PAGES", 10**6)
    packed = spark.createDataFrame([("s", f"p{i:02d}", 56, [1, 100 + i], [0.8, 0.6]) for i in range(56)], "site string, page string, pages long, terms array<long>, weights array<double>")
    for block_pages in (28, 19, 14, 8):
        sent = sparse._dealt(packed, block_pages).groupBy("page").count().collect()
        blocks = -(-56 // block_pages)
        assert len(sent) == 56 and sum(r["count"] for r in sent) <= 56 * (blocks // 2 + 1) and (blocks < 3 or max(r["count"] for r in sent) < blocks)
        got = sorted((r.a, r.b, round(r.sim, 6)) for r in sparse._pairs_of(packed, 0.6, block_pages).collect())
        assert got == [(f"p{a:02d}", f"p{b:02d}", 0.64) for a in range(56) for b in range(a + 1, 56)]


def test_common_and_rare_terms_and_odd_weights(spark, monkeypatch):
    """Terms as matrix columns, as postings and both give the plain sums; a weight that is no number reaches only pages that share its term."""
    rng = random.Random(5)
    pages = {f"p{i:02d}": {t: rng.choice([-0.5, 0.25, 0.5, 1.0]) for t in {*rng.sample(range(6), 3), *rng.sample(range(6, 60), 6)}} for i in range(40)}
    pages["p03"][0], pages["p04"][1], pages["p05"][59] = math.inf, math.nan, math.inf
    packed = spark.createDataFrame([("s", p, 40, [*x], [*map(float, x.values())]) for p, x in pages.items()], "site string, page string, pages long, terms array<long>, weights array<double>")
    want = {}
    for a in pages:
        for b in pages:
            s = sum((w * pages[b][t] for t, w in pages[a].items() if t in pages[b]), 0.0)
            if a < b and s >= 0.25:
                want[a, b] = s
    for share, entries, least in ((8, 1 << 23, 512), (1, 1 << 23, 5), (10**6, 1 << 23, 5), (8, 1, 5)):
        for name, value in (("DENSE_SHARE", share), ("DENSE_ENTRIES", entries), ("LEAST_PAGES", least)):
            monkeypatch.setattr(sparse, name, value)
        got = {(r.a, r.b): r.sim for r in sparse._pairs_of(packed, 0.25).collect()}
        assert got == pytest.approx(want, abs=1e-12) and any(math.isinf(x) for x in got.values())
