"""Jobs that SQL cannot say against brute force, on small data with hot keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.operators import consolidation, keywords, pruning, ranking, setjoin, similarity

QP = "site string, query string, url string, clicks long, impressions long, ctr double, position double"


def query_rows(seed, urls=12, queries=60, hot=True):
    r = random.Random(seed)
    rows = []
    for site in ("a", "b"):
        for q in range(queries):
            chosen = set(r.sample(range(urls), r.randint(1, 4)))
            if hot and q % 3:
                chosen.add(0)
            for u in chosen:
                rows.append((site, f"q{q}", f"https://{site}.x/u{u}", r.randint(0, 3), r.randint(5, 40), 0.0, float(r.randint(1, 35))))
    return rows


def groups_in_order(rows):
    """Groups of a site from the most severe: (site, query, members as (url, clicks, impressions, position))."""
    by_q = {}
    for site, q, url, clicks, imp, _, pos in rows:
        if imp >= 10 and 0 < pos <= 30:
            by_q.setdefault((site, q), []).append((pos, url, clicks, imp))
    found = []
    for (site, q), us in by_q.items():
        if len(us) >= 2:
            us.sort()
            found.append((site, -sum(u[3] for u in us[1:]), -len(us), q, [(u, c, i, p) for p, u, c, i in us]))
    return [(site, q, us) for site, _, _, q, us in sorted(found)]


def check_redirects(rows, moves):
    """Holds a plan {(site, url): (target, query)} against the rule and returns the conflicts that follow from it.

    With ``left(u)`` the group that redirects u and ``kept(u)`` the first group that redirects to u: the head of a group is its best member
    that no earlier group redirects, and the others leave for it exactly when no earlier group redirects or keeps them.
    """
    groups = groups_in_order(rows)
    number = {(site, q): n for n, (site, q, _) in enumerate(groups)}
    left, kept = {}, {}
    for (site, url), (to, q) in moves.items():
        left[site, url] = number[site, q]
        kept[site, to] = min(number[site, q], kept.get((site, to), len(groups)))
    assert not left.keys() & kept.keys()
    explained, clashes = set(), set()
    for n, (site, q, us) in enumerate(groups):
        gone = {u[0] for u in us if left.get((site, u[0]), n) < n}
        stay = [u for u in us if u[0] not in gone]
        if not stay:
            clashes.add((site, q, None, "grupo_ignorado"))
            continue
        head = min(stay, key=lambda u: (-u[1], u[3], -u[2], u[0]))[0]
        for url in (u[0] for u in us if u[0] != head):
            if kept.get((site, url), n) < n:
                clashes.add((site, q, url, "canonica_de_outro_grupo"))
            elif url in gone:
                if moves[site, url][0] != head:
                    clashes.add((site, q, url, "destino_mantido"))
            else:
                assert moves[site, url] == (head, q)
                explained.add((site, url))
    assert explained == moves.keys()
    return clashes


@pytest.mark.parametrize("seed", range(6))
def test_redirect_plan(spark, seed):
    rows = query_rows(seed)
    members = ranking.cannibalization_members(spark.createDataFrame(rows, QP))
    states = cut(consolidation.url_states(members))
    plan = consolidation.consolidation_plan(members, states).collect()
    clashes = check_redirects(rows, {(r.site, r.from_url): (r.to_url, r.keyword) for r in plan})
    got = {(r.site, r.keyword, r.url, r.conflict) for r in consolidation.consolidation_conflicts(members, states).collect()}
    assert got == clashes


def counted(spark, table):
    """``table`` and an accumulator of the rows that jobs have read of it."""
    read, schema = spark.sparkContext.accumulator(0), table.schema

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return cut(table).mapInArrow(count, schema), read


def test_the_log_is_read_once_for_the_redirect_plan(spark):
    rows = query_rows(3)
    log, read = counted(spark, spark.createDataFrame(rows, QP))
    members = ranking.cannibalization_members(log)
    numbered = consolidation.number_members(members)
    states = consolidation.url_states(members, numbered)
    plan = consolidation.consolidation_plan(members, states, place=True).collect()
    told = consolidation.consolidation_conflicts(members, states, numbered).collect()
    assert check_redirects(rows, {(r.site, r.from_url): (r.to_url, r.keyword) for r in plan}) == {(r.site, r.keyword, r.url, r.conflict) for r in told}
    assert read.value == len(rows)


def test_rounds_of_the_redirect_plan_see_numbers_only(spark):
    numbered = consolidation.number_members(ranking.cannibalization_members(spark.createDataFrame(query_rows(4), QP)))
    assert dict(numbered.numbers.dtypes) == {"g": "bigint", "at": "bigint", "u": "bigint"}
    rows = numbered.numbers.join(numbered.names, "at").collect()
    assert [r.at for r in sorted(rows, key=lambda r: (r.site, r.gkey, r.fit))] == sorted(r.at for r in rows)
    groups, urls = {}, {}
    for r in rows:
        groups.setdefault((r.site, r.gkey), set()).add(r.g)
        urls.setdefault((r.site, r.fit.u), set()).add(r.u)
    for found in (groups, urls):
        assert all(len(n) == 1 for n in found.values()) and len(set.union(*found.values())) == len(found)


def test_the_log_is_read_once_for_the_pruning_plan(spark):
    rows = query_rows(8, urls=14, queries=12)
    given = spark.createDataFrame(rows, QP)
    log, read = counted(spark, given)
    metrics = given.groupBy("site", "url").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.lit(0.0).alias("ctr"), F.lit(1.0).alias("position"))
    sitemap = spark.createDataFrame([("a", f"https://www.a.x/u{i}/", i) for i in range(0, 14, 2)], "site string, url string, pos long")
    plan = pruning.pruning_plan(metrics, sitemap, log, spark.createDataFrame([], "site string, url string, pos long")).collect()
    assert plan and read.value == len(rows)


def test_redirect_plan_without_groups(spark):
    members = ranking.cannibalization_members(spark.createDataFrame([("a", "q", "u", 1, 50, 1.0, 2.0)], QP))
    assert consolidation.consolidation_plan(members).count() == 0


@pytest.mark.parametrize("seed,queries", [(7, 40), (8, 12), (9, 4), (10, 25)])
def test_targets_by_shared_query(spark, seed, queries):
    rows = query_rows(seed, urls=14, queries=queries)
    rows += [("a", "marca a.x loja", "https://a.x/u0", 1, 5, 0.0, 1.0)]
    live = [("a", f"https://www.a.x/u{i}/", i) for i in range(0, 14, 2)] + [("b", f"https://b.x/u{i}", i) for i in range(1, 14, 3)]
    qp, sm = spark.createDataFrame(rows, QP), spark.createDataFrame(live, "site string, url string, pos long")
    metrics = qp.groupBy("site", "url").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.lit(0.0).alias("ctr"), F.lit(1.0).alias("position"))
    ghosts = pruning.ghost_urls(metrics, sm)
    got = {(r.site, r.match_key): (r.target, r.score) for r in pruning.targets_by_query(ghosts, qp, sm).collect()}
    alive = {(s, u.replace("www.", "").rstrip("/")) for s, u, _ in live}
    score = {}
    for site, q, url, *_m in rows:
        imp = _m[1]
        if (site, url) in alive:
            continue
        for s2, q2, u2, c2, *_ in rows:
            if s2 == site and q2 == q and (site, u2) in alive:
                a = score.setdefault((site, url[8:]), {}).setdefault(u2, [0, 0])
                a[0] += imp + 1
                a[1] += c2
    want = {g: min((-v[0], -v[1], u) for u, v in t.items()) for g, t in score.items()}
    assert got == {g: (w[2], -w[0]) for g, w in want.items()}


@pytest.mark.parametrize("t", [0.5, 0.7])
def test_set_joins(spark, t):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    sets = sorted({tuple(sorted(r.sample(words, r.randint(1, 5)) + (["hot"] if r.random() < 0.6 else []))) for _ in range(120)})
    df = spark.createDataFrame([("s", list(x)) for x in sets], "site string, tokens array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    got = {(tuple(x.left), tuple(x.right)) for x in setjoin.jaccard_pairs(df, df, t).collect()}
    assert got == {(a, b) for a in sets for b in sets if jac(a, b) >= t}
    inside = {(tuple(x.left), tuple(x.right)) for x in setjoin.ordered_subset_pairs(setjoin.rare_first(df)).collect()}
    assert inside == {(a, b) for a in sets for b in sets if len(a) >= 2 and set(a) < set(b)}


def near(a, b):
    a, b = set(a), set(b)
    return min(len(a), len(b)) >= 2 and (a <= b or b <= a or len(a & b) / len(a | b) >= 0.7)


@pytest.mark.parametrize("seed", range(3))
def test_keyword_collisions(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    rows = [("s", r.randint(1, 6), f"p{i % 40:02d}", " ".join(r.sample(words, r.randint(1, 5)) + ["de"] * r.randint(0, 1)), r.randint(0, 50)) for i in range(60)]
    rows = list({(x[1], x[2], x[3]): x for x in rows}.values())
    items = keywords.keyword_items(spark.createDataFrame(rows, "site string, cluster long, slug string, keyword string, impressions long"))
    ordered = sorted(rows, key=lambda x: (x[1], x[2], x[3]))
    used, exact = set(), {}
    by = {}
    for i, x in enumerate(ordered):
        by.setdefault(x[3], []).append(i)
    for k, ix in by.items():
        if len(ix) >= 2 and len({ordered[i][2] for i in ix}) >= 2:
            used.update(ix)
            exact[k] = len(ix)
    got = {(x.norm, x.n) for x in keywords.exact_collisions(items).collect()}
    assert got == set(exact.items())
    want = []
    rest = [i for i in range(len(ordered)) if i not in used]
    for at, i in enumerate(rest):
        if i in used:
            continue
        group = [i]
        for j in rest[at + 1:]:
            if j not in used and near(set(ordered[i][3].split()) - {"de"}, set(ordered[j][3].split()) - {"de"}):
                group.append(j)
                used.add(j)
        if len(group) >= 2 and len({ordered[g][2] for g in group}) >= 2:
            own = min(group, key=lambda g: (-ordered[g][4], g))
            want.append((ordered[own][3], ordered[own][2], len(group), sum(ordered[g][4] for g in group)))
    got = [(x.keyword, x.owner_slug, x.n, x.impr_total) for x in keywords.near_collisions(items).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("prefix,growth", [(1, 2), (3, 2), (5, 8), (512, 8)])
def test_near_groups_in_stretches(spark, prefix, growth):
    r = random.Random(prefix)
    words = [f"w{i}" for i in range(8)]
    rows = [(site, 1, f"p{i:03d}", " ".join(r.sample(words, r.randint(1, 5))), 1) for site in "st" for i in range(50)]
    rows += [("s", 2, f"q{i}", " ".join(["azul", "verde", "claro", f"z{i}"]), 1) for i in range(12)]
    items = keywords.keyword_items(spark.createDataFrame(rows, "site string, cluster long, slug string, keyword string, impressions long"))
    got = {(x.site, tuple(x.tokens)): tuple(x.seed) for x in keywords.near_groups(items, prefix=prefix, growth=growth).collect()}
    want = {}
    for site in "st":
        sets = []
        for x in sorted((x for x in rows if x[0] == site), key=lambda x: x[1:4]):
            tokens = tuple(sorted(set(x[3].split())))
            if len(tokens) >= 2 and tokens not in sets:
                sets.append(tokens)
        for i, tokens in enumerate(sets):
            opener = next((o for o in sets[:i] if want[site, o] == o and near(o, tokens)), tokens)
            want[site, tokens] = opener
    assert got == want


def vectors(seed, n=60, d=4, copies=0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)).astype(np.float32)
    v = np.vstack([v] + [v[:1]] * copies + [np.zeros((1, d), np.float32)])
    return [("s", f"p{i:03d}", [float(x) for x in row]) for i, row in enumerate(v)]


def unit(rows):
    m = np.array([r[2] for r in rows], float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1
    return m / n


VEC = "site string, page string, vec array<float>"


@pytest.mark.parametrize("block", [7, 1000])
def test_cosine_pairs_and_components(spark, block):
    rows = vectors(1, copies=25)
    sim = unit(rows) @ unit(rows).T
    df = spark.createDataFrame(rows, VEC)
    reps = similarity.distinct_vectors(df)
    got = {(r.a, r.b) for r in similarity.cosine_pairs(reps, 0.9, block).collect()}
    first = [i for i in range(len(rows)) if i < 60 or i == len(rows) - 1]
    assert got == {(rows[i][1], rows[j][1]) for i in first for j in first if i < j and sim[i, j] >= 0.9}
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            near_i = [j for j in range(len(rows)) if sim[i, j] >= 0.9 or rows[i][2] == rows[j][2]]
            label[i] = min(label[j] for j in near_i + [i])
    got = {r.page: r.cluster for r in similarity.threshold_clusters(df, 0.9, block).collect()}
    assert got == {rows[i][1]: rows[label[i]][1] for i in range(len(rows))}


@pytest.mark.parametrize("block", [9, 1000])
def test_nearest_pairs(spark, block):
    rows = vectors(2, copies=30)
    sim = np.round(unit(rows) @ unit(rows).T, 3)
    want = sorted((-sim[i, j], rows[i][1], rows[j][1]) for i in range(len(rows)) for j in range(i + 1, len(rows)))[:15]
    got = [(-r.sim, r.a, r.b) for r in similarity.nearest_pairs(spark.createDataFrame(rows, VEC), block_rows=block).orderBy("rank").collect()]
    assert got == want


def agglomerate(sim, t, linkage):
    groups = [[i] for i in range(len(sim))]
    score = (lambda a, b: sim[np.ix_(a, b)].min()) if linkage == "complete" else (lambda a, b: sim[np.ix_(a, b)].mean())
    while len(groups) > 1:
        s, i, j = max((score(groups[i], groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if s <= t:
            break
        groups[-i] += groups.pop(-j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["complete", "average"])
@pytest.mark.parametrize("seed", [3, 4])
def test_linkage(spark, linkage, seed):
    rows = vectors(seed, n=40, copies=3)
    sim = unit(rows) @ unit(rows).T
    got = {}
    for r in similarity.linkage_clusters(spark.createDataFrame(rows, VEC), 0.6, linkage, 11).collect():
        got.setdefault(r.cluster, set()).add(int(r.page[1:]))
    assert {frozenset(g) for g in got.values()} == agglomerate(sim, 0.6, linkage)
    if linkage == "complete":
        assert all(sim[i, j] > 0.6 for g in got.values() for i in g for j in g if i != j)


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_linkage_drops_pairs_that_cannot_merge(spark, monkeypatch, linkage):
    stored = []
    monkeypatch.setattr(similarity, "cut", lambda df: stored.append(cut(df)) or stored[-1])
    rows = [("s", f"p{d}", [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]) for d in (0, 30, 75)]
    got = {r.page: r.cluster for r in similarity.linkage_clusters(spark.createDataFrame(rows, VEC), 0.6, linkage).collect()}
    assert got == {"p0": "p0", "p30": "p0", "p75": "p75"}
    pairs = [t for t in stored if {"a", "b"} <= set(t.columns)]
    assert all(dict(t.dtypes)["a"] == "bigint" for t in pairs) and pairs[-1].isEmpty()


@pytest.mark.parametrize("linkage", ["complete", "average"])
@pytest.mark.parametrize("most", [9, 100])
def test_linkage_settles_components_in_tasks(spark, monkeypatch, linkage, most):
    monkeypatch.setattr(similarity, "FIRST_SPLIT", 1)
    monkeypatch.setattr(similarity, "TASK_CLUSTERS", most)
    rounds, mutual = [], similarity._mutual
    monkeypatch.setattr(similarity, "_mutual", lambda edges: rounds.append(1) or mutual(edges))
    # angles with growing gaps join one after another: a round each
    angles = [sum(1 + i / 10 for i in range(k)) for k in range(12)]
    rows = [("s", f"p{k:02}", [float(np.cos(np.radians(x))), float(np.sin(np.radians(x))), 0.0]) for k, x in enumerate(angles)] + [("s", "q0", [0.0, 0.0, 1.0]), ("s", "q1", [0.0, 0.1, 1.0])]
    rows += [(s, f"r{p}", v) for s, p, v in vectors(7, n=30, d=3, copies=3)]
    sim = unit(rows) @ unit(rows).T
    got = {}
    for r in similarity.linkage_clusters(spark.createDataFrame(rows, VEC), 0.9, linkage).collect():
        got.setdefault(r.cluster, set()).add(r.page)
    assert {frozenset(g) for g in got.values()} == {frozenset(rows[i][1] for i in g) for g in agglomerate(sim, 0.9, linkage)}
    assert all(c == min(g) for c, g in got.items())
    if most == 100:
        assert len(rounds) <= 2


def test_toy_clusters(spark):
    v = [("a1", [1, 0, 0]), ("a2", [0.99, 0.1, 0]), ("a3", [0.98, 0, 0.1]), ("b1", [0, 1, 0]), ("b2", [0.1, 0.99, 0]), ("c1", [0, 0, 1])]
    df = spark.createDataFrame([("s", p, [float(x) for x in e]) for p, e in v], VEC)
    c = similarity.cluster_table(similarity.cluster_members(df, similarity.threshold_clusters(df, 0.8))).collect()
    assert [r["size"] for r in c] == [3, 2, 1]
    one = similarity.cluster_table(similarity.cluster_members(df, similarity.threshold_clusters(df, -1.0))).collect()
    assert [r["size"] for r in one] == [6]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [("s", f"n{i:03d}", f"n{i + 1:03d}") for i in range(99)] + [("s", "z000", f"z{i:03d}") for i in range(1, 200)]
    got = {(r.node, r.component) for r in similarity.components(spark.createDataFrame(edges, "site string, a string, b string")).collect()}
    assert got == {(f"n{i:03d}", "n000") for i in range(100)} | {(f"z{i:03d}", "z000") for i in range(200)}


@pytest.mark.parametrize("same", [True, False])
def test_blocks_are_compared_in_strips(monkeypatch, same):
    monkeypatch.setattr(similarity, "STRIP_ROWS", 7)
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"site": "s", "page": [f"p{i:03}" for i in range(60)], "vec": list(r.normal(size=(60, 4))), "block": ["x" if same or i % 2 else "y" for i in range(60)]})
    rows["block_a"], rows["block_b"] = "x", "x" if same else "y"
    p, q, _, strips = similarity._strips(rows)
    vec = {page: v / np.linalg.norm(v) for page, v in zip(rows["page"], rows["vec"])}
    seen = {}
    for at, sim, usable in strips:
        assert len(sim) <= 7
        seen |= {(p[at + i], q[j]): sim[i, j] for i, j in zip(*np.nonzero(usable))}
    assert seen.keys() == {(a, b) for a in p for b in q if not same or a < b}
    assert all(abs(s - vec[a] @ vec[b]) < 1e-12 for (a, b), s in seen.items())
