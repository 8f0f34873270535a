"""Expected results of small inputs, rule by rule."""

import datetime as dt
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import scoring, text as tx, urls as ux
from rankloom.operators import content, entities, history, keywords, links, portfolio, prompts, pruning, ranking, similarity, trends, vectors
from rankloom.sinks import reports
from rankloom.sources import files, history as stored, metrics, reviewed_plan, sitemap

ROWS = "site string, url string, position double, clicks long, impressions long, ctr double, has_data boolean"


def col(spark, values, fn, kind="string"):
    """fn over one column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_expected_ctr(spark):
    got = col(spark, [1.0, 1.5, 10.0, 10.5, None, 0.5], scoring.expected_ctr, "double")
    assert got[:2] == [28.5, pytest.approx(22.1)] and got[2:5] == [2.5, None, None] and got[5] == pytest.approx(22.1)


def test_position_bands(spark):
    assert col(spark, [3.0, 3.1, 10.0, 20.0, 50.0, 50.1, None], scoring.band_label, "double") == [
        "Top 3", "1ª Página", "1ª Página", "2ª Página", "3ª Página", "4ª+ Página", "Sem Dados"]


def test_verdict_category(spark):
    assert col(spark, ["PASS", "FAIL", "NEUTRAL", "VERDICT_UNSPECIFIED", "x", None], scoring.verdict_category) == [
        "indexed", "not_indexed", "warning", "unknown", "unknown", "unknown"]


def test_match_key(spark):
    got = col(spark, ["https://www.x.com/a/", "http://X.com/a#f", "https://x.com", "https://x.com/a%20b?q=1", "https://x.com/a+b", "https://x.com/a b"], ux.match_key)
    assert got == ["x.com/a", "x.com/a", "x.com/", "x.com/a b?q=1", "x.com/a+b", "x.com/a b"]


def test_slugs(spark):
    assert col(spark, ["https://ex.com/aquecedor-industrial-de-agua/", "https://ex.com/", "https://ex.com/de-2023", "https://ex.com/x_pre%C3%A7o.html"], ux.slug_phrase) == [
        "aquecedor industrial agua", None, None, "x preço"]
    assert col(spark, ["https://x.com/", "https://x.com/a/Preço"], ux.slug_from_url) == ["index", "preco"]
    assert col(spark, ["Preço do Cão!", "  "], tx.slugify) == ["preco-do-cao", ""]


def test_href_slug(spark):
    bad = ["#", "mailto:a@b", "tel:1", "javascript:x", "//cdn/x", "", "/", None, "https://h.com/"]
    assert col(spark, bad, ux.href_slug) == [None] * len(bad)
    assert col(spark, ["/a/B.php?x#y", "https://h.com/c/", "d.html"], ux.href_slug) == ["b", "c", "d"]


def test_domains(spark):
    assert col(spark, ["sc-domain:a.com", "https://a.com/", "a.com"], ux.normalize_domain) == ["a.com"] * 3
    assert col(spark, ["sc-domain:a.com", "http://a.com", "a.com"], ux.site_url) == ["sc-domain:a.com", "http://a.com/", "https://a.com/"]
    assert col(spark, ["www.casa-verde.com.br", "sc-domain:x_y.com"], ux.brand_from_domain) == ["Casa Verde", "X Y"]


def test_plausible_entity(spark):
    df = spark.createDataFrame([
        ("Exemplo", "exemplo", "", "exemplo.com"), ("Bit", "Bitcoin", "https://bitcoin.org", "bit.eng.br"), ("Bit", "Outro", "https://www.bit.com/x", "www.bit.eng.br"),
        ("Exemplo", "Exemplos", "", "e.com"), ("Bitx", "Bitxy", None, "e.com"),
    ], "b string, n string, u string, d string")
    got = [r[0] for r in df.select(ux.plausible_entity(F.col("b"), F.col("n"), F.col("u"), F.col("d"))).collect()]
    assert got == [True, False, True, True, False]


def test_brand_query(spark):
    df = spark.createDataFrame([("exemplo kits", "exemplokits"), ("preço", "exemplokits"), ("kit", "exemplokits"), ("abc", "abc"), ("q", None)], "q string, b string")
    assert [r[0] for r in df.select(ux.is_brand_query(F.col("q"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_density(spark):
    body = " ".join(f"palavra{i}" for i in range(72)) + " Cane Corso. " + " ".join(f"outra{i}" for i in range(72))
    df = spark.createDataFrame([(body, "cane corso"), ("préço preço-preço apreço", "preço"), ("", "x"), (r"a \E b. a \E", r"\E")], "t string, k string")
    occ = tx.phrase_count(F.lower("t"), F.col("k"))
    got = [tuple(r) for r in df.select(occ, tx.density(occ, tx.phrase_words(F.col("k")), F.size(tx.tokenize(F.col("t"))))).collect()]
    assert got[0] == (1, round(2 / 146 * 100, 2)) and got[1][0] == 2 and got[2] == (0, 0.0)


def test_dominant_ngram(spark):
    texts = ["preço do aquecedor a gás " * 4, "aquecedor gás " * 5, "1 2 " * 9, "uma vez só", None]
    got = col(spark, texts, lambda c: tx.dominant_ngram(tx.tokenize(tx.fold_accents(c))))
    assert got[0].phrase == "preco do aquecedor" and got[0].cnt == 4
    assert (got[1].phrase, got[1].cnt) == ("gas aquecedor gas", 4) and got[2:] == [None, None, None]


def test_model_json(spark):
    replies = ['```json\n{"a": 1,}\n```', 'x {"a": "b,}"} y', "nada", '{"a": 1', None]
    assert col(spark, replies, lambda c: F.get_json_object(tx.model_json(c), "$.a")) == ["1", "b,}", None, None, None]


def test_main_content(spark):
    html = ['<nav>n</nav><main><aside>x</aside>Oi&nbsp;&atilde; <section class="galeria b">g</section></main>', "<article>art</article><p>p", "<header>h</header><p>corpo <script>s</script></p>", "<nav>n</nav>"]
    assert col(spark, html, lambda c: tx.main_content(c, (("section", "galeria"),))) == ["Oi ã", "art", "corpo", None]
    assert col(spark, html[1:2], lambda c: tx.main_content(c, max_chars=2)) == ["ar"]


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROWS)


def test_health(spark):
    inspected = spark.createDataFrame([("a", "indexed"), ("b", "not_indexed")], "site string, category string")
    r = rows(spark, ("a", "u", 1.0, 28, 100, 28.5, True), ("b", "u", None, 0, 0, 0.0, False), ("c", "u", 1.0, 0, 0, 0.0, True), ("c", "v", 40.0, 0, 0, 0.0, True))
    got = {x.site: x for x in ranking.health_score(r, ranking.indexing_summary(inspected)).collect()}
    assert got["a"].grade == "Excelente" and got["a"].score == 100.0
    assert got["b"].grade == "Crítico" and got["b"].position_score == 0.0 and got["b"].ctr_score == 50.0
    assert got["c"].indexation_score is None and got["c"].position_score == 61.0 and got["c"].ctr_score == 0.0
    alerts = {(x.site, x.component, x.severity) for x in ranking.component_alerts(ranking.health_score(r, ranking.indexing_summary(inspected))).collect()}
    assert alerts == {("b", "indexation", "critico"), ("b", "position", "critico"), ("c", "ctr", "critico")}


def test_cannibalization_limits(spark):
    q = spark.createDataFrame([
        ("a", "q1", "u1", 1, 10, 1.0, 3.0), ("a", "q1", "u2", 1, 10, 1.0, 10.0), ("a", "q1", "u3", 1, 9, 1.0, 4.0), ("a", "q1", "u4", 1, 50, 1.0, 31.0),
        ("a", "q2", "u1", 1, 10, 1.0, 3.0), ("a", "q2", "u2", 1, 30, 1.0, 20.0), ("a", "q3", "u1", 1, 99, 1.0, 0.0), ("a", "q3", "u2", 1, 99, 1.0, 3.0),
        ("a", "q4", "u1", 1, 10, 1.0, 3.0), ("a", "q4", "u2", 1, 10, 1.0, 30.0),
    ], "site string, query string, url string, clicks long, impressions long, ctr double, position double")
    got = {x["query"]: (x.severity, x.url_count, x.severity_score) for x in ranking.cannibalization(q).collect()}
    assert got == {"q1": ("alta", 2, 10), "q2": ("média", 2, 30), "q4": ("baixa", 2, 10)}
    first = [x.keyword for x in ranking.group_listing(ranking.cannibalization_members(q)).collect()]
    assert first == ["q2", None, "q1", None, "q4", None]


def series(spark, *values):
    return spark.createDataFrame([("s", str(i), [float(x) for x in v]) for i, v in enumerate(values)], "site string, series string, values array<double>")


def test_trends(spark):
    s = series(spark, [10] * 10 + [15] * 10 + [30] * 10, [30] * 10 + [15] * 10 + [10] * 10, [5] * 30, [1] * 5, [0] * 3 + [1] * 3, [0] * 9)
    assert [r.trend for r in trends.trend_thirds(s).orderBy("series").collect()] == ["rising", "declining", "stable", "stable", "rising", "stable"]
    s = series(spark, [1, 1, 1, 5, 5, 5, 0, 0], [5, 5, 5, 1, 1, 1], [1, 9], [0, 0], [0, 0, 0, 2, 2, 2])
    got = [(r.trend, r.peak, r.latest, r.sparse) for r in trends.short_trend(s).orderBy("series").collect()]
    assert got == [("rising", 5, 5, True), ("declining", 5, 1, True), ("stable", 9, 9, True), ("stable", 0, 0, True), ("rising", 2, 2, True)]


def test_ghosts_and_home(spark):
    sm = spark.createDataFrame([("a", "https://www.a.com/", 0), ("a", "https://www.a.com/p1/", 1), ("b", "https://b.com/x?y=1", 0)], "site string, url string, pos long")
    m = spark.createDataFrame([("a", u, 0, 5, 0.0, 1.0) for u in ("http://a.com/p1", "https://a.com/p1/?q=1", "https://a.com")], "site string, url string, clicks long, impressions long, ctr double, position double")
    assert [r.url for r in pruning.ghost_urls(m, sm).collect()] == ["https://a.com/p1/?q=1"]
    assert {r.site: r.home_url for r in pruning.home_pages(sm).collect()} == {"a": "https://www.a.com/", "b": "https://b.com/"}


def test_pruning_plan(spark):
    live = [("a", "https://a.com/", 0), ("a", "https://a.com/cane-corso-preco", 1)]
    old = [("https://a.com/cane-corso-preco-2023", 0, 2), ("https://a.com/zzz", 1, 2), ("https://a.com/yyy", 0, 50), ("https://a.com/www", 0, 9)]
    sm = spark.createDataFrame(live, "site string, url string, pos long")
    m = spark.createDataFrame([("a", u, c, i, 0.0, 5.0) for u, c, i in old], "site string, url string, clicks long, impressions long, ctr double, position double")
    q = spark.createDataFrame([], "site string, query string, url string, clicks long, impressions long, ctr double, position double")
    ex = spark.createDataFrame([("a", "https://a.com/export", 0), ("a", "https://a.com/yyy/", 1)], "site string, url string, pos long")
    got = {r.url.rsplit("/", 1)[1]: (r.action, r.suggested_target, r.target_source, r.origin) for r in pruning.pruning_plan(m, sm, q, ex).collect()}
    home = ("https://a.com/", "home (fallback)")
    assert got == {
        "cane-corso-preco-2023": ("410", "https://a.com/cane-corso-preco", "slug semelhante", "busca"), "zzz": ("revisar", *home, "busca"),
        "yyy": ("revisar", *home, "busca"), "www": ("410", None, None, "busca"), "export": ("410", None, None, "export-gsc")}
    bare = pruning.pruning_plan(m, sm, q, ex, home_fallback=False).filter("url like '%zzz'").first()
    assert bare.suggested_target is None and bare.target_source is None


def test_reviewed_plan_and_rules(spark):
    body = ["# aviso; x", "url;acao_final;destino_final", "https://a.com/x;410;", "https://a.com/y/?q=a.b;301;https://a.com/z", "https://a.com/w;301;relativo", "https://a.com/k;;", "https://a.com/m;MANTER;", ";410;", "https://a.com/e;301;http://www.a.com/e/", "https://a.com/b;zap;", '"https://a.com/s;1";404;']
    lines = spark.createDataFrame([("a", "f", i, v) for i, v in enumerate(body)], "site string, path string, n long, value string")
    plan = reviewed_plan.reviewed_plan(lines)
    assert [(r.action, r.status) for r in plan.orderBy("n").collect()] == [
        ("410", "entry"), ("301", "entry"), ("301", "error"), ("revisar", "pending"), ("manter", "kept"), ("410", "error"), ("301", "error"), ("zap", "error"), ("404", "entry")]
    rules = {(r.url.split("com", 1)[1], r.format): r.rule for r in reports.removal_rules(plan).collect()}
    assert rules[("/x", "htaccess")] == "RedirectMatch 410 ^/x/?$"
    assert rules[("/y/?q=a.b", "htaccess")] == "RewriteCond %{QUERY_STRING} ^q=a\\.b$\nRewriteRule ^y/?$ https://a.com/z? [R=301,L]"
    assert rules[("/y/?q=a.b", "nginx")] == 'location = /y/ { if ($args = "q=a.b") { return 301 https://a.com/z; } }'
    assert rules[("/y/?q=a.b", "redirect")].startswith("#   https://a.com/y") and rules[("/x", "redirect")] == "Redirect 410 /x"
    comma = spark.createDataFrame([("a", "f", 0, "acao_final,url"), ("a", "f", 1, '404,"https://a.com/p,q"')], "site string, path string, n long, value string")
    assert reviewed_plan.reviewed_plan(comma).first().url == "https://a.com/p,q"


def test_content_verdicts(spark):
    long_text = " ".join(f"palavra{i}" for i in range(400))
    pages = spark.createDataFrame([
        ("a", "https://a.com/curto", "poucas palavras"), ("a", "https://a.com/bom", long_text), ("a", "https://a.com/cheio", (long_text + " ") + "cane corso " * 40),
    ], "site string, url string, text string")
    kws = spark.createDataFrame([("a", "https://a.com/cheio", ["cane corso"])], "site string, url string, keywords array<string>")
    ents = spark.createDataFrame([("a", "https://a.com/bom", f"E{i}", "OTHER", 0.2, i) for i in range(1, 6)], "site string, url string, name string, type string, salience double, rank int")
    cats = spark.createDataFrame([("a", "https://a.com/bom", "/X", 0.9)], "site string, url string, name string, confidence double")
    signals = content.entity_signals(pages.filter("url like '%bom'"), ents, cats)
    got = {r.url.rsplit("/", 1)[1]: r for r in content.content_verdicts(pages, kws, signals).collect()}
    assert got["curto"].verdict == "raso" and got["bom"].verdict == "ok" and got["bom"].entity_count == 5 and got["curto"].classified is None
    assert got["cheio"].verdict == "over_otimizado" and got["cheio"].flags == ["densidade_muito_alta", "repeticao_exata_alta"]
    # 80 words in pairs are 79 bigrams but 39 full "corso cane corso" trigrams cover more
    assert got["cheio"].density_source == "ngram" and got["cheio"].exact_repetitions == 40


def test_entities(spark):
    raw = spark.createDataFrame([("a", "u", n, t, s, i) for i, (n, t, s) in enumerate([("A", "OTHER", 0.5), ("1", "NUMBER", 0.4), ("d", "DATE", 0.3), ("p", "PRICE", 0.2), (" ", "OTHER", 0.9)])], "site string, url string, name string, type string, salience double, pos int")
    assert [r.name for r in entities.entity_filter(raw).collect()] == ["A"]


def history_rows(spark):
    c = lambda v: (v, 1.0, 200, None, None)
    d = [("a", dt.date(2024, 1, 1), "u", 8.0, 1, 5, c("raso")), ("a", dt.date(2024, 1, 2), "u", 5.0, 1, 5, c("ok")), ("a", dt.date(2024, 1, 2), "v", 5.0, 1, 5, c("raso")), ("a", dt.date(2024, 1, 2), "w", 4.0, 1, 9, None)]
    from rankloom.schemas import HISTORY

    return spark.createDataFrame([(r[0], r[1], None, None, *r[2:]) for r in d], HISTORY)


def test_history(spark, tmp_path):
    h = history_rows(spark)
    assert [(r.url, r.position_delta, r.last_verdict) for r in history.content_tracking(h).collect()] == [("v", None, "raso"), ("u", 3.0, "ok")]
    pivot = {r.url: (r.d1, r.d2, r.trend, r.delta) for r in history.history_pivot(h).collect()}
    assert pivot == {"u": (8.0, 5.0, "↑", 3.0), "v": (None, 5.0, "→", 0.0), "w": (None, 4.0, "→", 0.0)}
    assert {(r.url, r.position) for r in history.history_top_series(h, top=1).collect()} == {("u", 8.0), ("u", 5.0)}
    again = h.filter("url = 'u' and date = '2024-01-02'").withColumn("position", F.lit(2.0))
    up = history.upsert_snapshot(h, again)
    assert sorted((str(r.date), r.url, r.position) for r in up.collect()) == [("2024-01-01", "u", 8.0), ("2024-01-02", "u", 2.0)]
    many = h.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("date", F.expr("date_add(date, k * 5)")).drop("k")
    assert history.upsert_snapshot(many, again).select("date").distinct().count() == 30
    path = str(tmp_path / "h")
    reports.write_history(h, path)
    reports.write_history(again, path)
    assert sorted((r.url, r.position) for r in stored.read_history(spark, path).collect()) == [("u", 2.0), ("u", 8.0)]


def test_worklist(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    urls = spark.createDataFrame([("a", x) for x in "stuv"], "site string, url string")
    res = spark.createDataFrame([("a", "s", "2024-01-01 00:00:00", False), ("a", "t", "2023-12-31 23:59:59", False), ("a", "u", "2024-01-01 12:00:00", True)], "site string, url string, t string, failed boolean").withColumn("cached_at", F.col("t").cast("timestamp"))
    assert sorted(r.url for r in history.refresh_worklist(urls, res, now, 24).collect()) == ["t", "u", "v"]


def test_links(spark):
    pages = spark.createDataFrame([
        ("s", "hub", "<a href='/um.php'>Preço  Cane <b>Corso</b></a><a class=x href=dois>dois</a><a href=\"https://fora.com/x\">x</a><script><a href='/tres'>n</a></script><a href='/hub'>eu</a>"),
        ("s", "um", '<a href="/hub/">hub</a><a href="/dois#x">preco cane corso</a><a>sem</a>'), ("s", "dois", ""),
    ], "site string, page string, markup string")
    found = links.extract_links(pages)
    assert sorted((r.page, r.pos, r.href, r.anchor) for r in found.collect())[:2] == [("hub", 0, "/um.php", "Preço Cane Corso"), ("hub", 1, "dois", "dois")]
    edges = links.link_edges(found, pages)
    assert {(r.src, r.dst) for r in edges.collect()} == {("hub", "um"), ("hub", "dois"), ("um", "hub"), ("um", "dois")}
    assert {(r.anchor, r.dst, r.targets) for r in links.anchor_collisions(edges).collect()} == {("preco cane corso", "um", 2), ("preco cane corso", "dois", 2)}
    assert links.link_orphans(pages, edges).count() == 0
    spokes = spark.createDataFrame([("s", "g", "hub", "um"), ("s", "g", "hub", "dois")], "site string, cluster string, hub string, spoke string")
    gap = links.hub_spoke_gaps(links.hub_spoke_links(spokes, edges)).first()
    assert (gap.spokes_total, gap.missing_to_hub, gap.missing_from_hub, gap.complete) == (2, 1, 0, False)


def test_tiers(spark):
    t = spark.createDataFrame([("s", p) for p in "abc"], "site string, page string")
    e = spark.createDataFrame([("s", "a", "b", "x")], "site string, src string, dst string, anchor string")
    em = spark.createDataFrame([("s", "b", "l", "index"), ("s", "c", "m", "widget")], "site string, src string, list string, mode string")
    mem = spark.createDataFrame([("s", "l", "c"), ("s", "m", "c"), ("s", "l", "z")], "site string, list string, dst string")
    inbound = links.template_inbound(em, mem, t)
    assert [(r.dst, r.mode) for r in inbound.collect()] == [("c", "index")]
    assert {r.page: r.tier for r in links.link_tiers(t, e, inbound).collect()} == {"a": "orphan", "b": "contextual", "c": "template_only"}


def test_cluster_performance(spark):
    m = spark.createDataFrame([("s", "g", p, 3, 0.9, "b") for p in "abc"], "site string, cluster string, page string, size long, cohesion double, representative string")
    x = spark.createDataFrame([("s", "a", 2, 100, 5.0), ("s", "c", 20, 350, 3.0)], "site string, page string, clicks long, impressions long, position double")
    r = similarity.cluster_performance(similarity.members_with_metrics(m, x)).first()
    assert (r.canonical, r.canonical_differs, r.group_clicks, r.group_impressions) == ("c", True, 22, 450)


def test_keyword_items(spark):
    p = spark.createDataFrame([("s", 1, "a", "Cane Corso preço", 50), ("s", 2, "b", "cane corso PRECO", 10), ("s", 2, "c", "", 1), ("s", 3, "d", "preço", 1)], "site string, cluster long, slug string, keyword string, impressions long")
    c = keywords.exact_collisions(keywords.keyword_items(p)).collect()
    assert [(r.kind, r.owner_slug, r.n, r.cross_cluster, r.impr_total) for r in c] == [("exata", "a", 2, True, 60)]


def test_sitemap_documents(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = spark.createDataFrame([
        ("a", "i", 0, f"<sitemapindex {ns}><sitemap><loc>d1</loc></sitemap><sitemap><loc>d2</loc></sitemap></sitemapindex>"),
        ("a", "d1", 1, f"<urlset {ns}><url><loc> https://a/1 </loc></url><url><loc></loc></url><url><loc>https://a/2?x&amp;y</loc></url></urlset>"),
        ("a", "d2", 2, f"<urlset {ns}><url><loc>https://a/1</loc></url><url><lastmod>x</lastmod><loc>https://a/3</loc></url></urlset>"), ("a", "d3", 3, "<urlset><url><loc>https://a/9</loc></url></urlset>"),
        ("b", "i", 0, "<urlset><url><loc>https://b/1</loc></url>"), ("c", "i", 0, "<s:urlset xmlns:s='x'><s:url><s:loc>https://c/1</s:loc></s:url></s:urlset>"),
    ], "site string, doc_url string, seq int, xml string")
    got = sorted((r.site, r.url, r.doc) for r in sitemap.sitemap_urls(docs).collect())
    assert got == [("a", "https://a/1", 0), ("a", "https://a/2?x&y", 0), ("a", "https://a/3", 1), ("c", "https://c/1", 0)]


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "um.php").write_text("<?php x ?><p>" + "texto " * 80 + "</p>")
    (tmp_path / "p" / "dois.html").write_text("<p>curto</p>")
    (tmp_path / "p" / "nota.txt").write_text("x")
    src = files.folder_sources(files.read_whole(spark, str(tmp_path / "p")), "s")
    assert sorted(r.page for r in src.collect()) == ["dois", "um"] and [r.page for r in files.folder_pages(src).collect()] == ["um"]
    (tmp_path / "sites.txt").write_text("a.com # nota\n\n# só nota\n  b.com\n")
    sites = files.site_list(files.read_lines(spark, str(tmp_path / "sites.txt")))
    assert [r.site for r in sites.orderBy("n").collect()] == ["a.com", "b.com"]
    with pytest.raises(ValueError):
        files.require_sites(sites.limit(0))
    (tmp_path / "export.csv").write_text("".join(f"x;https://a.com/p{i % 900};y\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    lines = files.read_export_lines(spark, str(tmp_path / "export.csv"))
    urls = files.export_urls(lines.withColumn("site", F.lit("a.com"))).orderBy("pos").collect()
    assert lines.rdd.getNumPartitions() > 4 and [r.url for r in urls] == [f"https://a.com/p{i}" for i in range(900)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    d = tmp_path / "r" / "2024-01-02_posicao.json"
    d.parent.mkdir()
    one = lambda p: json.dumps({"site": "s", "urls": [{"url": "https://s/A", "position": p, "clicks": 1, "impressions": 2, "ctr": 1.0, "has_data": True}]})
    d.write_text(one(2.0))
    (d.parent / "2024-01-01_posicao.json").write_text(one(9.0))
    (d.parent / "historico_posicao.json").write_text(one(7.0))
    assert [(r.page, r.position) for r in files.snapshot_metrics(files.read_reports(spark, str(d.parent))).collect()] == [("a", 2.0)]


def test_landing_and_window(spark, tmp_path):
    land = spark.createDataFrame([("s", dt.date(2024, 1, 1), "u", 3.0, 7.0, 0.12345, 4.26)], "site string, end_date date, url string, clicks double, impressions double, ctr double, position double")
    land.write.partitionBy("site", "end_date").parquet(str(tmp_path / "l"))
    r = metrics.page_metrics(metrics.read_landing(spark, str(tmp_path / "l"))).first()
    assert (r.clicks, r.impressions, r.ctr, r.position) == (3, 7, 12.35, 4.3)
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-03-01')) date")
    got = metrics.in_report_window(days, F.lit("2024-02-20").cast("date"), 30).agg(F.count("*"), F.min("date"), F.max("date")).first()
    assert tuple(got) == (31, dt.date(2024, 1, 18), dt.date(2024, 2, 17))


def test_sinks(spark, tmp_path):
    plan = spark.createDataFrame([("a b/c", "https://a/x?y=1", "https://a/z", "preço", "média", 1, 2)], "site string, from_url string, to_url string, keyword string, severity string, clicks_from long, clicks_to long")
    rules = reports.redirect_rules(plan)
    assert {r.format: r.rule for r in rules.collect()} == {"htaccess": "Redirect 301 /x?y=1 https://a/z", "nginx": "location = /x?y=1 { return 301 https://a/z; }"}
    reports.write_rules(rules, str(tmp_path / "r"))
    lines = spark.read.text(str(tmp_path / "r"))
    assert {r.value for r in lines.filter("file = 'nginx'").collect()} == {reports.NOTICE, "# keyword: preco  (severidade media)", "location = /x?y=1 { return 301 https://a/z; }"}
    reports.write_by_site(reports.redirect_csv_rows(plan), str(tmp_path / "c"), "csv", header=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().site_dir == "a_b_c"
    p = spark.createDataFrame([("s", "u", 1, 2, 1.0, 3.25, "busca", "410", ["q" * 70, " b "], None, None), ("s", "v", 1, 2, 1.0, None, "busca", "410", [], None, None)],
                              "site string, url string, clicks long, impressions long, ctr double, position double, origin string, action string, top_queries array<string>, suggested_target string, target_source string")
    got = {r.url: (r.posicao, r.top_queries) for r in reports.pruning_csv_rows(p).collect()}
    assert got == {"u": ("3,3", "q" * 57 + "... | b"), "v": ("", "")}


def test_prompts_and_plugins(spark):
    groups = spark.createDataFrame([("s", "g", 1, 3)], "site string, cluster string, rank int, size long")
    mem = spark.createDataFrame([("s", "g", p, c, 10, 2.0) for p, c in (("a", 1), ("b", 5), ("c", 3))], "site string, cluster string, page string, clicks long, impressions long, position double")
    txt = spark.createDataFrame([("s", p, p * 2000) for p in "abc"], "site string, page string, text string")
    pr = prompts.judgement_prompts(groups, mem, txt, max_pages=2)
    r = pr.first()
    assert r.omitted == 1 and r.prompt.index("slug: b") < r.prompt.index("slug: c") and "b" * 1500 in r.prompt and "b" * 1501 not in r.prompt
    reply = '{"verdict": "spun", "lacunas": "x"}'
    j = prompts.judgements(prompts.score_prompts(pr, lambda s, u: reply)).first()
    assert j.raw_ok and j.base_page == ""
    bad = prompts.score_prompts(pr, lambda s, u: 1 / 0).first()
    assert bad.reply == "" and "division" in bad.error
    plan = prompts.differentiation_plan(prompts.score_prompts(pr, lambda s, u: '{"paginas": [{"slug": "b", "keyword_alvo": "k"}]}'), mem).first()
    assert (plan["head"], plan.slug, plan.role, plan.keyword) == ("b", "b", "spoke", "k")
    out = portfolio.run_per_site(spark.createDataFrame([("a", 2), ("b", 0)], "site string, n int"), lambda r: {"x": 1.0 / r["n"]}, "x double")
    assert {(r.site, r.status, r.x) for r in out.collect()} == {("a", "OK", 0.5), ("b", "ERRO", None)}


def test_stored_vectors_are_reused(spark):
    pages = spark.createDataFrame([("s", "a", "x"), ("s", "b", "y")], "site string, page string, text string")
    first = vectors.incremental_embeddings(pages, vectors.hashed(pages, "m", "b").select("site", "page", "hash", F.array(F.lit(0.0)).alias("vec")).limit(0), lambda t: [[float(len(x))] for x in t], "m", "b")
    kept = first.select("site", "page", "hash", "vec")
    changed = pages.withColumn("text", F.when(F.col("page") == "b", "yy").otherwise(F.col("text")))
    got = {r.page: (r.reused, r.vec) for r in vectors.incremental_embeddings(changed, kept, lambda t: [[float(len(x))] for x in t], "m", "b").collect()}
    assert got == {"a": (True, [1.0]), "b": (False, [2.0])}


def test_list_emitters_of_templates(spark):
    pages = [
        ("loop", "<?php foreach ($blog as $a) echo formatStringToURL($a);"), ("part", "<?php foreach (array_slice($blog, 0, 2) as $a) echo formatStringToURL($a);"),
        ("pick", "<?php $b = $blog; $k = array_rand($b, 3); formatStringToURL($k);"), ("none", "<?php foreach ($blog as $a) echo $a;"), ("other", "<?php foreach ($rest as $a) formatStringToURL($a);"),
        ("inc", "<?php require './w.php';"), ("both", "<?php include 'w.php'; foreach ($blog as $a) formatStringToURL($a);")]
    markup = spark.createDataFrame([("s", p, m) for p, m in pages], "site string, page string, markup string")
    files = spark.createDataFrame([("s", "w.php", "array_rand($blog, 2); formatStringToURL(1)")], "site string, path string, text string")
    lists = spark.createDataFrame([("s", "blog")], "site string, list string")
    got = {r.src: r.mode for r in links.list_emitters(markup, files, lists).collect()}
    assert got == {"loop": "index", "part": "widget", "pick": "widget", "inc": "widget", "both": "index"}


def test_hub_choice(spark):
    members = spark.createDataFrame([("s", c, p) for c, ps in (("a", "xyz"), ("b", "pq"), ("c", "o")) for p in ps], "site string, cluster string, page string")
    perf = spark.createDataFrame([("s", "a", 3, "x", "y"), ("s", "b", 2, None, "q"), ("s", "c", 1, "o", "o")], "site string, cluster string, size int, canonical string, representative string")
    plan = spark.createDataFrame([("s", "a", "", 0, "z", "kz"), ("s", "a", "", 1, "x", "kx"), ("s", "a", "", 2, "", "k")], "site string, cluster string, head string, pos int, slug string, keyword string")
    rows = lambda df: sorted((r.cluster, r.hub, r.hub_keyword, r.spoke, r.keyword) for r in df.collect())
    assert rows(links.hub_choice(members, perf, plan)) == [("a", "z", "kz", "x", "kx"), ("b", "q", "", "p", "")]
    assert rows(links.hub_choice(members, perf)) == [("a", "x", "", "y", ""), ("a", "x", "", "z", ""), ("b", "q", "", "p", "")]


def test_rule_files_are_ordered_and_replaced(spark, tmp_path):
    out = str(tmp_path / "rules")
    rows = [(site, f"https://{site}/{(i * 7919) % 5000}", "https://x/z", "k", "alta", 1, 2, (i * 7919) % 5000) for site in ("a", "b") for i in range(5000)]
    plan = spark.createDataFrame(rows, "site string, from_url string, to_url string, keyword string, severity string, clicks_from long, clicks_to long, place long").repartition(5)
    for _ in range(2):  # a rerun replaces
        reports.write_rules(reports.redirect_rules(plan), out)
    reports.write_rules(reports.redirect_rules(plan.filter("site = 'b' and place < 3")), out)
    found = {}
    for f in (tmp_path / "rules").glob("site_dir=*/file=*/*.txt"):
        found.setdefault((f.parts[-3][9:], f.parts[-2][5:]), []).append(f.read_text().splitlines())
    assert sorted(found) == [(s, f) for s in "ab" for f in ("htaccess", "nginx")] and all(len(v) == 1 for v in found.values())
    lines = found["a", "htaccess"][0]
    assert lines[0] == reports.NOTICE and [x for x in lines if x.startswith("Redirect")] == [f"Redirect 301 /{i} https://x/z" for i in range(5000)]
    assert len(found["b", "nginx"][0]) == 7


def test_redirect_table_with_conflicts(spark):
    place = "struct<gkey:struct<s:int>,fit:struct<u:string>>"
    plan = spark.createDataFrame([("s", "https://s/a", "https://s/b", "k, x", "alta", 1, 2, ((1,), ("a",)))], f"site string, from_url string, to_url string, keyword string, severity string, clicks_from long, clicks_to long, place {place}")
    conflicts = spark.createDataFrame([("s", "q", "https://s/c", "destino_mantido", "https://s/d"), ("t", "w", None, "grupo_ignorado", None)], "site string, keyword string, url string, conflict string, kept_target string")
    got = [(r.site_dir, r.part, r.value) for r in reports.redirect_csv_lines(plan, conflicts).orderBy("site_dir", "part").collect()]
    head = "from_url,to_url,keyword,severity,clicks_from,clicks_to"
    assert got == [
        ("s", 0, reports.NOTICE), ("s", 1, head), ("s", 2, 'https://s/a,https://s/b,"k, x",alta,1,2'), ("s", 3, '# conflito: grupo "q": https://s/c ja redireciona para https://s/d'),
        ("t", 0, reports.NOTICE), ("t", 1, head), ("t", 3, '# conflito: grupo "w": todas as URLs ja possuem redirect em grupos de maior severidade')]


def test_function_over_the_rows_of_sites(spark):
    rows = spark.createDataFrame([(f"s{i % 3}", i, "r") for i in range(3000)], "site string, n long, requested string")
    sites = spark.createDataFrame([("s0",), ("s1",), ("s1",), ("leer",)], "site string")

    def total(site, batches):
        if site == "s1":
            next(batches)
            raise ValueError("no")
        return {"total": sum(sum(b.column("n").to_pylist()) for b in batches), "other": 1}

    got = {r.site: (r.status, r.error, r.total) for r in portfolio.run_over_sites(sites, rows, total, "total long").collect()}
    assert got == {"s0": ("OK", None, sum(range(0, 3000, 3))), "s1": ("ERRO", "no", None), "leer": ("OK", None, 0)}
    assert portfolio.run_over_sites(sites.limit(0), rows, total, "total long").count() == 0


def test_sitemap_files(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    doc = lambda *urls: f"<urlset {ns}>\n" + "\n".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    index = f"<sitemapindex {ns}><sitemap><loc>https://s/1.xml?a=b</loc></sitemap><sitemap><loc>https://s/2.xml</loc></sitemap></sitemapindex>"
    docs = [("s", "https://s/sitemap.xml", 0, index), ("s", "https://s/1.xml?a=b", 1, doc("https://s/a", "https://s/b")), ("s", "https://s/2.xml", 2, doc("https://s/c")[:-3]), ("t", "https://t/sitemap.xml", 0, doc("https://t/x"))]
    df = spark.createDataFrame(docs, "site string, doc_url string, seq int, xml string")
    for _ in range(2):
        sitemap.land_sitemaps(df, str(tmp_path / "maps"))
    got = sorted((r.site, r.url, r.doc, r.pos) for r in sitemap.sitemap_urls(sitemap.read_sitemaps(spark, str(tmp_path / "maps"))).collect())
    assert got == [("s", "https://s/a", 0, 0), ("s", "https://s/b", 0, 1), ("t", "https://t/x", 0, 0)]


def test_fold_of_letters_that_become_several(spark):
    texts = ["ﬁm ½ Ǆ", "한국어 각", "ß ø «", "Ｆｕｌｌ ①②", "é̂", "", None, "plain", "𝔘𝔫𝔦 😀 ﷺ"]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.select("i", tx.fold_accents(F.col("t")).alias("f")).orderBy("i").collect()] == want
    plan = df.select(tx.normalize_keyword(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_texts_are_folded_as_columns_are(spark):
    texts = ["preço já é 10½", "ﬁm Ｆｕｌｌ 한국 ёлка", "plain", "", None, "ȩ́t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(tx.fold_text(F.col("t")).alias("a"), tx.fold_accents(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert "translate(" not in plan(content.text_measures(df.withColumnRenamed("t", "text")))


def test_dominant_ngram_takes_the_greatest_of_equals(spark):
    words = [["bb", "cc"] * 4 + ["xx"] + ["dd", "ee"] * 4, ["aa", None, "aa"] * 5, [], ["a1", "b1", "c1"] * 4]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")
    got = [r.g for r in df.select("i", tx.dominant_ngram(F.col("w")).alias("g")).orderBy("i").collect()]
    assert tuple(got[0]) == (8, 2, 4, "dd ee") and tuple(got[1]) == (8, 2, 4, "aa aa")
    assert got[2] is None and tuple(got[3]) == (12, 3, 4, "a1 b1 c1")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_verdicts_are_computed_before_the_sort(spark):
    pages = spark.createDataFrame([("s", "https://s/u", "um texto " * 5)], "site string, url string, text string")
    signals = spark.createDataFrame([("s", "https://s/u", 1, 0.1, ["texto"], 1, True)], "site string, url string, entity_count int, salience_concentration double, top_names array<string>, n_entities int, classified boolean")
    words = spark.createDataFrame([("s", "https://s/u", ["texto"])], "site string, url string, keywords array<string>")
    listed = content.verdict_listing(content.content_verdicts(pages, words, signals))
    assert "regexp_extract_all" not in plan(listed) and [r.verdict for r in listed.collect()] == ["raso"]


def test_a_snapshot_is_computed_once(spark):
    rows = "site string, date string, url string, position double"
    stored_rows, calls = spark.createDataFrame([("s", "2024-01-01", "u", 1.0)], rows), spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            calls.add(len(pdf))
            yield pdf

    snapshot = spark.createDataFrame([("s", "2024-02-01", "u", 2.0)], rows).mapInPandas(counted, rows)
    assert len(history.upsert_snapshot(stored_rows, snapshot).collect()) == 2 and calls.value == 1
