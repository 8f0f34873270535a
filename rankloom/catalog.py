"""Every registered query: operator id and name to a function of the derived tables."""

import json
import uuid

from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import urls as ux
from rankloom.functions.scoring import (
    band_action, band_label, expected_ctr, is_fresh, opportunity_band, opportunity_score, verdict_category,
)
from rankloom.functions.wordlists import TTL_HOURS
from rankloom.lineage import cut, drop, run_folder
from rankloom.operators import (
    consolidation as cons, content, entities as ent, history as hist, keywords as kw, links, portfolio, prompts,
    pruning, ranking, similarity as sim, sparse, trends, vectors as vec,
)
from rankloom.sources import files, history as stored, metrics, reviewed_plan as rp, sitemap as sm
from rankloom.sinks import reports

TEXT_NEAR = 0.55  # the same for word vectors of the given texts
NEAR = 0.40  # similarity threshold that gives groups on the given vectors
AS_OF = "2024-01-28"
COL = F.col


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- sources -------------------------------------------------------------------------------------

def s05(d):
    return sm.sitemap_urls(d.sitemap_docs()).select("site", "url", "doc", "pos")


def s06(d):
    # a robots text per page host: the sitemap line comes after a comment and in mixed case
    t = d.markup().select("site").distinct().withColumn(
        "text", F.concat(F.lit("User-agent: *\n# sitemap: no\nSiteMap: https://"), "site", F.lit("/sitemap.xml \nSitemap: https://x/")))
    return sm.robots_sitemap(t)


def _page_files(d):
    return d.table("pages").select(
        F.concat(F.lit("/site/"), F.col("page_id"), F.when(F.length("url") % 3 == 0, ".php").when(F.length("url") % 3 == 1, ".HTML").otherwise(".txt")).alias("path"),
        F.col("html").alias("value"))


def s07(d):
    gone = d.table("benchmark").select(F.col("item_id").cast("string").alias("page"))
    return files.folder_pages(files.folder_sources(_page_files(d), "all", gone), 300)


def s08(d):
    return files.folder_sources(_page_files(d), "all").select("site", "page", F.length("markup").alias("chars"))


def _settings(d):
    names = d.table("nation").select(F.concat(F.lit("s"), F.col("n_regionkey")).alias("site"), "n_nationkey", F.concat(F.lit("Guia Nação "), "n_nationkey").alias("n"))
    quoted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n"))), lambda x: F.concat(F.lit('"'), x["n"], F.lit('"'))), ",\n")
    return names.groupBy("site").agg(F.concat(F.lit("<?php $blog = array("), quoted, F.lit('\n);\n$palavras_chave = array("Guia Nacao 3", "Sem Página", "guia nação 12"\n);')).alias("value"))


def s09(d):
    names = files.listed_names(_settings(d))
    pages = d.table("nation").select(F.concat(F.lit("s"), F.col("n_regionkey")).alias("site"), F.concat(F.lit("guia-nacao-"), "n_nationkey").alias("page"))
    return files.listed_pages(names, pages)


def s10(d):
    lines = d.table("customer").select(
        F.col("c_custkey").alias("n"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# "), "c_name")).when(F.col("c_mktsegment") == "BUILDING", "  ")
        .otherwise(F.concat(F.lit("  "), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example  # "), "c_mktsegment")).alias("value"))
    return files.site_list(lines)


def s13(d):
    day = F.to_date(F.date_trunc("month", "l_shipdate"))
    t = d._metrics(day.alias("date")).select(
        "site", F.concat(F.lit("/r/"), "site", F.lit("/"), F.col("date"), F.lit("_posicao.json")).alias("path"), F.col("l_suppkey").alias("pos"),
        "url", "clicks", "impressions", "position", F.round(100.0 * F.col("clicks") / F.col("impressions"), 2).alias("ctr"), F.lit(True).alias("has_data"))
    return files.snapshot_metrics(t)


def s14(d):
    t = d.table("orders").select(
        d.site_of(F.col("o_custkey")).alias("site"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("/p/"), "o_orderkey", F.lit("_poda.csv")).alias("path"),
        (F.col("o_orderstatus") == "F").alias("is_legacy"))
    return hist.latest_per_site(t)


def s15(d):
    """Legacy documents, one per snapshot row group, built from the history and read back."""
    h = d.history().select("site", "date", "url", F.struct("position", "clicks", "impressions", "content").alias("m"))
    urls = F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", "m"))))
    snap = h.groupBy("site", "date").agg(urls.alias("urls")).select("site", F.struct(
        F.col("date").cast("string").alias("date"), F.struct(F.date_sub("date", 27).cast("string").alias("start"), F.col("date").cast("string").alias("end")).alias("period"), "urls").alias("s"))
    docs = snap.select(F.to_json(F.struct("site", F.array("s").alias("snapshots"))).alias("json"))
    out = stored.legacy_history(docs.unionByName(d.table("region").select(F.concat(F.lit("{broken "), "r_name").alias("json"))))
    return out.select("site", "date", "period_start", "period_end", "url", "position", "clicks", "impressions", COL("content.verdict").alias("verdict"), COL("content.words").alias("words"))


# ---- sinks: the rows a file would hold -------------------------------------------------------------

def k10(d):
    return d.table("customer").select(
        F.concat(F.lit("www.loja "), "c_custkey", F.lit("/é?"), F.lower("c_mktsegment")).alias("site"),
    ).select("site", ux.partition_name(F.col("site")).alias("folder"))


# ---- scalar functions over their host tables -------------------------------------------------------

def _domains(d):
    k = F.col("s_suppkey")
    return d.table("supplier").select(k, F.concat(
        F.element_at(F.array(*[F.lit(p) for p in ("sc-domain:", "https://", "http://www.", "")]), F.pmod(k, F.lit(4)).cast("int") + 1),
        F.lit("loja-"), k, F.lit(".example"), F.when(F.pmod(k, F.lit(3)) == 0, "/").otherwise("")).alias("domain"))


def _odd_urls(d):
    """Spellings of supplier pages that exercise keys: case, www, escapes, spaces, params, queries, fragments."""
    k = F.col("s_suppkey")
    forms = F.array(
        d.url_of(k), F.concat(F.lit("HTTP://WWW.S"), k, F.lit(".Example/A%20b/")), F.concat(F.lit("https://s.example/a+b/"), k, F.lit("//")),
        F.concat(F.lit("https://s.example/p"), k, F.lit(";x=1?q=A%20b#top")), F.concat(F.lit(" https://www.s.example/um dois/"), k, F.lit(" ")),
        F.concat(F.lit("https://s.example?id="), k), F.lit("https://s.example/"), F.concat(F.lit("https://s.example/%zz"), k), F.concat(F.lit("/so/caminho-"), k, F.lit(".php")))
    return d.table("supplier").select(k, F.explode(forms).alias("url"))


#: Texts whose decomposition is more than one letter, or in another script; the SQL check holds their folded forms.
ODD_LETTERS = ("preço…barato", "½ ﬁm №", "Ｆｕｌｌ ｗｉｄｔｈ", "Йод ёлка", "άλφα", "ŀuz ĳs ǆip", "①②③ ㎏", "straße ørn", "e\u0301te\u0300")


def _odd_texts(d):
    k = F.pmod("n_nationkey", F.lit(len(ODD_LETTERS))).cast("int")
    return d.table("nation").select("n_nationkey", F.concat(F.get(F.array(*[F.lit(x) for x in ODD_LETTERS]), k), F.lit(" "), F.lower("n_name")).alias("text"))


def x10_odd(d):
    t = F.col("text")
    return _odd_texts(d).select("n_nationkey", tx.fold_accents(t).alias("folded"), tx.ascii_fold(t).alias("plain"), tx.normalize_keyword(t).alias("keyword"))


def x05(d):
    return pruning.home_pages(d.sitemap())


def x06(d):
    # brand of a shop named after each part size, queries with and without it
    t = d.table("part").select(
        F.when(F.length("p_name") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Loja"), "p_size", F.lit(" preço"))).alias("query"),
        F.concat(F.lit("https://www.loja"), "p_size", F.lit(".example/x")).alias("url"))
    brand = ux.brand_compact(F.col("url"))
    return t.select("query", brand.alias("brand"), ux.is_brand_query(F.col("query"), brand).alias("is_brand")).distinct()


def x13(d):
    t = d.texts().select("url", "text").withColumn("tok", tx.tokenize(F.col("text"))).withColumn("phrase", F.array_join(F.slice("tok", F.lit(1), F.lit(2)), " "))
    occ = tx.phrase_count(F.lower("text"), F.col("phrase"))
    return t.select("url", "phrase", occ.alias("occurrences"), tx.density(occ, tx.phrase_words(F.col("phrase")), F.size("tok")).alias("density"))


def x16(d):
    s = opportunity_score(F.col("impressions"), F.col("ctr"), F.col("position"))
    return d.query_page().select("site", "query", "url", s.alias("score"), opportunity_band(s).alias("band"))


def _replies(d):
    """Replies of a page judge, one per document pair key, in the shapes seen in practice."""
    t = d.table("documents").select("doc_id", "lang", "source", "n_chars")
    obj = F.concat(F.lit('{"verdict": "'), F.when(F.col("n_chars") < 1000, "raso").otherwise("ok"), F.lit('", "base_recomendada": "p'), "doc_id",
                   F.lit('", "lacunas": ["a,}", "'), "source", F.lit('"], "resumo": "r '), "lang", F.lit('"'))
    k = F.col("n_chars") % 4
    reply = F.when(k == 0, F.concat(obj, F.lit("}"))).when(k == 1, F.concat(F.lit("Claro!\n```json\n"), obj, F.lit(",}\n```\nfim"))).when(
        k == 2, F.concat(F.lit("sem objeto "), "lang")).otherwise(F.concat(obj, F.lit(" e depois } nada")))
    return t.select(F.lit("all").alias("site"), F.col("doc_id").cast("string").alias("cluster"), reply.alias("reply"))


def x21(d):
    body = tx.model_json(F.col("reply"))
    return _replies(d).select("cluster", F.get_json_object(body, "$.verdict").alias("verdict"), F.get_json_object(body, "$.lacunas[0]").alias("first_gap"), body.isNotNull().alias("parsed"))


def _candidates(d):
    """Brand candidates: customers as entities of the shop of their nation."""
    t = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    domain = F.concat(F.lit("www."), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".example"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.replace("n_name", F.lit("_"), F.lit(" "))).when(F.col("c_mktsegment") == "MACHINERY", F.concat("n_name", F.lit(" Incorporated"))).otherwise(F.col("c_name"))
    url = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("https://www."), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".org/x"))).otherwise("")
    return t.select(F.col("n_name").alias("site"), domain.alias("domain"), name.alias("name"), url.alias("url"), F.col("c_acctbal").alias("score"))


def x23(d):
    b = ux.brand_from_domain(F.col("domain"))
    return _candidates(d).select("site", "name", "score", b.alias("brand"), ux.plausible_entity(b, F.col("name"), F.col("url"), F.col("domain")).alias("plausible"))


def x25(d):
    ttl = F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.lit(h).alias("ttl")) for k, h in TTL_HOURS.items()]))
    return d.stored_results().select("cached_at", ttl.alias("t")).groupBy(F.col("t.source").alias("source")).agg(
        F.count_if(is_fresh(F.col("cached_at"), _as_of(), F.col("t.ttl"))).alias("fresh"), F.count("*").alias("stored"))


# ---- joins ------------------------------------------------------------------------------------------

def _ghosts(d):
    return pruning.ghost_urls(d.page_metrics(), d.sitemap())


def _olds(d):
    return pruning.ghosts_and_exports(d.page_metrics(), d.sitemap(), d.export_list())


def j05(d):
    return pruning.sitemap_keys(d.sitemap())


def j12(d):
    return links.template_inbound(d.list_emitters(), d.list_members(), d.known_pages())


def j16(d):
    rows = d.position_rows().withColumn("date", F.lit(AS_OF).cast("date"))
    t = hist.with_content(rows, d.verdicts())
    return t.select("site", "date", "url", "position", "clicks", "impressions", COL("content.verdict").alias("verdict"), COL("content.words").alias("words"), COL("content.density").alias("density"))


def j18(d):
    return hist.refresh_worklist(d.page_metrics(), d.stored_results(), F.lit("2024-01-31").cast("timestamp"), TTL_HOURS["inspection"])


def _results_of(d, odd: int):
    """Results stored in even minutes, or new ones of odd minutes: the last of each day."""
    r = d.stored_results().filter(F.minute("cached_at") % 2 == odd)
    last = r.groupBy("site", F.to_date("cached_at").alias("date"), "url").agg(F.max(F.struct("cached_at", "failed")).alias("r"))
    return last.select("site", "date", "url", "r.cached_at", "r.failed")


# ---- similarity ---------------------------------------------------------------------------------------

def _members(d):
    v = d.vectors()
    return d.once("members", lambda: cut(sim.cluster_members(v, sim.threshold_clusters(v, NEAR))))


def _enriched(d):
    return d.once("enriched", lambda: cut(sim.members_with_metrics(_members(d), d.slug_metrics())))


def _perf(d):
    return sim.cluster_performance(_enriched(d))


def _priority(d):
    return sim.group_priority(_perf(d))


def _by_text_weights(d, use):
    weights = vec.stored_tfidf(d.texts().select("site", "page", "text"))
    found = use(weights)  # stores what it makes of them
    drop(weights)
    return found


def _texts(d):
    return d.texts().withColumn("site", F.lit("all")).select("site", "page", "text")


def _spokes(d):
    """Groups of link targets by first letter; the most linked one is the hub."""
    m = d.list_members().join(d.known_metrics().select("site", F.col("page").alias("dst"), "impressions"), ["site", "dst"], "left")
    hub = m.groupBy("site", F.col("list").alias("cluster")).agg(F.min_by("dst", F.struct((-F.coalesce("impressions", F.lit(0))).alias("i"), "dst")).alias("hub"))
    return m.select("site", F.col("list").alias("cluster"), F.col("dst").alias("spoke")).join(hub, ["site", "cluster"]).filter("spoke <> hub")


def _page_edges(d):
    """Edges among link targets: a page's links seen from each of its other links, in page order."""
    l = d.links().select("site", "page", "pos", ux.href_slug(F.col("href")).alias("slug")).filter("slug is not null")
    nxt = l.select("site", "page", (F.col("pos") - 1).alias("pos"), F.col("slug").alias("dst"))
    return l.join(nxt, ["site", "page", "pos"]).select("site", F.col("slug").alias("src"), "dst", F.lit("").alias("anchor")).filter("src <> dst")


def _judge(system, user):
    pages = user.count("--- PÁGINA")
    if pages > 5:
        raise ValueError("too many pages")
    return json.dumps({"verdict": "spun" if pages > 2 else "ok", "base_recomendada": "", "lacunas": [str(pages)], "resumo": "x"})


def _planner(system, user):
    slugs = [line.split("(slug: ")[1].split(")")[0] for line in user.splitlines() if line.startswith("--- PÁGINA")]
    plan = {"cabeca": slugs[0] if len(slugs) > 2 else "", "paginas": [{"slug": s, "keyword_alvo": s.replace("-", " ")} for s in slugs]}
    return "```json\n" + json.dumps(plan) + "\n```"


def d01(d):
    rows = ranking.position_summary(d.position_rows()).select("site", "total_urls", "total_clicks")

    def ratio(row):
        if row["site"] == "s3":
            raise ValueError("site unavailable")
        return {"clicks_per_url": round(row["total_clicks"] / row["total_urls"], 3)}

    return portfolio.run_per_site(rows, ratio, "clicks_per_url double")


def d01_tables(d):
    """Clicks and the best URL of every site from its own metric rows; one site fails, one has no rows."""
    sites = d.page_metrics().select("site").distinct().unionByName(d.table("region").select(F.concat(F.lit("novo-"), F.col("r_regionkey")).alias("site")).filter("site = 'novo-1'"))

    def best(site, batches):
        clicks, urls, top = 0, 0, None
        for b in batches:
            for r in b.select(["url", "clicks"]).to_pylist():
                clicks, urls = clicks + r["clicks"], urls + 1
                top = min(top, (-r["clicks"], r["url"])) if top else (-r["clicks"], r["url"])
        if site == "s3":
            raise ValueError("site unavailable")
        return {"urls": urls, "clicks": clicks, "best_url": top and top[1]}

    return portfolio.run_over_sites(sites, d.page_metrics().select("site", "url", "clicks"), best, "urls long, clicks long, best_url string")


def s05_files(d):
    folder = f"{run_folder(d.spark)}/sitemaps-{uuid.uuid4().hex}"
    sm.land_sitemaps(d.sitemap_docs(), folder)
    return sm.sitemap_urls(sm.read_sitemaps(d.spark, folder)).select("site", "url", "doc", "pos")


def _plan_and_conflicts(d):
    members = _members_of_groups(d)
    numbered = cons.number_members(members)
    states = cons.url_states(members, numbered)
    return cons.consolidation_plan(members, states, place=True), cons.consolidation_conflicts(members, states, numbered)


def k07_files(d):
    """Rule files of the redirect plan as they lie on disk: each line with its number in the file."""
    folder = f"{run_folder(d.spark)}/rules-{uuid.uuid4().hex}"
    reports.write_rules(reports.redirect_rules(_plan_and_conflicts(d)[0]), folder)
    text = d.spark.read.text(folder, wholetext=True)
    lines = text.select(F.col("site_dir").alias("site"), F.col("file").alias("format"), F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("n", "line"))
    return lines


def m02(d):
    pages = d.texts().select("site", "page", "text")
    seen = vec.hashed(pages, "m", "b").join(d.table("labels").select(d.slug_of(F.col("doc_id")).alias("page")), "page", "left_semi")
    kept = seen.select("site", "page", "hash", F.array(F.lit(0.0), F.length("text").cast("double")).alias("vec"))
    out = vec.incremental_embeddings(pages, kept, lambda texts: [(1.0, float(len(t))) for t in texts], "m", "b")
    return out.select("site", "page", "hash", "reused", F.element_at("vec", 1).alias("v1"), F.element_at("vec", 2).alias("v2"))


def _members_of_groups(d):
    return ranking.cannibalization_members(d.query_page())


def _health(d):
    return ranking.health_score(d.position_rows(), ranking.indexing_summary(ranking.newest_report(d.inspections())))


def _run_summary(d):
    rows = d.position_rows()
    sites = rows.select("site").distinct().unionByName(d.table("region").select(F.concat(F.lit("fora-"), F.lower("r_name")).alias("site")))
    return portfolio.site_run_summary(sites, ranking.position_summary(rows), _health(d), ranking.cannibalization(d.query_page()), d.verdicts(), d.history())


def _plan(d):
    return pruning.pruning_plan(d.page_metrics(), d.sitemap(), d.query_page(), d.export_list())


def _reviewed(d):
    return rp.reviewed_plan(d.plan_lines())


def _trends(d):
    return trends.date_trends(trends.daily_series(d.site_daily(), d.query_daily()))


def _depth(d):
    return ent.depth_scores(d.texts(), d.entities(), d.categories())


def w06(d):
    t = d.texts().select("url", tx.tokenize(tx.fold_text(F.col("text"))).alias("w")).select("url", tx.dominant_ngram(F.col("w")).alias("g"))
    return t.select("url", "g").filter("g is not null").select("url", COL("g.phrase").alias("phrase"), COL("g.cnt").alias("occurrences"))


def k03(d):
    def period(t):
        return t.withColumns({"period_start": F.date_sub("date", 27), "period_end": F.col("date")})

    h = period(d.history())
    today = d.position_rows().withColumn("date", F.lit("2001-03-01").cast("date"))
    snap = period(hist.with_content(today, d.verdicts()))
    return hist.upsert_snapshot(h, snap.select(*h.columns)).select("site", "date", "period_start", "period_end", "url", "position", "clicks", "impressions", COL("content.verdict").alias("verdict"))


def _diff_plan(d):
    return prompts.differentiation_plan(prompts.score_prompts(prompts.differentiation_prompts(_priority(d), _enriched(d), _texts(d)), _planner), _enriched(d))


def _hub_choice(d):
    plan = d.once("diff_plan", lambda: cut(_diff_plan(d)))
    return links.hub_choice(_members(d), _perf(d), plan)


def j12_emitters(d):
    """Pages whose markup ends in a template part by page number, and the file some of them include."""
    part = F.element_at(F.array(*[F.lit(x) for x in (
        "<?php foreach ($blog as $l) { echo formatStringToURL($l); } ?>", "<?php foreach (array_slice($artigos, 0, 3) as $x) { echo formatStringToURL($x); } ?>",
        "<?php $mais = $artigos; $r = array_rand($mais, 4); echo formatStringToURL($mais[$r]); ?>", '<?php include_once("./include/more.php"); ?>',
        "<?php foreach ($blog as $l) { echo $l; } ?>", "<?php include 'include/more.php'; foreach ($blog as $l) { echo formatStringToURL($l); } $x = $outro; array_slice($x, 1); ?>")]),
        (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    markup = d.table("pages").select(F.lit("all").alias("site"), F.col("page_id").cast("string").alias("page"), F.concat("html", part).alias("markup"))
    files = d.table("region").filter("r_regionkey = 0").select(F.lit("all").alias("site"), F.lit("include/more.php").alias("path"), F.lit("<?php array_rand($blog, 4); formatStringToURL($artigos); array_slice($artigos, 2);").alias("text"))
    lists = d.table("region").filter("r_regionkey < 2").select(F.lit("all").alias("site"), F.when(F.col("r_regionkey") == 0, "blog").otherwise("artigos").alias("list"))
    return links.list_emitters(markup, files, lists)


QUERIES = {
    # 2.1 sources
    "S01_page_metrics": lambda d: metrics.page_metrics(d.landing_pages()),
    "S02_query_page_metrics": lambda d: metrics.query_page_metrics(d.landing_queries()),
    "S03_daily_metrics": lambda d: metrics.daily_metrics(d.query_daily(), "query"),
    "S04_report_window": lambda d: metrics.in_report_window(d.site_daily(), F.lit(AS_OF).cast("date"), 14),
    "S05_sitemap_urls": s05,
    "S05_sitemap_files": s05_files,
    "S06_robots_sitemap": s06,
    "S07_folder_pages": s07,
    "S08_folder_sources": s08,
    "S09_listed_pages": s09,
    "S10_site_list": s10,
    "S11_export_urls": lambda d: d.export_list().select("site", "url"),
    "S12_reviewed_plan": lambda d: _reviewed(d).select("site", "n", "url", "action", "target", "status", "reason"),
    "S13_snapshot_metrics": s13,
    "S14_latest_artifact": s14,
    "S15_history_scan": s15,
    # 2.2 sinks
    "K01_indexing_report": lambda d: reports.indexing_rows(d.inspections()),
    "K02_position_report": lambda d: reports.position_csv_rows(d.position_rows()),
    "K03_history_upsert": k03,
    "K04_indexing_history_append": lambda d: reports.indexing_snapshot(ranking.indexing_summary(d.inspections(), "date")),
    "K05_redirect_csv": lambda d: reports.redirect_csv_rows(cons.consolidation_plan(_members_of_groups(d))),
    "K06_pruning_csv": lambda d: reports.pruning_csv_rows(_plan(d)),
    "K05_redirect_csv_lines": lambda d: reports.redirect_csv_lines(*_plan_and_conflicts(d)).select(F.col("site_dir").alias("site"), "part", F.col("value").alias("line")),
    "K07_rule_files": k07_files,
    "K07_redirect_rules": lambda d: reports.redirect_rules(cons.consolidation_plan(_members_of_groups(d))),
    "K08_removal_rules": lambda d: reports.removal_rules(_reviewed(d)),
    "K09_portfolio_csv": lambda d: reports.portfolio_rows(_run_summary(d)),
    "K10_site_partition_name": k10,
    # 2.3 scalar functions in their host jobs
    "X01_normalize_domain": lambda d: _domains(d).select("domain", ux.normalize_domain(F.col("domain")).alias("bare")),
    "X02_site_url": lambda d: _domains(d).select("domain", ux.site_url(F.col("domain")).alias("site_url")),
    "X03_match_key": lambda d: _odd_urls(d).select("url", ux.match_key(F.col("url")).alias("match_key")),
    "X04_url_path_query": lambda d: _odd_urls(d).select("url", ux.url_path_query(F.col("url")).alias("path")),
    "X05_homepage": x05,
    "X06_brand_query": x06,
    "X07_slug_phrase": lambda d: d.sitemap().select("site", "url", ux.slug_phrase(F.col("url")).alias("phrase")),
    "X07_slugify": lambda d: d.table("documents").select("doc_id", tx.slugify(F.col("text")).alias("slug")),
    "X08_slug_from_url": lambda d: d.sitemap().select("site", "url", ux.slug_from_url(F.col("url")).alias("slug")),
    "X09_href_slug": lambda d: d.links().select("page", "pos", "href", ux.href_slug(F.col("href")).alias("slug")),
    "X10_fold_accents": lambda d: d.table("documents").select("doc_id", tx.fold_accents(F.col("text")).alias("folded"), tx.ascii_fold(F.col("text")).alias("plain")),
    "X10_fold_other_letters": x10_odd,
    "X11_normalize_keyword": lambda d: kw.keyword_items(d.keyword_plan()).select("slug", "norm", F.array_join("tokens", " ").alias("tokens")),
    "X12_word_count": lambda d: d.texts().select("url", F.size(tx.tokenize(F.col("text"))).alias("words")),
    "X13_keyword_density": x13,
    "X14_vocab_diversity": lambda d: d.texts().select("url", tx.vocab_diversity(tx.tokenize(F.col("text"))).alias("diversity")),
    "X15_expected_ctr": lambda d: d.query_page().select("site", "query", "url", F.round(expected_ctr(F.col("position")), 6).alias("expected")),
    "X16_opportunity_score": x16,
    "X17_position_band": lambda d: d.query_page().select("site", "query", "url", band_label(F.col("position")).alias("band"), band_action(F.col("position")).alias("action")),
    "X18_extract_text": lambda d: d.markup().select("page", tx.extract_text(F.col("markup")).alias("text")),
    "X19_main_content": lambda d: d.markup().select("page", tx.main_content(F.col("markup"), noisy_sections=(("div", "ad"),)).alias("text")),
    "X20_extract_links": lambda d: d.links(),
    "X21_parse_model_json": x21,
    "X22_verdict_category": lambda d: d.inspections().select("site", "url", verdict_category(F.col("verdict")).alias("category")),
    "X23_brand_match": x23,
    "X24_query_terms": lambda d: d.keyword_plan().select("slug", F.array_join(F.array_sort(tx.query_terms(F.col("keyword"))), " ").alias("terms")),
    "X25_freshness": x25,
    "X26_content_hash": lambda d: vec.hashed(d.texts(), "m", "b").select("page", "hash"),
    # 2.4 filters
    "F01_pages_without_impressions": lambda d: ranking.pages_without_impressions(d.position_rows()),
    "F02_opportunity_urls": lambda d: ranking.opportunity_urls(d.position_rows()).select("site", "url", "position", "impressions", "rank"),
    "F03_component_alerts": lambda d: ranking.component_alerts(_health(d), 60.0, 50.0),
    "F04_underlinked_pages": lambda d: links.underlinked_pages(links.inlink_report(d.known_pages(), d.edges(), d.known_metrics()), max_inlinks=4),
    "F05_entity_filter": lambda d: d.entities(),
    "F05_category_filter": lambda d: d.categories(),
    # 2.5 joins
    "J01_sitemap_x_metrics": lambda d: d.position_rows(),
    "J02_ghost_urls": _ghosts,
    "J03_target_by_shared_query": lambda d: pruning.targets_by_query(_ghosts(d), d.query_page(), d.sitemap()),
    "J04_target_by_slug": lambda d: pruning.targets_by_slug(_olds(d), d.sitemap()),
    "J05_canonical_sitemap_form": j05,
    "J06_ghost_x_queries": lambda d: pruning.top_ghost_queries(_ghosts(d), d.query_page()).select("site", "match_key", F.array_join("top_queries", "|").alias("top_queries")),
    "J07_target_keywords": lambda d: content.target_keywords(d.query_page()).select("site", "url", F.array_join("keywords", "|").alias("keywords")),
    "J08_cluster_x_metrics": _perf,
    "J09_link_resolution": lambda d: d.edges(),
    "J10_link_orphans": lambda d: links.link_orphans(d.known_pages(), _page_edges(d)),
    "J11_hub_spoke_gaps": lambda d: links.hub_spoke_gaps(links.hub_spoke_links(_spokes(d), _page_edges(d))),
    "J11_hub_spoke_links": lambda d: links.hub_spoke_links(_spokes(d), _page_edges(d)),
    "J11_hub_choice": _hub_choice,
    "J12_template_inbound": j12,
    "J12_list_emitters": j12_emitters,
    "J13_keyword_near_match": lambda d: kw.near_collisions(kw.keyword_items(d.keyword_plan())),
    "J13_near_sets": lambda d: kw.near_sets(kw.keyword_items(d.keyword_plan())).select("site", F.array_join("left", " ").alias("left"), F.array_join("right", " ").alias("right")),
    "J14_content_gaps": lambda d: ent.content_gaps(d.texts(), d.entities(), d.query_page()),
    "J15_trend_x_best_position": lambda d: trends.trend_positions(_trends(d), d.query_page().withColumn("query", F.replace("query", F.lit("kw "), F.lit("k")))),
    "J16_content_x_history": j16,
    "J17_brand_entity": lambda d: ent.brand_entity(_candidates(d)),
    "J18_refresh_worklist": j18,
    "J18_upsert_results": lambda d: hist.upsert_results(_results_of(d, 0), _results_of(d, 1)),
    "J19_sparse_pairs": lambda d: _by_text_weights(d, lambda w: sparse.sparse_cosine_pairs(w, TEXT_NEAR)).withColumn("sim", F.round("sim", 6)),
    "J19_cosine_pairs": lambda d: sim.cosine_pairs(sim.distinct_vectors(d.vectors()), NEAR).select("site", "a", "b", F.round("sim", 6).alias("sim")),
    # 2.6 aggregations
    "A01_position_summary": lambda d: ranking.position_summary(d.position_rows()),
    "A02_indexing_summary": lambda d: ranking.indexing_summary(d.inspections()),
    "A03_position_component": lambda d: ranking.position_component(d.position_rows()),
    "A04_ctr_component": lambda d: ranking.ctr_component(d.position_rows()),
    "A05_health_score": _health,
    "A06_cannibalization": lambda d: ranking.cannibalization(d.query_page()),
    "A06_cannibalization_members": _members_of_groups,
    "A07_band_distribution": lambda d: ranking.band_distribution(d.position_rows()),
    "A08_cluster_cohesion": lambda d: _members(d).select("site", "cluster", "cohesion").distinct(),
    "A09_cluster_representative": lambda d: _members(d).select("site", "cluster", "representative").distinct(),
    "A10_inlink_report": lambda d: links.inlink_report(d.known_pages(), d.edges(), d.known_metrics()),
    "A11_anchor_collisions": lambda d: links.anchor_collisions(d.edges()),
    "A12_link_tier": lambda d: links.link_tiers(d.known_pages(), _page_edges(d), j12(d)),
    "A12_tier_counts": lambda d: links.tier_counts(links.link_tiers(d.known_pages(), _page_edges(d), j12(d))),
    "A13_exact_keyword_collisions": lambda d: kw.exact_collisions(kw.keyword_items(d.keyword_plan())),
    "A14_topical_pillars": lambda d: ent.topical_pillars(d.entities()),
    "A15_entity_type_distribution": lambda d: ent.type_distribution(d.entities()),
    "A15_entity_type_matrix": lambda d: ent.type_matrix(d.entities(), ("PERSON", "LOCATION", "ORGANIZATION", "OTHER", "CONSUMER_GOOD")),
    "A16_depth_score": lambda d: _depth(d).select("site", "url", "n_entities", "n_categories", "score", "grade"),
    "A17_entity_recommendations": lambda d: ent.entity_recommendations(_depth(d)).withColumn("advice", F.array_join("advice", ",")),
    "A18_entity_site_summary": lambda d: ent.entity_site_summary(_depth(d), d.entities()),
    "A19_site_run_summary": _run_summary,
    "A20_entity_signals": lambda d: d.signals().withColumn("top_names", F.array_join("top_names", ",")),
    "A21_top_keywords": lambda d: ranking.top_keywords(d.query_page()),
    "A22_home_redirect_warning": lambda d: pruning.home_redirect_warning(_reviewed(d)),
    "A23_content_verdict": lambda d: d.verdicts().withColumn("flags", F.array_join("flags", ",")),
    "A24_group_totals": lambda d: sim.group_totals(_perf(d)),
    "A25_pruning_totals": lambda d: pruning.pruning_totals(_plan(d)),
    # 2.7 windows and series
    "W01_trend_thirds": lambda d: trends.trend_thirds(trends.daily_series(d.site_daily(), d.query_daily(), metric="clicks")).select(
        "site", "series", "trend", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean")),
    "W02_date_trends": lambda d: _trends(d).drop("dates", "values"),
    "W03_short_trend": lambda d: trends.short_trend(trends.daily_series(d.site_daily(), d.query_daily())),
    "W04_content_tracking": lambda d: hist.content_tracking(d.history()),
    "W04_content_snapshots": lambda d: hist.content_snapshots(d.history()),
    "W05_history_pivot": lambda d: hist.history_pivot(d.history()),
    "W06_dominant_ngram": w06,
    "W07_history_top_series": lambda d: hist.history_top_series(d.history()),
    "W08_trend_chart_series": lambda d: trends.trend_chart(_trends(d)).select("site", "rank", "series", "label", F.explode(F.arrays_zip("dates", "values")).alias("p")).select(
        "site", "rank", "series", "label", COL("p.dates").alias("date"), COL("p.values").alias("value")),
    "W08_trend_latest": lambda d: trends.trend_latest(_trends(d)),
    # 2.8 ordering and sets
    "L01_nearest_pairs": lambda d: sim.nearest_pairs(d.vectors()),
    "L02_group_priority": _priority,
    "L03_opportunity_ranking": lambda d: ranking.opportunity_ranking(d.position_rows()),
    "L04_band_listing": lambda d: ranking.band_listing(d.position_rows()),
    "L05_group_listing": lambda d: ranking.group_listing(_members_of_groups(d)),
    "L06_verdict_listing": lambda d: content.verdict_listing(d.verdicts()),
    "U01_ghosts_union_exports": _olds,
    "U02_sitemap_union_distinct": lambda d: sm.first_seen(
        d.sitemap().select("site", F.lit(0).alias("d"), F.col("pos").alias("n"), "url"),
        d.page_metrics().select("site", F.lit(1).alias("d"), F.col("impressions").alias("n"), "url")),
    "U03_term_intersect_except": lambda d: ent.term_sets(d.texts(), d.entities(), d.query_page()).select(
        "site", "url", F.array_join("covered", " ").alias("covered"), F.array_join("gaps", " ").alias("gaps")),
    # 2.9 graph and plans
    "G01_threshold_components": lambda d: sim.threshold_clusters(d.vectors(), NEAR),
    "G01_text_components": lambda d: _by_text_weights(d, lambda w: sparse.sparse_clusters(d.texts(), w, TEXT_NEAR)),
    "G02_linkage_clusters": lambda d: sim.linkage_clusters(d.vectors(), NEAR),
    "G02_average_linkage": lambda d: sim.linkage_clusters(d.vectors(), NEAR, "average"),
    "G03_build_clusters": lambda d: sim.cluster_table(_members(d)),
    "G04_consolidation_plan": lambda d: cons.consolidation_plan(_members_of_groups(d)),
    "G04_consolidation_conflicts": lambda d: cons.consolidation_conflicts(_members_of_groups(d)),
    "G04_consolidation_totals": lambda d: cons.consolidation_totals(cons.consolidation_plan(_members_of_groups(d))),
    "G05_pruning_plan": lambda d: _plan(d).withColumn("top_queries", F.array_join("top_queries", "|")),
    # 2.10 text features and hand-off
    "M01_tfidf_vectors": lambda d: vec.tfidf(d.texts().select("site", "page", "text")).withColumn("weight", F.round("weight", 6)),
    "M02_incremental_embeddings": m02,
    "M03_judgement_prompts": lambda d: prompts.judgement_prompts(_priority(d), _enriched(d), _texts(d)),
    "M04_judgements": lambda d: prompts.judgements(_replies(d)).withColumn("gaps", F.array_join("gaps", "|")),
    "M05_differentiation_prompts": lambda d: prompts.differentiation_prompts(_priority(d), _enriched(d), _texts(d)),
    "M06_differentiation_plan": _diff_plan,
    "M06_keyword_items": lambda d: kw.keyword_items(prompts.planned_keywords(_diff_plan(d), _perf(d))).select("site", "cluster", "slug", "keyword", "impressions", "norm"),
    "M06_omitted_pages": lambda d: prompts.omitted_pages(_priority(d), _enriched(d), max_pages=3),
    # 2.11 user functions
    "D01_per_site_function": d01,
    "D01_site_tables": d01_tables,
    "D02_scorer_plugin": lambda d: prompts.score_prompts(prompts.judgement_prompts(_priority(d), _enriched(d), _texts(d)), _judge),
}
