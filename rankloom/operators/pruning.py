"""Pruning plan: URLs that still get searches but left the sitemap, with a suggested redirect target."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.urls import (
    brand_compact, host, is_brand_query, is_home, match_key, root_of, slug_words,
)
from rankloom.functions.wordlists import ORIGIN_EXPORT, ORIGIN_SEARCH
from rankloom.lineage import cut
from rankloom.operators.setjoin import jaccard_pairs

REVIEW_IMPRESSIONS = 10
TOP_QUERIES = 3
SLUG_JACCARD = 0.5


def sitemap_keys(sitemap: DataFrame) -> DataFrame:
    """J05. One row per match key with the sitemap's own spelling (its last one)."""
    return sitemap.withColumn("match_key", match_key(F.col("url"))).groupBy("site", "match_key").agg(
        F.max_by("url", "pos").alias("sitemap_url")
    )


def ghost_urls(metrics: DataFrame, sitemap: DataFrame) -> DataFrame:
    """J02. URLs with metrics whose match key is in no sitemap."""
    return metrics.withColumn("match_key", match_key(F.col("url"))).join(
        sitemap_keys(sitemap), ["site", "match_key"], "left_anti"
    ).select("site", "url", "match_key", "clicks", "impressions", "ctr", "position")


def ghosts_and_exports(metrics: DataFrame, sitemap: DataFrame, exports: DataFrame) -> DataFrame:
    """U01. Ghosts plus exported URLs that neither the sitemap nor the ghosts know."""
    keys = ["site", "match_key"]
    ghosts = cut(ghost_urls(metrics, sitemap).withColumn("origin", F.lit(ORIGIN_SEARCH)))
    # keys are made once a row, not again in the filters of the joins
    first = cut(exports.select("site", "url", "pos", match_key(F.col("url")).alias("match_key"))).groupBy(*keys).agg(F.min_by("url", "pos").alias("url"))
    extra = first.join(sitemap_keys(sitemap), keys, "left_anti").join(ghosts.select(*keys), keys, "left_anti").select(
        "site", "url", "match_key", F.lit(0).cast("long").alias("clicks"), F.lit(0).cast("long").alias("impressions"),
        F.lit(0.0).alias("ctr"), F.lit(None).cast("double").alias("position"), F.lit(ORIGIN_EXPORT).alias("origin"),
    )
    return ghosts.unionByName(extra)


def home_pages(sitemap: DataFrame) -> DataFrame:
    """X05. First home URL of the sitemap, else the root of its first URL."""
    u = F.col("url")
    return sitemap.groupBy("site").agg(
        F.coalesce(
            F.min_by(F.when(is_home(u), u), F.when(is_home(u), F.col("pos"))), root_of(F.min_by("url", "pos"))
        ).alias("home_url")
    )


def site_brands(sitemap: DataFrame) -> DataFrame:
    """X06. Brand of a site from its first URL with a host."""
    has_host = host(F.col("url")) != ""
    return sitemap.filter(has_host).groupBy("site").agg(brand_compact(F.min_by("url", "pos")).alias("brand"))


def stored_log(query_page: DataFrame) -> DataFrame:
    """The columns of the query log that the plan needs, written once: the log is itself added up from more rows."""
    return cut(query_page.select("site", "query", "url", "clicks", "impressions"))


def url_keys(query_page: DataFrame) -> DataFrame:
    """(site, url, match_key, u, k) of the URLs in the query log, written once: the log has many rows a URL, and a
    key filter that the optimizer moves into the log's scan would be computed on each of them. ``u`` numbers the URLs in the order
    of site and URL, ``k`` is the number of the first URL with the same match key; pairs of ghosts and pages are pairs of these."""
    urls = cut(query_page.select("site", "url").distinct()).withColumn("match_key", match_key(F.col("url")))
    numbered = cut(urls.repartitionByRange("site", "url").sortWithinPartitions("site", "url").withColumn("u", F.monotonically_increasing_id()))
    return cut(numbered.join(numbered.groupBy("site", "match_key").agg(F.min("u").alias("k")), ["site", "match_key"]))


def ghost_queries(ghosts: DataFrame, query_page: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """J06. Query rows of the ghosts, met by match key."""
    if keys is None:
        query_page = stored_log(query_page)
        keys = url_keys(query_page)
    wanted = keys.join(ghosts.select("site", "match_key").distinct(), ["site", "match_key"], "left_semi")
    return query_page.join(wanted, ["site", "url"])


def top_ghost_queries(ghosts: DataFrame, query_page: DataFrame, top: int = TOP_QUERIES, keys: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """J06. The few biggest queries of each ghost, as an ordered array. ``rows`` are its ghost_queries where they are stored."""
    w = Window.partitionBy("site", "match_key").orderBy(F.desc("impressions"), "query", "url")
    rows = ghost_queries(ghosts, query_page, keys) if rows is None else rows
    ranked = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.groupBy("site", "match_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "query"))), lambda x: x["query"]).alias("top_queries")
    )


def targets_by_query(ghosts: DataFrame, query_page: DataFrame, sitemap: DataFrame, keys: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """J03. Per ghost the live page that shares the most of its query impressions.

    Score of (ghost, page) = sum over shared non-brand queries of ghost impressions + 1, ties by the
    page's clicks on them, then URL. Of the pages that share one query only with a ghost, the first of that query's pages is the best, so it
    stands for all, and the best of these is what others must beat. A page that shares two or more is met at the rarer of them: a ghost's
    queries are gone through from few pages to many, never its last one, and only while all that is still open reaches
    that bound. So a query that many ghosts and pages share pairs them only where it is not a ghost's commonest one and could decide.
    """
    if keys is None:
        query_page = stored_log(query_page)
        keys = url_keys(query_page)
    rows = ghost_queries(ghosts, query_page, keys) if rows is None else rows
    g, a = cut(_ghost_side(rows, sitemap)), cut(_page_side(query_page, sitemap, keys))
    q, pair = ["site", "query"], ["k", "u"]
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("c")).alias("c"), "u"))
    met = g.join(a.groupBy(*q).agg(first.alias("first"), F.count("*").alias("pages")), q).withColumn("most", F.col("w") * -F.col("first.n"))
    own = Window.partitionBy("k")
    order = own.orderBy("pages", "query")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumns({"bound": F.max("most").over(own), "open": F.sum("most").over(own) - before, "more": F.lead("query").over(order).isNotNull()})
    met = cut(met.withColumn("probed", F.col("more") & (F.col("open") >= F.col("bound"))))
    singles = met.select("k", "first.u", F.col("most").alias("score"), (F.col("m") * -F.col("first.c")).alias("pair_clicks"))
    points = [F.sum(F.col("w") * F.col("n")).alias("score"), F.sum(F.col("m") * F.col("c")).alias("pair_clicks")]
    found = met.filter("probed").select(*q, "k", "w", "m").join(a, q).groupBy(*pair).agg(*points)
    limits = met.groupBy("k").agg(F.max("bound").alias("bound"), F.sum(F.when(~F.col("probed"), F.col("most")).otherwise(0)).alias("rest"))
    hopeful = cut(found.join(limits, "k").filter(F.col("score") + F.col("rest") >= F.col("bound")).select(*pair, "score", "pair_clicks"))
    rest = met.filter("not probed").select(*q, "k", "w", "m")
    added = hopeful.select(*pair).join(rest, "k").join(a, [*q, "u"]).groupBy(*pair).agg(*points)
    whole = hopeful.unionByName(added).groupBy(*pair).agg(F.sum("score").alias("score"), F.sum("pair_clicks").alias("pair_clicks"))
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("pair_clicks")).alias("c"), "u"))
    chosen = singles.unionByName(whole).groupBy("k").agg(best.alias("b")).select("k", "b.u", (-F.col("b.s")).alias("score"))
    named = keys.filter(F.col("k") == F.col("u")).select("site", "match_key", "k")
    return chosen.join(named, "k").join(keys.select("u", F.col("url").alias("target")), "u").select("site", "match_key", "target", "score")


def _ghost_side(rows, sitemap):
    rows = rows.join(site_brands(sitemap), "site", "left")
    rows = rows.filter(~is_brand_query(F.col("query"), F.col("brand")))
    return rows.groupBy("site", "query", "k").agg(
        F.sum(F.col("impressions") + 1).alias("w"), F.count("*").alias("m")
    )


def _page_side(query_page, sitemap, keys):
    live = keys.filter(~is_home(F.col("url"))).join(sitemap_keys(sitemap).select("site", "match_key"), ["site", "match_key"], "left_semi")
    return query_page.join(live.select("site", "url", "u"), ["site", "url"]).groupBy("site", "query", "u").agg(
        F.sum("clicks").alias("c"), F.count("*").alias("n")
    )


def targets_by_slug(ghosts: DataFrame, sitemap: DataFrame, min_jaccard: float = SLUG_JACCARD) -> DataFrame:
    """J04. Live URL with the most similar slug words; the first in the sitemap wins ties."""
    words = F.array_sort(F.array_distinct(slug_words(F.col("url"))))
    live = cut(cut(sitemap.select("site", "url", "pos", words.alias("tokens"))).filter(F.size("tokens") > 0).groupBy("site", "tokens").agg(
        F.min(F.struct("pos", "url")).alias("first")
    ))
    old = cut(ghosts.select("site", "url", words.alias("tokens"))).filter(F.size("tokens") > 0)  # words are made once a URL
    pairs = jaccard_pairs(old, live, min_jaccard)
    best = pairs.join(live.select("site", F.col("tokens").alias("right"), "first"), ["site", "right"]).groupBy("site", "left").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("first.pos").alias("p"), F.col("first.url").alias("u"))).alias("b")
    )
    return old.select("site", "url", F.col("tokens").alias("left")).join(best, ["site", "left"]).select(
        "site", "url", F.col("b.u").alias("target"), F.round(-F.col("b.s"), 4).alias("score")
    )


def pruning_plan(
    metrics: DataFrame, sitemap: DataFrame, query_page: DataFrame, exports: DataFrame,
    min_impressions: int = REVIEW_IMPRESSIONS, home_fallback: bool = True,
) -> DataFrame:
    """G05. Old URLs with suggested action and target: by query, else by slug, else home for those with traffic."""
    olds = cut(ghosts_and_exports(metrics, sitemap, exports))
    query_page = stored_log(query_page)
    on, log_keys = ["site", "match_key"], url_keys(query_page)
    rows = cut(ghost_queries(olds, query_page, log_keys).select(*on, "k", "query", "url", "impressions"))  # a small part of the log, used twice
    spelled = sitemap_keys(sitemap)

    def in_sitemap_form(targets, by, name):
        keyed = targets.withColumn("tk", match_key(F.col("target")))
        known = spelled.select("site", F.col("match_key").alias("tk"), "sitemap_url")
        return keyed.join(known, ["site", "tk"], "left").select("site", by, F.coalesce("sitemap_url", "target").alias(name))

    by_query = in_sitemap_form(targets_by_query(olds, query_page, sitemap, keys=log_keys, rows=rows), "match_key", "by_query")
    by_slug = in_sitemap_form(targets_by_slug(olds, sitemap), "url", "by_slug")
    traffic = (F.col("clicks") > 0) | (F.col("impressions") >= min_impressions)
    home = F.when(traffic, F.col("home_url")) if home_fallback else F.lit(None).cast("string")
    joined = (
        olds.join(by_query, on, "left").join(by_slug, ["site", "url"], "left")
        .join(top_ghost_queries(olds, query_page, keys=log_keys, rows=rows), on, "left").join(home_pages(sitemap), "site", "left")
    )
    return joined.select(
        "site", "url", "clicks", "impressions", "ctr", "position", "origin",
        F.when(traffic, "revisar").otherwise("410").alias("action"),
        F.coalesce("top_queries", F.array().cast("array<string>")).alias("top_queries"),
        F.coalesce("by_query", "by_slug", home).alias("suggested_target"),
        F.when(F.col("by_query").isNotNull(), "query compartilhada")
        .when(F.col("by_slug").isNotNull(), "slug semelhante")
        .when(home.isNotNull(), "home (fallback)").alias("target_source"),
    )


def pruning_totals(plan: DataFrame) -> DataFrame:
    """A25."""
    return plan.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("action") == "revisar").alias("total_review"),
        F.count_if(F.col("action") == "410").alias("total_410"),
    )


def home_redirect_warning(reviewed: DataFrame, threshold: int = 3) -> DataFrame:
    """A22. Sites whose reviewed plan sends more than ``threshold`` URLs to a home page."""
    to_home = (F.col("status") == "entry") & (F.col("action") == "301") & is_home(F.col("target"))
    return reviewed.groupBy("site").agg(F.count_if(to_home).alias("home_redirects")).withColumn(
        "warning", F.col("home_redirects") > threshold
    )
