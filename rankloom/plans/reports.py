"""The reference runs as Spark jobs over all sites at once: tables in, named result tables out.

Frames that several results share are written once (``cut``); everything else stays lazy, so a caller
who wants one table pays for that table.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.operators import consolidation, content, entities, history, keywords, links, portfolio, prompts, pruning, ranking, similarity, trends
from rankloom.sinks import reports
from rankloom.sources.reviewed_plan import reviewed_plan


@dataclass
class SearchTables:
    """Inputs of the ranking report; schemas are in ``rankloom.schemas``."""

    sitemap: DataFrame
    metrics: DataFrame
    query_page: DataFrame
    site_daily: DataFrame
    query_daily: DataFrame
    inspections: DataFrame
    history: DataFrame
    texts: DataFrame
    entities_raw: DataFrame
    categories_raw: DataFrame


def ranking_report(t: SearchTables, date: str, content_pages: int | None = 8) -> dict[str, DataFrame]:
    """Positions, health, cannibalization with its redirect plan, trends, content, and the new history.

    The snapshot of ``date`` is built after the content results, which it carries. ``content_pages``: content is analysed for so many of a
    site's best opportunity pages, None for all its pages.
    """
    rows = cut(ranking.position_rows(t.sitemap, t.metrics))
    indexing = ranking.indexing_summary(ranking.newest_report(t.inspections))
    health = cut(ranking.health_score(rows, indexing))
    members = cut(ranking.cannibalization_members(t.query_page))
    numbered = consolidation.number_members(members)
    states = consolidation.url_states(members, numbered)
    redirects = consolidation.consolidation_plan(members, states)
    named, topics = entities.entity_filter(t.entities_raw), entities.category_filter(t.categories_raw)
    near = (rows if content_pages is None else ranking.opportunity_urls(rows, content_pages)).select("site", "url")
    signals = content.entity_signals(t.entities_raw.select("site", "url").distinct(), named, topics)
    verdicts = cut(content.content_verdicts(t.texts.join(near, ["site", "url"], "left_semi"), content.target_keywords(t.query_page), signals))
    snapshot = history.with_content(rows.withColumn("date", F.lit(date).cast("date")), verdicts).select(*t.history.columns)
    merged = history.upsert_snapshot(t.history, snapshot)
    demand = cut(trends.date_trends(trends.daily_series(t.site_daily, t.query_daily)))
    groups = ranking.cannibalization(t.query_page)
    summary = ranking.position_summary(rows)
    return {
        "positions": rows, "summary": summary, "health": health, "alerts": ranking.component_alerts(health), "bands": ranking.band_distribution(rows),
        "opportunities": ranking.opportunity_ranking(rows), "without_impressions": ranking.pages_without_impressions(rows),
        "groups": groups, "redirects": redirects, "conflicts": consolidation.consolidation_conflicts(members, states, numbered), "redirect_rules": reports.redirect_rules(redirects),
        "trends": demand, "trend_positions": trends.trend_positions(demand, t.query_page), "content": content.verdict_listing(verdicts),
        "history": merged, "tracking": history.content_tracking(merged), "pivot": history.history_pivot(merged),
        "portfolio": portfolio.site_run_summary(t.sitemap.select("site"), summary, health, groups, verdicts, merged),
    }


def pruning_report(metrics: DataFrame, sitemap: DataFrame, query_page: DataFrame, exports: DataFrame) -> dict[str, DataFrame]:
    """First half of pruning: the plan a person reviews."""
    plan = cut(pruning.pruning_plan(metrics, sitemap, query_page, exports))
    return {"plan": plan, "totals": pruning.pruning_totals(plan), "csv": reports.pruning_csv_rows(plan)}


def reviewed_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Second half of pruning: the reviewed lines as server rules."""
    plan = cut(reviewed_plan(lines))
    return {"plan": plan, "rules": reports.removal_rules(plan), "warnings": pruning.home_redirect_warning(plan).filter("warning")}


def semantic_report(vectors: DataFrame, slug_metrics: DataFrame, markup: DataFrame, files: DataFrame, list_members: DataFrame,
                    threshold: float = 0.85, method: str = "threshold", linkage: str = "complete", plan: DataFrame | None = None) -> dict[str, DataFrame]:
    """Near-duplicate groups and the link audit. Links come from all pages; audits cover the pages with a vector.

    ``files`` are the template files that pages include, ``plan`` a differentiation plan: it chooses hubs and is searched for keyword collisions.
    """
    found = similarity.threshold_clusters(vectors, threshold) if method == "threshold" else similarity.linkage_clusters(vectors, threshold, linkage)
    members = cut(similarity.cluster_members(vectors, cut(found)))
    enriched = similarity.members_with_metrics(members, slug_metrics)
    perf = cut(similarity.cluster_performance(enriched))
    pages = vectors.select("site", "page")
    edges = cut(links.link_edges(links.extract_links(markup), markup.select("site", "page")))
    inlinks = links.inlink_report(pages, edges, slug_metrics)
    spokes = links.hub_choice(members, perf, plan)
    emitters = links.list_emitters(markup, files, list_members.select("site", "list"))
    inbound = links.template_inbound(emitters, list_members, pages)
    collisions = {} if plan is None else {"collisions": keyword_report(prompts.planned_keywords(plan, perf))}
    return collisions | {
        "clusters": similarity.cluster_table(members), "performance": perf, "totals": similarity.group_totals(perf), "nearest": similarity.nearest_pairs(vectors),
        "priority": similarity.group_priority(perf), "edges": edges, "orphans": links.link_orphans(pages, edges), "inlinks": inlinks,
        "underlinked": links.underlinked_pages(inlinks), "anchors": links.anchor_collisions(edges), "tiers": links.link_tiers(pages, edges, inbound),
        "hub_gaps": links.hub_spoke_gaps(links.hub_spoke_links(spokes.select("site", "cluster", "hub", "spoke"), edges)),
    }


def keyword_report(plan: DataFrame) -> DataFrame:
    """Exact and near collisions of a differentiation plan, most impressions first."""
    items = cut(keywords.keyword_items(plan))
    exact = keywords.exact_collisions(items).drop("norm")
    return exact.unionByName(keywords.near_collisions(items)).orderBy("site", F.desc("impr_total"), "keyword")
