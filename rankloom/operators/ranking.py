"""Ranking report: sitemap x metrics, health score, cannibalization, opportunity listings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scoring import (
    band_action, band_label, band_rank, expected_ctr, opportunity_band, opportunity_score,
)
from rankloom.functions.wordlists import CATEGORIES, HEALTH_GRADES, HEALTH_WEIGHTS, NO_DATA_BAND, POSITION_BANDS
from rankloom.lineage import cut

MIN_IMPRESSIONS = 10
MAX_POSITION = 30


def position_rows(sitemap: DataFrame, metrics: DataFrame) -> DataFrame:
    """J01. Every live URL with its metrics; exact URL match."""
    m = metrics.select("site", "url", "clicks", "impressions", "ctr", "position", F.lit(True).alias("hit"))
    return sitemap.select("site", "url").join(m, ["site", "url"], "left").select(
        "site", "url", "position",
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
        F.coalesce("ctr", F.lit(0.0)).alias("ctr"),
        F.coalesce("hit", F.lit(False)).alias("has_data"),
    )


def position_summary(rows: DataFrame) -> DataFrame:
    """A01."""
    seen = F.col("has_data")
    return rows.groupBy("site").agg(
        F.count("*").alias("total_urls"),
        F.count_if(seen).alias("urls_with_data"),
        F.count_if(~seen).alias("urls_no_impressions"),
        F.round(F.avg(F.when(seen, F.col("position"))), 1).alias("avg_position"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.coalesce(F.round(F.avg(F.when(seen, F.col("ctr"))), 2), F.lit(0.0)).alias("avg_ctr"),
    )


def indexing_summary(inspections: DataFrame, *keys: str) -> DataFrame:
    """A02. One row per site (and further keys) and category, zeros included."""
    keys = ("site", *keys)
    counts = inspections.groupBy(*keys).agg(
        F.count("*").alias("total_urls"), *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )
    return counts.unpivot([*keys, "total_urls"], list(CATEGORIES), "category", "total").withColumn(
        "percent", F.round(F.col("total") / F.col("total_urls") * 100, 1)
    )


def _ranked():
    return F.col("has_data") & F.col("position").isNotNull()


def position_component(rows: DataFrame) -> DataFrame:
    """A03."""
    return rows.groupBy("site").agg(_position_component().alias("position_score"))


def _position_component():
    pos, imp = F.when(_ranked(), F.col("position")), F.when(_ranked(), F.col("impressions"))
    mean = F.when(F.sum(imp) > 0, F.sum(pos * imp) / F.sum(imp)).otherwise(F.avg(pos))
    return F.coalesce(F.greatest(F.lit(0.0), F.round(100.0 - (mean - 1.0) * 2.0, 1)), F.lit(0.0))


def ctr_component(rows: DataFrame) -> DataFrame:
    """A04."""
    return rows.groupBy("site").agg(_ctr_component().alias("ctr_score"))


def _ctr_component():
    # least() skips nulls, so rows beyond the benchmark have to be taken out by hand
    expected = expected_ctr(F.col("position"))
    reached = F.when(_ranked() & expected.isNotNull(), F.least(F.lit(1.0), F.col("ctr") / expected))
    return F.coalesce(F.round(F.avg(reached) * 100.0, 1), F.lit(50.0))


def health_score(rows: DataFrame, indexing: DataFrame) -> DataFrame:
    """A05. ``indexing`` is A02 of the newest report; sites without it are scored on the other two parts."""
    parts = rows.groupBy("site").agg(_position_component().alias("position_score"), _ctr_component().alias("ctr_score"))
    indexed = indexing.filter(F.col("category") == "indexed").select("site", F.col("percent").alias("indexation_score"))
    w = HEALTH_WEIGHTS
    rest = w["position"] + w["ctr"]
    full = F.col("indexation_score") * w["indexation"] + F.col("position_score") * w["position"] + F.col("ctr_score") * w["ctr"]
    part = F.col("position_score") * (w["position"] / rest) + F.col("ctr_score") * (w["ctr"] / rest)
    scored = parts.join(indexed, "site", "left").withColumn("score", F.round(F.coalesce(full, part), 1))
    return scored.withColumn("grade", _grade(F.col("score"))).withColumn(
        "has_indexation_data", F.col("indexation_score").isNotNull()
    )


def _grade(score):
    reached = [F.when(score >= bound, F.lit(name)) for bound, name in HEALTH_GRADES if bound is not None]
    return F.coalesce(*reached, F.lit(HEALTH_GRADES[-1][1]))


def component_alerts(health: DataFrame, alert_below: float = 40.0, critical_below: float = 20.0) -> DataFrame:
    """F03."""
    label = {"indexation_score": "Indexação", "position_score": "Posicionamento", "ctr_score": "CTR vs benchmark"}
    long = health.unpivot(["site"], list(label), "component", "value").filter(F.col("value") < alert_below)
    return long.select(
        "site",
        F.regexp_replace("component", "_score$", "").alias("component"),
        F.element_at(F.create_map(*[F.lit(x) for kv in label.items() for x in kv]), F.col("component")).alias("label"),
        "value",
        F.when(F.col("value") < critical_below, "critico").otherwise("alto").alias("severity"),
        F.format_string("%s: %s/100", F.regexp_replace("component", "_score$", ""), F.format_number("value", 1)).alias("message"),
    )


def newest_report(inspections: DataFrame) -> DataFrame:
    """Every site's inspections of its newest date."""
    newest = inspections.groupBy("site").agg(F.max("date").alias("date"))
    return inspections.join(newest, ["site", "date"], "left_semi")


def pages_without_impressions(rows: DataFrame) -> DataFrame:
    """F01."""
    return rows.filter(~F.col("has_data")).select("site", "url", F.lit("Revisar conteúdo ou consolidar").alias("suggestion"))


def opportunity_urls(rows: DataFrame, top: int = 8) -> DataFrame:
    """F02. Positions 4 to 10, most impressions first; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy("site").orderBy(F.desc("impressions"), "url")
    near = rows.filter(F.col("has_data") & F.col("position").between(4, 10))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def competing(query_page: DataFrame, min_impressions=MIN_IMPRESSIONS, max_position=MAX_POSITION) -> DataFrame:
    return query_page.filter(
        (F.col("impressions") >= min_impressions) & (F.col("position") != 0) & (F.col("position") <= max_position)
    )


def cannibalization(query_page: DataFrame, **limits) -> DataFrame:
    """A06. One row per query where two or more URLs of a site compete.

    The second-best position is at most 10 exactly when two URLs are, so counts decide the severity
    and the whole group needs one partially aggregated shuffle: no sort, no list of its URLs.
    """
    groups = competing(query_page, **limits).groupBy("site", "query").agg(
        F.count("*").alias("url_count"),
        F.count_if(F.col("position") <= 10).alias("on_page_1"),
        F.count_if(F.col("position") <= 20).alias("on_page_2"),
        F.sum("impressions").alias("total"),
        F.min(F.struct("position", "url", "impressions")).alias("best"),
    ).filter(F.col("url_count") >= 2)
    return groups.select(
        "site", "query", "url_count",
        F.when(F.col("on_page_1") >= 2, "alta").when(F.col("on_page_2") >= 2, "média").otherwise("baixa").alias("severity"),
        (F.col("total") - F.col("best.impressions")).alias("severity_score"),
        F.col("best.url").alias("best_url"),
        F.col("best.position").alias("best_position"),
    )


def cannibalization_members(query_page: DataFrame, **limits) -> DataFrame:
    """The competing URLs of every A06 group, one row each."""
    rows = cut(competing(query_page, **limits).select("site", "query", "url", "position", "clicks", "impressions", "ctr"))  # the log is read once
    groups = cannibalization(rows, **limits).select("site", "query", "url_count", "severity", "severity_score", "best_url")
    return rows.join(groups, ["site", "query"])


def group_listing(members: DataFrame) -> DataFrame:
    """L05. Groups by severity, one row per URL, the keyword on the first row only."""
    return members.select(
        "site", F.when(F.col("url") == F.col("best_url"), F.col("query")).alias("keyword"),
        "query", "url", "position", "clicks", "impressions", "severity", "severity_score", "url_count",
    ).orderBy("site", F.desc("severity_score"), F.desc("url_count"), "query", "position", "url")


def band_distribution(rows: DataFrame) -> DataFrame:
    """A07. All six bands per site, zeros included."""
    labels = [b[2] for b in POSITION_BANDS] + [NO_DATA_BAND[1]]
    ranks = [b[1] for b in POSITION_BANDS] + [NO_DATA_BAND[0]]
    r = band_rank(F.col("position"))
    counts = rows.groupBy("site").agg(F.count("*").alias("n"), *[F.count_if(r == k).alias(str(k)) for k in ranks])
    long = counts.unpivot(["site", "n"], [str(k) for k in ranks], "k", "urls")
    return long.select(
        "site", F.col("k").cast("int").alias("band_rank"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("k").cast("int")).alias("band"),
        "urls", F.round(F.col("urls") / F.col("n") * 100, 1).alias("percent"),
    )


def opportunity_ranking(rows: DataFrame) -> DataFrame:
    """L03. Page-one rows by lost clicks."""
    score = opportunity_score(F.col("impressions"), F.col("ctr"), F.col("position"))
    page_one = rows.filter(F.col("has_data") & (F.col("position") <= 10))
    return page_one.select(
        "site", "url", "position", "clicks", "impressions", "ctr", band_label(F.col("position")).alias("band"),
        F.round(expected_ctr(F.col("position")), 4).alias("expected_ctr"), score.alias("score"), opportunity_band(score).alias("level"),
    ).orderBy("site", F.desc("score"), "url")


def band_listing(rows: DataFrame) -> DataFrame:
    """L04."""
    p = F.col("position")
    return rows.select(
        "site", "url", "position", "clicks", "impressions", "ctr",
        band_rank(p).alias("band_rank"), band_label(p).alias("band"), band_action(p).alias("action"),
    ).orderBy("site", "band_rank", F.asc_nulls_last("position"), "url")


def top_keywords(query_page: DataFrame, top: int = 10) -> DataFrame:
    """A21."""
    w = Window.partitionBy("site").orderBy(F.desc("impressions"), "query")
    totals = query_page.filter(F.col("position") <= 10).groupBy("site", "query").agg(F.sum("impressions").alias("impressions"))
    return totals.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
