"""Position history: snapshots, content tracking, pivots, refresh worklists."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scoring import is_fresh
from rankloom.functions.wordlists import VERDICT_ORDER
from rankloom.lineage import cut

KEEP_SNAPSHOTS = 30
RECENT = 8


def newest_dates(history: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` snapshot dates of every site, ``age`` 1 = newest."""
    w = Window.partitionBy("site").orderBy(F.desc("date"))
    return history.select("site", "date").distinct().withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)


def with_content(rows: DataFrame, content: DataFrame) -> DataFrame:
    """J16. Snapshot rows with the compact content result of their page."""
    compact = content.select(
        "site", "url",
        F.struct(
            "verdict", F.col("keyword_density").alias("density"), F.col("word_count").cast("long").alias("words"),
            F.col("vocab_diversity").alias("diversity"), F.col("entity_count").cast("long").alias("entities"),
        ).alias("content"),
    )
    return rows.filter("has_data").select("site", "date", "url", "position", "clicks", "impressions").join(
        compact, ["site", "url"], "left"
    )


def upsert_snapshot(history: DataFrame, snapshot: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """K03. Snapshot rows replace the same site and date; only the newest dates of a site stay.

    The snapshot is stored first: its dates are looked at three times, and its content results are worth computing once.
    """
    snapshot = cut(snapshot)
    replaced = snapshot.select("site", "date").distinct()
    merged = history.join(replaced, ["site", "date"], "left_anti").unionByName(snapshot.select(*history.columns))
    return merged.join(newest_dates(merged, keep).select("site", "date"), ["site", "date"], "left_semi")


def content_tracking(history: DataFrame) -> DataFrame:
    """W04. Position and verdict of every page between its first and last analysed snapshot."""
    seen = history.filter(F.col("content").isNotNull())
    first = F.min_by(F.struct("date", "position", "content"), "date")
    last = F.max_by(F.struct("date", "position", "content"), "date")
    t = seen.groupBy("site", "url").agg(F.count("*").alias("snapshots"), first.alias("f"), last.alias("l"))
    delta = F.when(F.col("snapshots") >= 2, F.round(F.col("f.position") - F.col("l.position"), 1))
    order = F.array_position(F.array(*[F.lit(v) for v in VERDICT_ORDER]), F.col("last_verdict"))
    return t.select(
        "site", "url", "snapshots",
        F.col("f.date").alias("first_date"), F.col("l.date").alias("last_date"),
        F.col("f.position").alias("first_position"), F.col("l.position").alias("last_position"),
        delta.alias("position_delta"),
        F.col("f.content.verdict").alias("first_verdict"), F.col("l.content.verdict").alias("last_verdict"),
        F.col("l.content.density").alias("last_density"), F.col("l.content.words").alias("last_words"),
    ).orderBy("site", F.when(order == 0, 9).otherwise(order), F.desc(F.abs(F.coalesce("position_delta", F.lit(0.0)))), "url")


def content_snapshots(history: DataFrame) -> DataFrame:
    """W04. Number of dates with any content result per site."""
    seen = history.filter(F.col("content").isNotNull()).select("site", "date").distinct()
    return seen.groupBy("site").agg(F.count("*").alias("content_snapshots"))


def history_pivot(history: DataFrame, recent: int = RECENT) -> DataFrame:
    """W05. Positions of the last snapshots side by side (d1 = oldest) with the trend between the outer ones."""
    dates = newest_dates(history, recent)
    width = dates.groupBy("site").agg(F.max("age").alias("width"))
    slots = dates.join(width, "site").select("site", "date", (F.col("width") - F.col("age") + 1).alias("slot"))
    rows = history.join(slots, ["site", "date"])
    known = F.col("position").isNotNull()
    t = rows.groupBy("site", "url").agg(
        *[F.max(F.when(F.col("slot") == k, F.col("position"))).alias(f"d{k}") for k in range(1, recent + 1)],
        F.min_by(F.when(known, F.col("position")), F.when(known, F.col("slot"))).alias("first_position"),
        F.max_by(F.when(known, F.col("position")), F.when(known, F.col("slot"))).alias("last_position"),
    )
    delta = F.round(F.col("first_position") - F.col("last_position"), 1)
    mark = (
        F.when(F.col("first_position").isNull(), "s/d").when(F.abs(delta) < 2.0, "→")
        .when(delta > 0, "↑").otherwise("↓")
    )
    return t.withColumn("trend", mark).withColumn("delta", delta)


def history_top_series(history: DataFrame, top: int = 8, recent: int = RECENT) -> DataFrame:
    """W07. Position series of the most seen URLs in the last snapshots; a missing day stays null."""
    dates = newest_dates(history, recent).select("site", "date")
    rows = history.join(dates, ["site", "date"])
    w = Window.partitionBy("site").orderBy(F.desc("impressions"), "url")
    best = rows.groupBy("site", "url").agg(F.sum("impressions").alias("impressions")).withColumn(
        "rank", F.row_number().over(w)
    ).filter(F.col("rank") <= top)
    grid = best.join(dates, "site")
    return grid.join(rows.select("site", "url", "date", "position"), ["site", "url", "date"], "left").select(
        "site", "rank", "url", "date", "position"
    )


def refresh_worklist(urls: DataFrame, results: DataFrame, as_of, ttl_hours: int) -> DataFrame:
    """J18. URLs without a fresh, successful stored result."""
    usable = results.filter(is_fresh(F.col("cached_at"), as_of, F.lit(ttl_hours)) & ~F.col("failed"))
    return urls.select("site", "url").join(usable, ["site", "url"], "left_anti")


def upsert_results(stored: DataFrame, new: DataFrame) -> DataFrame:
    """J18. Successful new results replace the stored ones of the same site, date and URL."""
    ok = new.filter(~F.col("failed"))
    keys = ["site", "date", "url"]
    return stored.join(ok, keys, "left_anti").unionByName(ok.select(*stored.columns))


def latest_per_site(artifacts: DataFrame) -> DataFrame:
    """S14. Newest dated artifact of every site; the current folder goes before the legacy one."""
    return artifacts.groupBy("site").agg(
        F.min_by(F.struct("date", "path", "is_legacy"), F.struct("is_legacy", (-F.unix_date("date")).alias("d"), "path")).alias("a")
    ).select("site", "a.date", "a.path", "a.is_legacy")
