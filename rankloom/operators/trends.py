"""Demand trends over daily series. A series is at most one value a day, so it fits in an array."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.wordlists import SITE_SERIES

RISING, DECLINING = 1.15, 0.85


def _mean(values, start, length):
    return F.aggregate(F.slice(values, start, length), F.lit(0.0), lambda a, v: a + v) / length


def _direction(first, last):
    ratio = last / first
    return (
        F.when(first == 0, F.when(last > 0, "rising").otherwise("stable"))
        .when(ratio >= RISING, "rising").when(ratio <= DECLINING, "declining").otherwise("stable")
    )


def trend_thirds(series: DataFrame, min_days: int = 6) -> DataFrame:
    """W01. First against last third of ``values``."""
    v, n = F.col("values"), F.size("values")
    third = F.floor(n / 3).cast("int")
    whole = F.when(n > 0, _mean(v, F.lit(1), n)).otherwise(0.0)
    short = n < min_days
    first = F.when(short, whole).otherwise(_mean(v, F.lit(1), F.greatest(third, F.lit(1))))
    last = F.when(short, whole).otherwise(_mean(v, F.greatest(n - third + 1, F.lit(1)), F.greatest(third, F.lit(1))))
    return series.withColumn("first_mean", first).withColumn("last_mean", last).withColumn(
        "trend", F.when(short, "stable").otherwise(_direction(F.col("first_mean"), F.col("last_mean")))
    )


def daily_series(site_daily: DataFrame, query_daily: DataFrame, top: int = 10, metric: str = "impressions") -> DataFrame:
    """Aligned arrays: the site's own series (rank 0) and its top queries by impressions; a missing day is 0.

    The axis holds the dates of the site series only.
    """
    axis = site_daily.groupBy("site", "date").agg(F.max(metric).alias("v"))
    site_rows = axis.select("site", "date", F.lit(SITE_SERIES).alias("series"), F.lit(0).alias("rank"), "v")
    w = Window.partitionBy("site").orderBy(F.desc("total"), "query")
    best = query_daily.groupBy("site", "query").agg(F.sum("impressions").alias("total")).withColumn(
        "rank", F.row_number().over(w)
    ).filter(F.col("rank") <= top)
    values = query_daily.groupBy("site", "query", "date").agg(F.max(metric).alias("v"))
    grid = best.select("site", "query", "rank").join(axis.select("site", "date"), "site")
    query_rows = grid.join(values, ["site", "query", "date"], "left").select(
        "site", "date", F.col("query").alias("series"), "rank", F.coalesce("v", F.lit(0)).alias("v")
    )
    points = F.array_sort(F.collect_list(F.struct("date", "v")))
    return site_rows.unionByName(query_rows).groupBy("site", "series", "rank").agg(points.alias("p")).select(
        "site", "series", "rank",
        F.transform("p", lambda x: x["date"]).alias("dates"),
        F.transform("p", lambda x: x["v"].cast("double")).alias("values"),
    )


def date_trends(series: DataFrame, sparse_days: int = 14) -> DataFrame:
    """W02."""
    return trend_thirds(series).select(
        "site", "series", "rank", "trend",
        F.coalesce(F.array_max("values"), F.lit(0.0)).cast("long").alias("peak"),
        F.round("last_mean").cast("long").alias("latest"),
        (F.size(F.filter("values", lambda v: v > 0)) < sparse_days).alias("sparse"),
        F.round("first_mean", 1).alias("first_avg"), F.round("last_mean", 1).alias("last_avg"), "dates", "values",
    )


def short_trend(series: DataFrame, sparse_points: int = 8) -> DataFrame:
    """W03. First three against last three values, after the trailing zeros."""
    v = F.col("values")
    seen = F.transform(v, lambda x, i: F.when(x != 0, i + 1).otherwise(0))
    n = F.coalesce(F.array_max(seen), F.lit(0))
    positive = F.filter(v, lambda x: x > 0)
    three = F.lit(3)
    return series.withColumn("n", n).select(
        "site", "series",
        F.when(F.col("n") < 6, "stable")
        .otherwise(_direction(_mean(v, F.lit(1), three), _mean(v, F.greatest(F.col("n") - 2, F.lit(1)), three))).alias("trend"),
        F.coalesce(F.array_max(v), F.lit(0.0)).cast("long").alias("peak"),
        F.coalesce(F.try_element_at(positive, F.lit(-1)), F.lit(0.0)).cast("long").alias("latest"),
        ((F.size(v) > 0) & (F.size(positive) < sparse_points)).alias("sparse"),
    )


def trend_chart(trends: DataFrame, top: int = 6, label_chars: int = 35) -> DataFrame:
    """W08. The first series of every site on the shared date axis; labels are cut, ``series`` is whole."""
    return trends.filter(F.col("rank") < top).select("site", "rank", "series", F.substring("series", 1, label_chars).alias("label"), "dates", "values")


def trend_latest(trends: DataFrame, top: int = 6, label_chars: int = 35) -> DataFrame:
    """W08. The chart's other form: the latest value of the first series of every site."""
    return trends.filter(F.col("rank") < top).select("site", "rank", "series", F.substring("series", 1, label_chars).alias("label"), "trend", "latest")


def trend_positions(trends: DataFrame, query_page: DataFrame) -> DataFrame:
    """J15. Best position of every trended query and the impressions of that row."""
    best = query_page.filter(F.col("position").isNotNull()).groupBy("site", F.col("query").alias("series")).agg(
        F.min(F.struct("position", (-F.col("impressions")).alias("i"))).alias("b")
    )
    return trends.select("site", "series", "rank", "trend", "peak", "latest").join(best, ["site", "series"], "left").select(
        "site", "series", "rank", "trend", "peak", "latest",
        F.col("b.position").alias("best_position"), (-F.col("b.i")).alias("best_impressions"),
    )
