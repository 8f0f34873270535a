"""Search metrics from landing tables that hold the service's rows as delivered."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.schemas import LANDING_PAGE, LANDING_QUERY

SOURCE_LAG_DAYS = 3


def read_landing(spark: SparkSession, path: str, fmt: str = "parquet", by_query: bool = False) -> DataFrame:
    """Landing rows; partitioned by site and end_date on disk, so filters on either prune files."""
    return spark.read.schema(LANDING_QUERY if by_query else LANDING_PAGE).format(fmt).load(path)


def _cast():
    return [
        F.col("clicks").cast("long").alias("clicks"), F.col("impressions").cast("long").alias("impressions"),
        F.round(F.col("ctr") * 100, 2).alias("ctr"), F.round("position", 1).alias("position"),
    ]


def page_metrics(landing: DataFrame) -> DataFrame:
    """S01. Whole counts, ctr in percent, position with one decimal."""
    return landing.select("site", "url", *_cast())


def query_page_metrics(landing: DataFrame) -> DataFrame:
    """S02."""
    return landing.select("site", "query", "url", *_cast())


def daily_metrics(landing: DataFrame, *keys: str) -> DataFrame:
    """S03. Daily counts per site, or per site and query with ``keys=('query',)``."""
    return landing.select(
        "site", F.to_date("date").alias("date"), *keys, F.col("clicks").cast("long").alias("clicks"), F.col("impressions").cast("long").alias("impressions")
    )


def in_report_window(df: DataFrame, as_of, days_back: int) -> DataFrame:
    """S04. Rows of the ``days_back`` + 1 days that end three days before ``as_of``."""
    end = F.date_sub(as_of, SOURCE_LAG_DAYS)
    return df.filter(F.col("date").between(F.date_sub(end, days_back), end))
