"""Stored history (S15): the flat table, and the legacy one-document-per-site form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.schemas import HISTORY

_URLS = "map<string,struct<position:double,clicks:bigint,impressions:bigint,content:struct<verdict:string,density:double,words:bigint,diversity:double,entities:bigint>>>"
_LEGACY = f"site string, snapshots array<struct<date:string,period:struct<start:string,end:string>,urls:{_URLS}>>"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def legacy_history(documents: DataFrame) -> DataFrame:
    """(json) documents to flat history rows; an unreadable document gives none."""
    d = documents.select(F.from_json("json", _LEGACY).alias("d")).filter(F.col("d.site").isNotNull())
    snaps = d.select("d.site", F.explode("d.snapshots").alias("s"))
    day = lambda c: F.col(f"s.{c}").cast("date")
    rows = snaps.select("site", day("date").alias("date"), day("period.start").alias("period_start"), day("period.end").alias("period_end"), F.explode("s.urls").alias("url", "m"))
    return rows.select("site", "date", "period_start", "period_end", "url", "m.position", "m.clicks", "m.impressions", "m.content")
