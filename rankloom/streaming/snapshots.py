"""Keeping the history current from a folder of landed snapshots.

A snapshot of a site and date may land as any number of files, and again in a later run that replaces it whole. Every
landed row carries its ``run``; a micro-batch merges with what the table holds for the sites and dates it touches and
keeps each one's newest run, so neither the split into batches, nor a replayed batch, nor a late file of an older run changes
the outcome. The table has the history's columns and ``run``; a site keeps its newest dates only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.operators.history import KEEP_SNAPSHOTS, newest_dates
from rankloom.schemas import LANDED
from rankloom.sinks.reports import drop_partitions, write_history


def landed_snapshots(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merged_runs(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows of every site and date of the batch, of its newest run; a URL that repeats within a run once."""
    key = ["site", "date"]
    rows = batch
    if stored is not None:
        rows = rows.unionByName(stored.join(batch.select(*key).distinct(), key, "left_semi").select(*batch.columns))
    newest = rows.groupBy(*key).agg(F.max("run").alias("run"))
    return rows.join(newest, [*key, "run"]).dropDuplicates([*key, "url"]).select(*batch.columns)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LANDED).parquet(path) if found else None


def upsert_stream(snapshots: DataFrame, history_path: str, state_path: str, keep: int = KEEP_SNAPSHOTS):
    """Start the query that merges landed snapshots into the history; stops when all landed files are in."""
    def merge(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        # written apart first: the table cannot be read and replaced at once
        write_history(cut(merged_runs(_stored(spark, history_path), batch)), history_path)
        table = _stored(spark, history_path)
        dates = table.select("site", "date", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()
        drop_partitions(dates.join(newest_dates(table, keep).select("site", "date"), ["site", "date"], "left_anti").select("folder"))

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", state_path).trigger(availableNow=True).start()
