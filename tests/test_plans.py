"""Whole reports over the derived tables, and the snapshot stream."""

from pyspark.sql import functions as F

from rankloom import catalog
from rankloom.operators import pruning
from rankloom.plans import reports as plans
from rankloom.sources.derived import Derived
from rankloom.sources.history import read_history
from rankloom.streaming.snapshots import landed_snapshots, upsert_stream

FOLDER = "/root/testdata/sf0.001"


def test_ranking_report(spark):
    d = Derived(spark, FOLDER)
    t = plans.SearchTables(
        d.sitemap(), d.page_metrics(), d.query_page(), d.site_daily(), d.query_daily(), d.inspections(),
        d.history().withColumn("content", F.col("content").cast("struct<verdict:string,density:double,words:bigint,diversity:double,entities:bigint>")),
        d.texts(), d.entities_raw(), d.categories_raw(),
    )
    out = plans.ranking_report(t, "2030-01-01")
    counts = {k: v.count() for k, v in out.items()}
    assert counts["positions"] == d.sitemap().count() and counts["health"] == counts["summary"] == counts["portfolio"] == 5
    assert out["history"].filter("date = '2030-01-01'").count() == out["positions"].filter("has_data").count()
    assert out["history"].groupBy("site").agg(F.countDistinct("date").alias("n")).agg(F.max("n")).first()[0] <= 30


def test_pruning_reports(spark):
    d = Derived(spark, FOLDER)
    out = plans.pruning_report(d.page_metrics(), d.sitemap(), d.query_page(), d.export_list())
    assert out["csv"].count() == out["plan"].count() == out["totals"].agg(F.sum("total")).first()[0]
    done = plans.reviewed_report(d.plan_lines())
    assert done["rules"].count() == 3 * done["plan"].filter("status = 'entry'").count()


def test_log_is_read_once_for_ghosts_and_groups(spark, monkeypatch):
    d, calls, met = Derived(spark, FOLDER), [], pruning.ghost_queries
    monkeypatch.setattr(pruning, "ghost_queries", lambda *a: calls.append(1) or met(*a))
    pruning.pruning_plan(d.page_metrics(), d.sitemap(), d.query_page(), d.export_list())
    assert len(calls) == 1
    monkeypatch.setattr(catalog.sim, "threshold_clusters", lambda v, t: v.select("site", "page", F.col("page").alias("cluster")))
    assert catalog._enriched(d) is catalog._enriched(d)


def test_page_metrics_add_up_the_log(spark, tmp_path):
    rows = [(None, 1, 1, "R", 3.0), (None, 2, 2, "N", 4.0), (7, 1, 1, "R", 5.0), (7, 2, 3, "N", 6.0), (7, 2, 3, "N", 6.0), (12, 3, 2, "R", 7.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = Derived(spark, str(tmp_path))
    got, log = d.page_metrics(), d.query_page().collect()
    want = {}
    for r in log:
        c, i, t = want.get((r.site, r.url), (0, 0, 0))
        want[r.site, r.url] = c + r.clicks, i + r.impressions, t + int(r.position * 10 + 0.5) * r.impressions
    assert {(r.site, r.url): (r.clicks, r.impressions, r.position) for r in got.collect()} == {k: (c, i, int(t / i + 0.5) / 10) for k, (c, i, t) in want.items()}
    # pages are added up by their number, not by names made for every row of the log
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [l_suppkey") == 2


def test_semantic_report(spark):
    d = Derived(spark, FOLDER)
    files = spark.createDataFrame([("all", "inc.php", "<?php foreach ($x as $y) formatStringToURL($y);")], "site string, path string, text string")
    args = (d.vectors(), d.slug_metrics(), d.markup().withColumn("site", F.lit("all")), files, d.list_members())
    for method in ("threshold", "agglomerative"):
        out = plans.semantic_report(*args, threshold=0.4, method=method)
        assert out["totals"].first()["pages"] == d.vectors().count() and out["nearest"].count() == 15
        assert out["tiers"].count() == out["inlinks"].count() == d.vectors().count()
        assert out["hub_gaps"].count() == out["totals"].first()["multi_groups"]


def test_keyword_report(spark):
    got = plans.keyword_report(Derived(spark, FOLDER).keyword_plan()).collect()
    assert [r.impr_total for r in got] == sorted((r.impr_total for r in got), reverse=True)


def test_snapshot_stream(spark, tmp_path):
    h = Derived(spark, FOLDER).history().filter("date < '1995-06-01'").withColumns({"period_start": F.date_sub("date", 27), "period_end": F.col("date"), "run": F.lit(1).cast("long")})
    h = h.withColumn("content", F.col("content").cast("struct<verdict:string,density:double,words:bigint,diversity:double,entities:bigint>"))
    landing, table, state = (str(tmp_path / n) for n in ("landing", "history", "state"))
    h.repartition(4).write.parquet(landing)
    upsert_stream(landed_snapshots(spark, landing, files_per_batch=1), table, state, keep=10**6).awaitTermination(300)
    assert read_history(spark, table).count() == h.count()
    last = h.agg(F.max("date")).first()[0]
    again = h.filter(F.col("date") == last).withColumns({"position": F.lit(1.5), "run": F.lit(2).cast("long")}).limit(1)
    again.coalesce(1).write.mode("append").parquet(landing)
    upsert_stream(landed_snapshots(spark, landing), table, state, keep=10**6).awaitTermination(120)
    got, key = read_history(spark, table), again.first()
    assert got.filter(F.col("date") != last).count() == h.filter(F.col("date") != last).count()
    same = got.filter((F.col("date") == last) & (F.col("site") == key.site)).collect()
    assert [r.position for r in same] == [1.5]


def test_snapshot_stream_keeps_the_newest_dates(spark, tmp_path):
    rows = [("s/1", f"2024-01-{d:02d}", f"u{u}", 1.0 * d) for d in range(1, 31) for u in range(2)] + [("s/1", f"2024-02-{d:02d}", "u", 1.0) for d in range(1, 6)]
    h = spark.createDataFrame(rows, "site string, date string, url string, position double").select(
        "site", F.col("date").cast("date").alias("date"), F.col("date").cast("date").alias("period_start"), F.col("date").cast("date").alias("period_end"), "url", "position",
        F.lit(1).cast("long").alias("clicks"), F.lit(1).cast("long").alias("impressions"),
        F.lit(None).cast("struct<verdict:string,density:double,words:bigint,diversity:double,entities:bigint>").alias("content"), F.lit(1).cast("long").alias("run"))
    landing, table, state = (str(tmp_path / n) for n in ("landing", "history", "state"))
    h.repartition(3).write.parquet(landing)
    upsert_stream(landed_snapshots(spark, landing, 1), table, state).awaitTermination(300)
    got = read_history(spark, table)
    assert got.select("date").distinct().count() == 30 and str(got.agg(F.min("date")).first()[0]) == "2024-01-06"
    assert got.filter("date < '2024-02-01'").count() == 50 and got.filter("period_end = date").count() == 55
