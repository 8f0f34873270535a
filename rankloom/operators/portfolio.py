"""Portfolio view: one row per site, and a caller's function per site."""

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rankloom.functions.wordlists import VERDICT_ORDER


def site_run_summary(sites: DataFrame, summary: DataFrame, health: DataFrame, groups: DataFrame, verdicts: DataFrame, history: DataFrame) -> DataFrame:
    """A19. Totals of every requested site; a site without rows is reported as an error, not dropped."""
    cann = groups.groupBy("site").agg(F.count("*").alias("cannibalization_groups"))
    words = verdicts.groupBy("site").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICT_ORDER])
    snaps = history.select("site", "date").distinct().groupBy("site").agg(F.count("*").alias("snapshots"))
    t = sites.select("site").distinct().join(summary, "site", "left").join(health.select("site", "score", "grade"), "site", "left")
    t = t.join(cann, "site", "left").join(words, "site", "left").join(snaps, "site", "left")
    ok = F.col("total_urls").isNotNull()
    zero = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0))).alias(c)
    return t.select(
        "site", F.when(ok, "OK").otherwise("ERRO").alias("status"), F.when(~ok, "sem URLs no sitemap").alias("error"),
        "total_urls", "urls_with_data", F.col("score").alias("health_score"), F.col("grade").alias("health_grade"),
        "avg_position", F.col("avg_ctr").alias("ctr"), zero("snapshots"), zero("cannibalization_groups"), *[zero(v) for v in VERDICT_ORDER],
    )


def run_per_site(sites: DataFrame, fn, schema: str) -> DataFrame:
    """D01. ``fn(row: dict) -> dict`` for each row of a one-row-per-site table; a failing site becomes an error row.

    ``schema`` names the columns ``fn`` returns; ``site``, ``status`` and ``error`` are added.
    """
    fields = [f.split()[0] for f in schema.split(",")]

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({"site": row["site"], "status": "OK", "error": None, **{k: v for k, v in fn(row).items() if k in fields}})
                except Exception as exc:
                    out.append({"site": row["site"], "status": "ERRO", "error": str(exc)})
            yield pd.DataFrame(out, columns=["site", "status", "error", *fields])

    return sites.mapInPandas(run, f"site string, status string, error string, {schema}")


def run_over_sites(sites: DataFrame, rows: DataFrame, fn: Callable[[str, Iterator[pa.RecordBatch]], dict], schema: str) -> DataFrame:
    """D01. ``fn(site, batches) -> dict`` for every requested site over that site's own ``rows``; a failing site becomes an error row.

    Rows are dealt and sorted by site and streamed to ``fn`` as Arrow batches of ``rows``' columns, so a site larger than memory is read batch by
    batch, and what ``fn`` leaves unread is skipped. A requested site without rows gets no batch; rows of other sites are left out.
    ``schema`` names the columns ``fn`` returns; ``site``, ``status`` and ``error`` are added. A site that is requested twice runs once.
    """
    fields = [f.split()[0] for f in schema.split(",")]
    mark = "requested"
    while mark in rows.columns:
        mark += "_"
    asked = sites.select("site").distinct().select(*[F.col("site") if c == "site" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(True).alias(mark))
    wanted = rows.join(sites.select("site").distinct(), "site", "left_semi").select(*rows.columns, F.lit(False).alias(mark))
    dealt = asked.unionByName(wanted).repartition("site").sortWithinPartitions("site", F.desc(mark))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            runs = pc.run_end_encode(batch.column("site"))
            start = 0
            for end, site in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                yield site, batch.slice(start, end - start)
                start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for site, parts in groupby(pieces(batches), key=lambda p: p[0]):
            first = next(parts)[1]  # the request, ahead of the site's rows
            own = (b.drop_columns([mark]) for b in chain([first.slice(1)], (b for _, b in parts)) if b.num_rows)
            try:
                out = {"site": site, "status": "OK", "error": None, **{k: v for k, v in fn(site, own).items() if k in fields}}
            except Exception as exc:
                out = {"site": site, "status": "ERRO", "error": str(exc)}
            yield pa.RecordBatch.from_pylist([{k: out.get(k) for k in ("site", "status", "error", *fields)}], schema=result)

    head = f"site string, status string, error string, {schema}"
    result = to_arrow_schema(_parse_datatype_string(head))
    return dealt.mapInArrow(run, head)
