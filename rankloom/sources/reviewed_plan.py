"""Reviewed pruning plans (S12): CSV lines edited by a person."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.urls import match_key

ACTIONS = ("410", "404", "301", "manter", "revisar")


def reviewed_plan(lines: DataFrame) -> DataFrame:
    """(site, path, n, value) lines to (site, url, action, target, status, reason).

    The first line that is neither blank nor comment is a file's header; it names the columns and its
    separators decide the delimiter. Quoted fields may hold the delimiter.
    """
    kept = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    head = kept.groupBy("site", "path").agg(F.min_by("value", "n").alias("header"), F.min("n").alias("head_n"))
    semi = F.regexp_count("header", F.lit(";")) > F.regexp_count("header", F.lit(","))
    sep = F.when(semi, F.lit(";")).otherwise(F.lit(","))
    rows = kept.join(head, ["site", "path"]).filter(F.col("n") > F.col("head_n")).withColumn("sep", sep)

    def fields(text):
        # a field is quoted, or runs to the next separator
        quoted = r'"(?:[^"]|"")*"'
        wide = lambda s: F.regexp_extract_all(F.concat(text, F.lit(s)), F.lit(rf"({quoted}|[^{s}]*){s}"), F.lit(1))
        return F.transform(
            F.when(F.col("sep") == ";", wide(";")).otherwise(wide(",")),
            lambda x: F.replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')),
        )

    rows = rows.withColumn("names", F.transform(fields(F.col("header")), lambda x: F.lower(F.trim(x)))).withColumn("cells", fields(F.col("value")))

    def cell(name):
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.trim(F.coalesce(F.when(at > 0, F.try_element_at("cells", at)), F.lit("")))

    rows = rows.select("site", "path", "n", cell("url").alias("url"), F.lower(cell("acao_final")).alias("a"), cell("destino_final").alias("t"))
    rows = rows.withColumn("a", F.when(F.col("a") == "", "revisar").otherwise(F.col("a")))
    moved = F.col("a") == "301"
    reason = (
        F.when(F.col("url") == "", "url vazia")
        .when(~F.col("a").isin(*ACTIONS), "acao_final invalida")
        .when(moved & ~F.lower("t").rlike("^https?://"), "301 sem destino_final absoluto valido")
        .when(moved & (match_key(F.col("t")) == match_key(F.col("url"))), "301 com destino igual a origem")
    )
    status = (
        F.when(F.col("reason").isNotNull(), "error").when(F.col("a") == "revisar", "pending").when(F.col("a") == "manter", "kept").otherwise("entry")
    )
    return rows.withColumn("reason", reason).select(
        "site", "path", "n", "url", F.col("a").alias("action"), F.when(moved, F.col("t")).alias("target"), status.alias("status"), "reason"
    )
