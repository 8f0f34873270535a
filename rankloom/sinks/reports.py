"""Report projections (what a file holds) and their writers.

Projections are plain DataFrames; writers partition by a folder-safe site name and the date.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import ascii_fold
from rankloom.functions.urls import partition_name, path_or_root, query_string, url_path_query

#: First line of every file of suggestions.
NOTICE = "# SUGESTAO: exige revisao humana antes de aplicar"
REGEX_SPECIAL = r"([\\.^$|?*+()\[\]{}\-#&~\s])"


def write_by_site(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", **options) -> None:
    """K10. One folder per site (and date, when the rows have one)."""
    keys = ["site_dir"] + (["date"] if "date" in df.columns else [])
    out = df.withColumn("site_dir", partition_name(F.col("site")))
    out.write.partitionBy(*keys).mode(mode).options(**options).format(fmt).save(path)


def indexing_rows(inspections: DataFrame) -> DataFrame:
    """K01. Detailed indexing report."""
    return inspections.select(
        "site", "date", "url", "category", "verdict", "coverage_state", F.date_format("last_crawl", "yyyy-MM-dd'T'HH:mm:ss").alias("last_crawl")
    )


def position_csv_rows(rows: DataFrame) -> DataFrame:
    """K02. Position and ctr are blank without data."""
    seen = F.col("has_data")
    return rows.select(
        "site", F.col("url").alias("URL"), F.when(seen, F.col("position")).alias("Posicao"), F.col("clicks").alias("Cliques"),
        F.col("impressions").alias("Impressoes"), F.when(seen, F.col("ctr")).alias("CTR"), F.when(seen, "Sim").otherwise("Nao").alias("Com_Dados"),
    )


def indexing_snapshot(summary: DataFrame) -> DataFrame:
    """K04. Category counts side by side, ready to append."""
    counts = {c: F.sum(F.when(F.col("category") == c, F.col("total"))) for c in ("indexed", "not_indexed", "warning", "unknown")}
    return summary.groupBy("site", "date").agg(F.first("total_urls").alias("total_urls"), *[v.alias(k) for k, v in counts.items()])


def append_indexing_history(summary: DataFrame, path: str) -> None:
    indexing_snapshot(summary).write.mode("append").parquet(path)


def pruning_csv_rows(plan: DataFrame, max_query: int = 60) -> DataFrame:
    """K06. Decimal comma, long queries cut, top queries in one cell."""
    def short(q):
        q = F.trim(q)
        return F.when(F.length(q) > max_query, F.concat(F.rtrim(F.substring(q, 1, max_query - 3)), F.lit("..."))).otherwise(q)

    return plan.select(
        "site", "url", F.col("action").alias("acao_final"), F.coalesce("suggested_target", F.lit("")).alias("destino_final"),
        F.col("origin").alias("origem"), F.col("impressions").alias("impressoes"), F.col("clicks").alias("cliques"),
        F.when(F.col("position").isNotNull(), F.replace(F.format_string("%.1f", "position"), F.lit("."), F.lit(","))).otherwise("").alias("posicao"),
        F.coalesce("target_source", F.lit("")).alias("fonte_sugestao"),
        F.array_join(F.transform("top_queries", short), " | ").alias("top_queries"),
    )


def redirect_rules(plan: DataFrame) -> DataFrame:
    """K07. One rule per redirect and server."""
    comment = F.format_string("# keyword: %s  (severidade %s)", ascii_fold(F.col("keyword")), ascii_fold(F.col("severity")))
    source = url_path_query(F.col("from_url"))
    apache = F.concat(F.lit("Redirect 301 "), source, F.lit(" "), F.col("to_url"))
    nginx = F.concat(F.lit("location = "), source, F.lit(" { return 301 "), F.col("to_url"), F.lit("; }"))
    servers = F.array(F.struct(F.lit("htaccess").alias("f"), apache.alias("r")), F.struct(F.lit("nginx").alias("f"), nginx.alias("r")))
    place = [c for c in plan.columns if c == "place"]
    return plan.select("site", "from_url", *place, comment.alias("comment"), F.explode(servers).alias("s")).select(
        "site", "from_url", *place, "comment", F.col("s.f").alias("format"), F.col("s.r").alias("rule")
    )


def regex_escape(c):
    return F.regexp_replace(c, REGEX_SPECIAL, r"\\$1")


def removal_rules(reviewed: DataFrame) -> DataFrame:
    """K08. Rules of the reviewed entries for three server dialects; mod_alias cannot see query strings."""
    url, action, target = F.col("url"), F.col("action"), F.col("target")
    p, q = path_or_root(url), query_string(url)
    has_q, is_301 = q != "", action == "301"
    anchored = F.regexp_replace(p, "/+$", "")
    anchored = F.concat(F.lit("^"), regex_escape(F.when(anchored == "", "/").otherwise(anchored)), F.lit("/?$"))
    match_rule = F.concat(F.lit("RedirectMatch "), action, F.lit(" "), anchored, F.when(is_301, F.concat(F.lit(" "), target)).otherwise(""))
    pattern = F.concat(F.lit("^"), regex_escape(F.regexp_replace(p, "^/+|/+$", "")), F.lit("/?$"))
    flag = F.when(is_301, F.concat(target, F.lit("? [R=301,L]"))).when(action == "404", "- [R=404,L]").otherwise("- [G,L]")
    rewrite = F.concat(F.lit("RewriteCond %{QUERY_STRING} ^"), regex_escape(q), F.lit("$\nRewriteRule "), pattern, F.lit(" "), flag)
    ret = F.when(is_301, F.concat(F.lit("return 301 "), target, F.lit(";"))).otherwise(F.concat(F.lit("return "), action, F.lit(";")))
    guarded = F.when(has_q, F.concat(F.lit('if ($args = "'), q, F.lit('") { '), ret, F.lit(" }"))).otherwise(ret)
    nginx = F.concat(F.lit("location = "), p, F.lit(" { "), guarded, F.lit(" }"))
    plain = F.concat(F.lit("Redirect "), action, F.lit(" "), p, F.when(is_301, F.concat(F.lit(" "), target)).otherwise(""))
    forms = F.array(
        F.struct(F.lit("htaccess").alias("f"), F.when(has_q, rewrite).otherwise(match_rule).alias("r")),
        F.struct(F.lit("nginx").alias("f"), nginx.alias("r")),
        F.struct(F.lit("redirect").alias("f"), F.when(has_q, F.concat(F.lit("#   "), ascii_fold(url))).otherwise(plain).alias("r")),
    )
    return reviewed.filter(F.col("status") == "entry").select("site", "url", "action", F.explode(forms).alias("s")).select(
        "site", "url", "action", F.col("s.f").alias("format"), F.col("s.r").alias("rule")
    )


def _lines(site, file, part: int, place, value) -> list:
    return [F.coalesce(partition_name(site), F.lit("")).alias("site_dir"), file.alias("file"), F.lit(part).alias("part"), place.alias("place"), value.alias("value")]


def _under_notice(body: DataFrame, notice: str) -> DataFrame:
    """``body`` with the notice as the first line of every file."""
    head = body.select("site_dir", "file").distinct().withColumns(
        {"part": F.lit(0), "place": F.lit(None).cast(body.schema["place"].dataType), "value": F.lit(notice)})
    return head.unionByName(body)


def rule_lines(rules: DataFrame, notice: str = NOTICE) -> DataFrame:
    """K07, K08. (site_dir, file, part, place, value): the lines of every site's rule files, a notice and then each rule under its comment.

    Rules come in the order of ``place`` where they have one, else of their URL.
    """
    comment = F.col("comment") if "comment" in rules.columns else F.concat(F.lit("# "), ascii_fold(F.col("url")))
    place = F.col("place") if "place" in rules.columns else F.col("from_url" if "from_url" in rules.columns else "url")
    return _under_notice(rules.select(*_lines(F.col("site"), F.col("format"), 1, place, F.concat_ws("\n", comment, "rule"))), notice)


def redirect_csv_lines(plan: DataFrame, conflicts: DataFrame, notice: str = NOTICE) -> DataFrame:
    """K05. (site_dir, file, part, place, value): the lines of every site's redirect table: notice, header, redirects in plan order, conflicts.

    ``plan`` has a ``place`` column; a site with conflicts only has a file as well.
    """
    names = ["from_url", "to_url", "keyword", "severity", "clicks_from", "clicks_to"]
    file, group = F.lit("redirects"), F.concat(F.lit('grupo "'), "keyword", F.lit('": '))
    rows = plan.select(*_lines(F.col("site"), file, 2, F.struct(F.col("place.gkey").alias("g"), F.col("place.fit.u").alias("u"), F.col("place").alias("p")), F.to_csv(F.struct(*names))))
    none = F.lit(None).cast(rows.schema["place"].dataType)
    text = (
        F.when(F.col("conflict") == "grupo_ignorado", F.concat(group, F.lit("todas as URLs ja possuem redirect em grupos de maior severidade")))
        .when(F.col("conflict") == "canonica_de_outro_grupo", F.concat(group, "url", F.lit(" e canonica de outro grupo")))
        .otherwise(F.concat(group, "url", F.lit(" ja redireciona para "), "kept_target"))
    )
    told = conflicts.select(*_lines(F.col("site"), file, 3, none, F.concat(F.lit("# conflito: "), text)))
    body = rows.unionByName(told)
    header = body.select("site_dir", "file").distinct().withColumns({"part": F.lit(1), "place": none, "value": F.lit(",".join(names))})
    return _under_notice(header.unionByName(body), notice)


def write_site_files(lines: DataFrame, path: str) -> None:
    """One text file a site and file name, its lines in order; a rerun replaces the files of the sites it has and leaves other sites' alone.

    The rows of a file are sorted in its task and written as they come; files appear when the whole job has succeeded.
    """
    keys = ["site_dir", "file"]
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, "part", "place", "value").select(*keys, "value")
    ordered.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write_rules(rules: DataFrame, path: str, notice: str = NOTICE) -> None:
    """K07, K08. The rule files of every site."""
    write_site_files(rule_lines(rules, notice), path)


def redirect_csv_rows(plan: DataFrame) -> DataFrame:
    """K05."""
    return plan.select("site", "from_url", "to_url", "keyword", "severity", "clicks_from", "clicks_to")


def portfolio_rows(summary: DataFrame) -> DataFrame:
    """K09. One row per site; a failed site keeps only its error."""
    return summary.select(
        F.col("site").alias("Site"), F.col("status").alias("Status"), F.col("health_score").alias("Health"), F.col("health_grade").alias("Grade"),
        F.col("avg_position").alias("Posicao_Media"), F.col("ctr").alias("CTR"), F.col("cannibalization_groups").alias("Grupos_Canibalizacao"),
        F.col("ok").alias("Conteudo_OK"), F.col("atencao").alias("Conteudo_Atencao"), F.col("over_otimizado").alias("Conteudo_Over"),
        F.col("raso").alias("Conteudo_Raso"), F.col("snapshots").alias("Snapshots"), F.coalesce("error", F.lit("")).alias("Erro"),
    )


def drop_partitions(folders: DataFrame) -> None:
    """Remove the partition folders named in the rows, a few paths of expired dates."""
    jvm = folders.sparkSession._jvm
    for r in folders.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["folder"]))
        path.getFileSystem(folders.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def write_history(history: DataFrame, path: str) -> None:
    """K03. Rewrite only the site and date partitions that are in the rows."""
    history.write.partitionBy("site", "date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
