"""Entity tables of pages: filtering, pillars, depth, gaps between queries and entities."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import query_terms
from rankloom.functions.urls import brand_from_domain, plausible_entity
from rankloom.functions.wordlists import SKIPPED_ENTITY_TYPES, TERM_STOPWORDS

PAGE = ["site", "url"]


def entity_filter(raw: DataFrame, top: int = 8) -> DataFrame:
    """F05. Informative, named entities of each page by salience."""
    kept = raw.filter(~F.col("type").isin(*SKIPPED_ENTITY_TYPES) & (F.trim("name") != "")).withColumn("salience", F.round("salience", 3))
    w = Window.partitionBy(*PAGE).orderBy(F.desc("salience"), "pos")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*PAGE, "name", "type", "salience", "rank")


def category_filter(raw: DataFrame, top: int = 3) -> DataFrame:
    """F05. Top categories of each page by confidence."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc("confidence"), "name")
    rounded = raw.withColumn("confidence", F.round("confidence", 3))
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def thousandths(salience):
    """Rounded saliences as whole numbers, so that sums do not depend on the order of the rows."""
    return F.round(F.col(salience) * 1000).cast("long")


def topical_pillars(entities: DataFrame) -> DataFrame:
    """A14. Names on two or more pages with their usual type and mean first salience."""
    named = entities.withColumn("name", F.trim("name"))
    first = named.groupBy(*PAGE, "name").agg(F.min_by(F.struct("salience", "type"), "rank").alias("f"))
    typed = first.groupBy("site", "name", F.col("f.type").alias("type")).agg(
        F.count("*").alias("cnt"), F.min("url").alias("since"), F.sum(thousandths("f.salience")).alias("sal")
    )
    return typed.groupBy("site", "name").agg(
        F.min_by("type", F.struct((-F.col("cnt")).alias("c"), "since")).alias("type"),
        F.sum("cnt").alias("pages"), F.round(F.sum("sal") / F.sum("cnt") / 1000, 3).alias("avg_salience"),
    ).filter(F.col("pages") >= 2)


def type_distribution(entities: DataFrame) -> DataFrame:
    """A15. Entity counts per page and type, and per site and type (url null)."""
    return entities.groupingSets([[F.col("site"), F.col("url"), F.col("type")], [F.col("site"), F.col("type")]], "site", "url", "type").agg(
        F.count("*").alias("entities")
    )


def type_matrix(entities: DataFrame, types) -> DataFrame:
    """A15. One column per type, 0 where absent."""
    return entities.groupBy(*PAGE).pivot("type", list(types)).count().fillna(0)


def depth_scores(analysed: DataFrame, entities: DataFrame, categories: DataFrame) -> DataFrame:
    """A16."""
    e = entities.groupBy(*PAGE).agg(
        F.count("*").alias("n_entities"), F.avg("salience").alias("mean_salience"), F.count_if(F.col("type") == "PERSON").alias("n_person")
    )
    c = categories.groupBy(*PAGE).agg(F.count("*").alias("n_categories"))
    t = analysed.select(*PAGE).distinct().join(e, PAGE, "left").join(c, PAGE, "left").fillna(
        {"n_entities": 0, "n_person": 0, "n_categories": 0, "mean_salience": 0.0}
    )
    score = (
        F.when(F.col("n_categories") > 0, 40).otherwise(0)
        + F.least(F.lit(35), F.floor(F.round(F.col("mean_salience") * 350, 6)))
        + F.least(F.lit(25), F.col("n_entities") * 3)
    )
    t = t.withColumn("score", score.cast("int"))
    return t.withColumn(
        "grade", F.when(F.col("score") >= 70, "Rico").when(F.col("score") >= 50, "Moderado").when(F.col("score") >= 30, "Raso").otherwise("Muito raso")
    )


def entity_recommendations(depth: DataFrame) -> DataFrame:
    """A17. Codes of the advice that applies to a page."""
    n = F.col("n_entities")
    advice = F.array_compact(F.array(
        F.when(F.col("n_categories") == 0, F.lit("sem_categoria")),
        F.when((n > 0) & (F.col("n_person") / n > 0.35), F.lit("muitas_pessoas")),
        F.when((n > 0) & (F.col("mean_salience") < 0.04), F.lit("saliencia_baixa")),
        F.when((n > 0) & (n < 4), F.lit("poucas_entidades")),
        F.when(n == 0, F.lit("nenhuma_entidade")),
        F.when((F.col("score") < 50) & (F.col("n_categories") > 0), F.lit("aumentar_profundidade")),
    ))
    return depth.withColumn("a", advice).select(
        *PAGE, "score", "grade", F.when(F.size("a") > 0, F.col("a")).otherwise(F.array(F.lit("bem_estruturado"))).alias("advice")
    )


def entity_site_summary(depth: DataFrame, entities: DataFrame) -> DataFrame:
    """A18."""
    d = depth.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(F.col("n_categories") > 0).alias("categorised"),
        F.sum("n_entities").alias("entities"), F.round(F.avg("score"), 1).alias("mean_depth"),
        F.floor(F.count_if(F.col("score") >= 50) * 100 / F.count("*")).cast("int").alias("rich_percent"),
    )
    by_type = entities.groupBy("site", "type").agg(F.count("*").alias("cnt"))
    top = by_type.groupBy("site").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "type")).alias("t"), F.sum("cnt").alias("n"))
    return d.join(top, "site", "left").select(
        *d.columns, F.col("t.type").alias("top_type"), F.floor(-F.col("t.c") * 100 / F.col("n")).cast("int").alias("top_type_percent")
    )


def page_key(url):
    return F.lower(F.regexp_replace(url, "/+$", ""))


def _gap_terms(analysed: DataFrame, entities: DataFrame, query_page: DataFrame, top: int):
    w = Window.partitionBy("site", "key").orderBy(F.desc("impressions"), "query", "url")
    best = query_page.withColumn("key", page_key(F.col("url"))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    asked = best.select("site", "key", F.explode(query_terms(F.col("query"))).alias("term"), "impressions").groupBy("site", "key", "term").agg(
        F.sum("impressions").alias("impressions")
    )
    asked = analysed.select(*PAGE).distinct().withColumn("key", page_key(F.col("url"))).join(asked, ["site", "key"]).drop("key")
    words = F.split(F.lower(F.trim("name")), r"\s+")
    stop = F.array(*[F.lit(s) for s in sorted(TERM_STOPWORDS)])
    covered = entities.withColumn("words", words).filter(F.size("words") <= 5).select(*PAGE, F.explode("words").alias("term")).filter(
        (F.length("term") >= 3) & ~F.array_contains(stop, F.col("term"))
    ).distinct()
    return asked, covered


def content_gaps(analysed: DataFrame, entities: DataFrame, query_page: DataFrame, top: int = 8) -> DataFrame:
    """J14. Terms of a page's top queries, whether its entities cover them, and their impressions."""
    asked, covered = _gap_terms(analysed, entities, query_page, top)
    hit = covered.withColumn("hit", F.lit(True))
    return asked.join(hit, [*PAGE, "term"], "left").select(*PAGE, "term", "impressions", F.coalesce("hit", F.lit(False)).alias("covered"))


def term_sets(analysed: DataFrame, entities: DataFrame, query_page: DataFrame, top: int = 8) -> DataFrame:
    """U03. Covered terms and gaps of each page as sets; at most the terms of ``top`` queries."""
    asked, covered = _gap_terms(analysed, entities, query_page, top)
    a = asked.groupBy(*PAGE).agg(F.collect_set("term").alias("asked"))
    c = covered.groupBy(*PAGE).agg(F.collect_set("term").alias("have"))
    have = F.coalesce("have", F.array().cast("array<string>"))
    return a.join(c, PAGE, "left").select(
        *PAGE, F.array_sort(F.array_intersect("asked", have)).alias("covered"), F.array_sort(F.array_except("asked", have)).alias("gaps")
    )


def brand_entity(candidates: DataFrame) -> DataFrame:
    """J17. The best scored candidate of a site, kept only if it can be the site's brand."""
    best = candidates.groupBy("site", "domain").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "name", "url")).alias("b")
    )
    brand = brand_from_domain(F.col("domain"))
    return best.select("site", "domain", brand.alias("brand"), F.col("b.name").alias("name"), F.col("b.url").alias("url"), (-F.col("b.s")).alias("score")).filter(
        plausible_entity(F.col("brand"), F.col("name"), F.col("url"), F.col("domain"))
    )
