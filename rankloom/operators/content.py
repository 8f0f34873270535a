"""Content quality of pages: target keywords, density sources, entity signals, verdicts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.urls import slug_phrase
from rankloom.functions.wordlists import VERDICT_ORDER
from rankloom.lineage import cut
from rankloom.operators.entities import thousandths

MIN_WORDS, THIN_WORDS = 300, 180
DENSITY_HIGH, DENSITY_VERY_HIGH = 3.0, 5.0
EXACT_REPEATS, LOW_DIVERSITY, HIGH_CONCENTRATION, FEW_ENTITIES = 8, 0.35, 0.55, 4

# Which flags count as over-optimisation and which as thin content.
OVER_FLAGS = (
    "densidade_alta", "densidade_muito_alta", "repeticao_exata_alta", "vocabulario_repetitivo",
    "saliencia_concentrada", "keyword_nao_saliente",
)
THIN_FLAGS = ("conteudo_curto", "amplitude_pobre", "nao_classificavel")


def target_keywords(query_page: DataFrame, top: int = 3, min_impressions: int = 1) -> DataFrame:
    """J07. The queries a URL gets most impressions for, best first."""
    w = Window.partitionBy("site", "url").orderBy(F.desc("impressions"), "query")
    seen = query_page.filter((F.col("impressions") >= min_impressions) & (F.trim("query") != ""))
    per_query = seen.groupBy("site", "url", "query").agg(F.max("impressions").alias("impressions"))
    ranked = per_query.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.groupBy("site", "url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "query"))), lambda x: x["query"]).alias("keywords")
    )


def entity_signals(analysed: DataFrame, entities: DataFrame, categories: DataFrame) -> DataFrame:
    """A20. Per analysed page: breadth, concentration and the names of its top entities."""
    page = ["site", "url"]
    parts = thousandths("salience")
    e = entities.groupBy(*page).agg(
        F.countDistinct(F.when(F.col("name") != "", F.lower("name"))).alias("entity_count"),
        F.when(F.sum(parts) > 0, F.round(F.max(parts) / F.sum(parts), 3)).alias("salience_concentration"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", F.lower("name").alias("name"))))),
            lambda x: x["name"],
        ).alias("top_names"),
        F.count("*").alias("n_entities"),
    )
    c = categories.groupBy(*page).agg(F.count("*").alias("n_categories"))
    return analysed.select(*page).distinct().join(e, page, "left").join(c, page, "left").select(
        *page,
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "salience_concentration",
        F.coalesce("top_names", F.array().cast("array<string>")).alias("top_names"),
        F.coalesce("n_entities", F.lit(0)).alias("n_entities"),
        (F.coalesce("n_categories", F.lit(0)) > 0).alias("classified"),
    )


def keyword_in_entities(keywords, names):
    """A20. Whether any keyword and any top entity name contain each other."""
    def meets(k):
        return F.exists(names, lambda n: (n != "") & (F.contains(n, k) | F.contains(k, n)))

    return F.exists(keywords, lambda k: (F.trim(k) != "") & meets(F.lower(F.trim(k))))


def text_measures(pages: DataFrame) -> DataFrame:
    """Tokens and their derived measures, all inside the page's own row."""
    return (
        pages.withColumn("low", F.lower("text"))
        .withColumn("folded", tx.fold_text(F.col("low")))
        .withColumn("tokens", F.regexp_extract_all("low", F.lit(tx.TOKEN), F.lit(0)))
        .withColumn("folded_tokens", F.regexp_extract_all("folded", F.lit(tx.TOKEN), F.lit(0)))
        .withColumn("word_count", F.size("tokens"))
        .withColumn("vocab_diversity", tx.vocab_diversity(F.col("tokens")))
        .withColumn("ngram", tx.dominant_ngram(F.col("folded_tokens")))
        .drop("tokens")
    )


def content_verdicts(pages: DataFrame, keywords: DataFrame, signals: DataFrame) -> DataFrame:
    """A23. Flags and verdict of every page (site, url, text)."""
    page = ["site", "url"]
    # the raw text moves once, dealt by page whatever the size: everything derived from it comes after the joins
    m = text_measures(pages.select(*page, "text").repartition(*page).join(keywords, page, "left").join(signals, page, "left"))
    m = m.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>"))).withColumn(
        "slug", slug_phrase(F.col("url"))
    ).withColumn("slug_folded", tx.fold_accents(F.col("slug")))
    kind = "array<struct<density:double,priority:int,occ:int,keyword:string,source:string>>"
    counted = F.transform("keywords", lambda k, i: F.struct(k.alias("k"), i.alias("i"), tx.phrase_count(F.col("low"), k).alias("occ")))
    from_queries = F.transform(
        counted,
        lambda x: F.struct(
            tx.density(x["occ"], tx.phrase_words(x["k"]), F.col("word_count")).alias("density"),
            (-x["i"]).alias("priority"), x["occ"].alias("occ"), x["k"].alias("keyword"), F.lit("query").alias("source"),
        ),
    ).cast(kind)
    slug_occ = tx.phrase_count(F.col("folded"), F.col("slug_folded"))
    from_slug = F.when(
        F.col("slug").isNotNull(),
        F.array(F.struct(
            tx.density(slug_occ, tx.phrase_words(F.col("slug_folded")), F.size("folded_tokens")), F.lit(-100), slug_occ, "slug", F.lit("slug"),
        )).cast(kind),
    )
    from_ngram = F.when(
        F.col("ngram").isNotNull(),
        F.array(F.struct(
            tx.density(F.col("ngram.cnt"), F.col("ngram.n"), F.col("word_count")), F.lit(-200), F.col("ngram.cnt"), F.col("ngram.phrase"), F.lit("ngram"),
        )).cast(kind),
    )
    none = F.array().cast(kind)
    candidates = F.concat(from_queries, F.coalesce(from_slug, none), F.coalesce(from_ngram, none))
    m = m.withColumn("top", F.array_max(F.filter(candidates, lambda c: c["density"] > 0)))
    m = m.withColumn("keyword_density", F.coalesce("top.density", F.lit(0.0))).withColumn(
        "exact_repetitions", F.when(F.size("keywords") > 0, tx.phrase_count(F.col("low"), F.try_element_at("keywords", F.lit(1)))).otherwise(0)
    ).withColumn(
        "target_in_salient",
        F.when((F.col("n_entities") > 0) & (F.size("keywords") > 0), keyword_in_entities(F.col("keywords"), F.col("top_names"))),
    )
    d = F.col("keyword_density")
    flags = F.array_compact(F.array(
        F.when(F.col("word_count") < MIN_WORDS, F.lit("conteudo_curto")),
        F.when(d >= DENSITY_VERY_HIGH, F.lit("densidade_muito_alta")).when(d >= DENSITY_HIGH, F.lit("densidade_alta")),
        F.when(F.col("exact_repetitions") >= EXACT_REPEATS, F.lit("repeticao_exata_alta")),
        F.when((F.col("word_count") > 0) & (F.col("vocab_diversity") < LOW_DIVERSITY), F.lit("vocabulario_repetitivo")),
        F.when(F.col("salience_concentration") >= HIGH_CONCENTRATION, F.lit("saliencia_concentrada")),
        F.when((F.col("entity_count") < FEW_ENTITIES) & (F.col("n_entities") > 0), F.lit("amplitude_pobre")),
        F.when(~F.col("classified"), F.lit("nao_classificavel")),
        F.when(~F.col("target_in_salient"), F.lit("keyword_nao_saliente")),
    ))
    over = F.size(F.array_intersect("flags", F.array(*[F.lit(f) for f in OVER_FLAGS])))
    thin = F.size(F.array_intersect("flags", F.array(*[F.lit(f) for f in THIN_FLAGS])))
    verdict = (
        F.when((F.col("word_count") < THIN_WORDS) | (thin >= 2), "raso").when(over >= 2, "over_otimizado")
        .when((over >= 1) | (thin >= 1), "atencao").otherwise("ok")
    )
    return m.withColumn("flags", flags).select(
        *page, "word_count", "keyword_density", F.col("top.keyword").alias("densest_keyword"),
        F.col("top.source").alias("density_source"), F.coalesce("top.occ", F.lit(0)).alias("keyword_occurrences"),
        "exact_repetitions", "vocab_diversity", "entity_count", "salience_concentration", "target_in_salient",
        "classified", "flags", verdict.alias("verdict"),
    )


def verdict_listing(results: DataFrame) -> DataFrame:
    """L06. Worst verdicts first. The rows are stored before they are sorted, because a sort reads its input twice and the texts' work is in it."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICT_ORDER]), F.col("verdict"))
    return cut(results.select(
        "site", "url", "verdict", rank.alias("verdict_rank"), "word_count", "keyword_density",
        "densest_keyword", "density_source", "vocab_diversity",
    )).orderBy("site", "verdict_rank", "url")
