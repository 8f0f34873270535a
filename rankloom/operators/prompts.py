"""Prompts for a page judge and the tables made of its replies. The judge itself is the caller's."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import model_json
from rankloom.operators.similarity import perf_order
from rankloom.schemas import DIFF_PLAN, JUDGEMENT

MAX_PAGES = 6

JUDGE_TASK = "As páginas abaixo parecem similares. Diga se são redundantes (spun), pobres (raso) ou distintas (ok). Responda só JSON: {\"verdict\", \"base_recomendada\", \"lacunas\", \"resumo\"}."
DIFF_TASK = "Dê a cada página abaixo uma intenção e uma keyword próprias, sem remover nenhuma. Responda só JSON: {\"cabeca\", \"paginas\": [{\"slug\", \"papel\", \"intencao\", \"keyword_alvo\", \"titulo\", \"foco\"}]}."


def _page_blocks(groups: DataFrame, members: DataFrame, texts: DataFrame, max_chars: int, max_pages: int) -> DataFrame:
    """The best pages of each chosen group as ordered text blocks; text is joined to those few rows only."""
    key = ["site", "cluster"]
    w = Window.partitionBy(*key).orderBy(perf_order())
    shown = members.join(groups.select(*key), key, "left_semi").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= max_pages)
    rows = shown.join(texts.select("site", "page", "text"), ["site", "page"], "left")
    position = F.when(F.col("position").isNull(), "s/d").otherwise(F.format_string("%.1f", "position"))
    block = F.format_string(
        "--- PÁGINA %d (slug: %s) [posição %s, %d cliques, %d impressões] ---\n%s",
        "i", "page", position, "clicks", "impressions", F.substring(F.coalesce("text", F.lit("")), 1, max_chars),
    )
    return rows.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("blocks"),
        F.min(F.struct("i", "page"))["page"].alias("best"), F.count("*").alias("shown"),
    )


def judgement_prompts(groups: DataFrame, members: DataFrame, texts: DataFrame, task: str = JUDGE_TASK, max_chars: int = 1500, max_pages: int = MAX_PAGES) -> DataFrame:
    """M03. One prompt per chosen group (L02)."""
    b = _page_blocks(groups, members, texts, max_chars, max_pages)
    omitted = F.col("size") - F.col("shown")
    tail = F.when(omitted > 0, F.format_string("\n\n(+%d páginas omitidas)", omitted)).otherwise("")
    return groups.join(b, ["site", "cluster"]).select(
        "site", "cluster", "rank", "size", omitted.alias("omitted"), F.lit(task).alias("system"),
        F.concat(F.format_string("%d páginas similares\n\n", "size"), "blocks", tail).alias("prompt"),
    )


def differentiation_prompts(groups: DataFrame, members: DataFrame, texts: DataFrame, task: str = DIFF_TASK, max_chars: int = 1200, max_pages: int = MAX_PAGES) -> DataFrame:
    """M05. As M03, naming the best performer as the likely head."""
    b = _page_blocks(groups, members, texts, max_chars, max_pages)
    omitted = F.col("size") - F.col("shown")
    tail = F.when(omitted > 0, F.format_string("\n\n(+%d páginas omitidas)", omitted)).otherwise("")
    return groups.join(b, ["site", "cluster"]).select(
        "site", "cluster", "rank", "size", omitted.alias("omitted"), "best", F.lit(task).alias("system"),
        F.concat(F.format_string("%d páginas competem\nMelhor desempenho: %s\n\n", "size", "best"), "blocks", tail).alias("prompt"),
    )


def score_prompts(prompts: DataFrame, chat) -> DataFrame:
    """D02. ``chat(system, user) -> str`` over every prompt; a failing call leaves an empty reply and its error."""
    def run(frames):
        for pdf in frames:
            replies, errors = [], []
            for system, user in zip(pdf["system"], pdf["prompt"]):
                try:
                    replies.append(str(chat(system, user)))
                    errors.append(None)
                except Exception as exc:
                    replies.append("")
                    errors.append(str(exc))
            yield pd.DataFrame({"site": pdf["site"], "cluster": pdf["cluster"], "reply": replies, "error": errors})

    return prompts.select("site", "cluster", "system", "prompt").mapInPandas(run, "site string, cluster string, reply string, error string")


def judgements(replies: DataFrame, raw_chars: int = 200) -> DataFrame:
    """M04. Verdict table of the replies; an unreadable reply keeps its first ``raw_chars`` characters."""
    body = model_json(F.col("reply"))
    j = replies.withColumn("body", body).withColumn("v", F.from_json("body", JUDGEMENT))
    blank = F.array().cast("array<string>")
    return j.select(
        "site", "cluster", F.coalesce("v.verdict", F.lit("?")).alias("verdict"),
        F.coalesce("v.base_recomendada", F.lit("")).alias("base_page"), F.coalesce("v.lacunas", blank).alias("gaps"),
        F.when(F.col("body").isNull(), F.substring("reply", 1, raw_chars)).otherwise(F.coalesce("v.resumo", F.lit(""))).alias("summary"),
        F.col("body").isNotNull().alias("raw_ok"),
    )


def differentiation_plan(replies: DataFrame, members: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """M06. One row per planned page; the head defaults to the best performer of its group."""
    best = members.groupBy("site", "cluster").agg(F.min(perf_order())["g"].alias("best"))
    p = replies.withColumn("p", F.from_json(model_json(F.col("reply")), DIFF_PLAN)).join(best, ["site", "cluster"], "left")
    head = F.when(F.coalesce("p.cabeca", F.lit("")) != "", F.col("p.cabeca")).otherwise(F.col("best"))
    rows = p.select("site", "cluster", head.alias("head"), F.posexplode("p.paginas").alias("pos", "e"))
    text = lambda c, d="": F.coalesce(F.col(f"e.{c}"), F.lit(d))
    return rows.select(
        "site", "cluster", "head", "pos", text("slug").alias("slug"), text("papel", "spoke").alias("role"), text("intencao").alias("intent"),
        text("keyword_alvo").alias("keyword"), text("titulo").alias("title"), text("foco").alias("focus"),
    )


def planned_keywords(plan: DataFrame, perf: DataFrame) -> DataFrame:
    """M06. (site, cluster, slug, keyword, impressions) of the plan's pages with their group's impressions, as the keyword audits take them."""
    return plan.join(perf.select("site", "cluster", F.col("group_impressions").alias("impressions")), ["site", "cluster"]).select("site", "cluster", "slug", "keyword", "impressions")


def omitted_pages(groups: DataFrame, members: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """M06. Pages of the chosen groups beyond the prompt, one row each.

    The shown pages are found with a rank limit and taken away, so a huge group is not sorted in one task.
    """
    key = ["site", "cluster"]
    chosen = members.join(groups.select(*key), key, "left_semi")
    w = Window.partitionBy(*key).orderBy(perf_order())
    shown = chosen.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= max_pages).select(*key, "page")
    return chosen.select(*key, "page").join(shown, [*key, "page"], "left_anti")
