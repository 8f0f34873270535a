"""Internal links: extraction, resolution to pages, audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import normalize_keyword, squeeze, unescape, without_code
from rankloom.functions.urls import href_slug
from rankloom.functions.wordlists import GENERIC_ANCHORS


def extract_links(pages: DataFrame) -> DataFrame:
    """X20. Every <a href> of (site, page, markup) with its anchor text, in page order."""
    # fixed value: the pattern decides the result
    anchor_tag = F.lit(r"(?is)<a\b([^>]*?)>(.*?)</a>")
    tags = F.arrays_zip(
        F.regexp_extract_all("bare", anchor_tag, F.lit(1)).alias("attrs"), F.regexp_extract_all("bare", anchor_tag, F.lit(2)).alias("inner")
    )
    rows = pages.select("site", "page", without_code(F.col("markup")).alias("bare")).select("site", "page", F.posexplode(tags).alias("pos", "tag"))
    # fixed value: the pattern decides the result
    href = r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    attrs = F.col("tag.attrs")
    return rows.filter(attrs.rlike(href)).select(
        "site", "page", "pos",
        F.concat(*[F.regexp_extract(attrs, href, k) for k in (1, 2, 3)]).alias("href"),
        squeeze(unescape(F.regexp_replace("tag.inner", "<[^>]+>", " "))).alias("anchor"),
    )


def link_edges(links: DataFrame, known: DataFrame) -> DataFrame:
    """J09. Links between known pages (site, page); self links and unknown targets drop out.

    Pages with the same slug resolve to the smallest page. The known side has one row per slug, so a
    slug that most links point to is a skewed but single-match join that AQE splits.
    """
    slug = F.coalesce(href_slug(F.col("page")), F.col("page"))
    targets = known.select("site", slug.alias("slug"), "page").groupBy("site", "slug").agg(F.min("page").alias("dst"))
    out = links.select("site", F.col("page").alias("src"), href_slug(F.col("href")).alias("slug"), "anchor").filter(F.col("slug").isNotNull())
    return out.join(targets, ["site", "slug"]).filter(F.col("src") != F.col("dst")).select("site", "src", "dst", "anchor")


def link_orphans(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """J10."""
    return targets.select("site", "page").join(edges.select("site", F.col("dst").alias("page")), ["site", "page"], "left_anti")


def inlink_report(targets: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """A10. Distinct linking and linked pages with the metrics of each target (site, page, clicks, impressions, position)."""
    pairs = edges.select("site", "src", "dst").distinct()
    inn = pairs.groupBy("site", F.col("dst").alias("page")).agg(F.count("*").alias("inlinks"))
    out = pairs.groupBy("site", F.col("src").alias("page")).agg(F.count("*").alias("outlinks"))
    key = ["site", "page"]
    return targets.select(*key).join(inn, key, "left").join(out, key, "left").join(metrics, key, "left").select(
        *key, F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.coalesce("outlinks", F.lit(0)).alias("outlinks"),
        F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "position",
    )


def underlinked_pages(report: DataFrame, max_inlinks: int = 1, min_impressions: int = 1) -> DataFrame:
    """F04."""
    return report.filter((F.col("inlinks") <= max_inlinks) & (F.col("impressions") >= min_impressions)).orderBy(
        "site", F.desc("impressions"), "inlinks", "page"
    )


def anchor_collisions(edges: DataFrame, min_targets: int = 2) -> DataFrame:
    """A11. Anchors that lead to several pages, one row per anchor and page."""
    named = edges.select("site", normalize_keyword(F.col("anchor")).alias("anchor"), "dst")
    uses = named.filter((F.col("anchor") != "") & ~F.col("anchor").isin(*GENERIC_ANCHORS)).groupBy("site", "anchor", "dst").agg(F.count("*").alias("uses"))
    wide = uses.groupBy("site", "anchor").agg(F.count("*").alias("targets")).filter(F.col("targets") >= min_targets)
    return uses.join(wide, ["site", "anchor"]).select("site", "anchor", "targets", "dst", "uses")


#: Fixed patterns of the templates that print links from a named list: a loop over it, a random pick, a slice, another name for it, an
#: included file; and the call that turns an entry into an address.
LIST_LOOP = r"(?i)foreach\s*\(\s*(?:array_slice\s*\(\s*)?\$(\w+)"
LIST_PICK = r"(?i)array_rand\s*\(\s*\$(\w+)"
LIST_SLICE = r"(?i)array_slice\s*\(\s*\$(\w+)"
LIST_ALIAS = r"\$(\w+)\s*=\s*\$(\w+)\s*;"
INCLUDED = r"(?i)(?:include|require)(?:_once)?\s*\(?\s*[\"']([^\"']+)[\"']"
ADDRESS_CALL = "formatStringToURL"


def _shown_lists(texts: DataFrame, keys: list, lists: DataFrame) -> DataFrame:
    """(keys, list, mode) of template texts: the whole list in a loop is an index, a slice or a random pick of it a widget."""
    found = texts.filter(F.contains(F.col("text"), F.lit(ADDRESS_CALL)))
    part = lambda pattern, kind: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v, i: F.struct(v.alias("var"), F.lit(kind).alias("kind"), i.alias("at")))
    slices = F.regexp_extract_all("text", F.lit(LIST_SLICE), F.lit(1))
    uses = found.select(*keys, slices.alias("sliced"), F.explode(F.concat(part(LIST_LOOP, "loop"), part(LIST_PICK, "part"), part(LIST_SLICE, "part"))).alias("u")).select(
        *keys, "u.var", "u.kind", "u.at", F.array_contains("sliced", F.col("u.var")).alias("cut"))
    names = F.arrays_zip(F.regexp_extract_all("text", F.lit(LIST_ALIAS), F.lit(1)).alias("var"), F.regexp_extract_all("text", F.lit(LIST_ALIAS), F.lit(2)).alias("list"))
    alias = found.select(*keys, F.posexplode(names).alias("at", "a")).select(*keys, "at", "a.var", "a.list").join(lists, ["site", "list"], "left_semi")
    alias = alias.groupBy(*keys, "var").agg(F.max_by("list", "at").alias("list"))
    own = lists.select("site", F.col("list").alias("var"), F.col("list").alias("named"))
    real = uses.join(own, ["site", "var"], "left").join(alias, [*keys, "var"], "left").withColumn("list", F.coalesce("named", "list")).filter("list is not null")
    last = F.max_by("cut", F.when(F.col("kind") == "loop", F.col("at")))
    return real.groupBy(*keys, "list").agg(F.when(F.count_if(F.col("kind") == "loop") == 0, "widget").when(last, "widget").otherwise("index").alias("mode"))


def list_emitters(markup: DataFrame, files: DataFrame, lists: DataFrame) -> DataFrame:
    """J12. (site, src, list, mode): lists a page's template prints links from, read from its own markup and the files it includes.

    ``files`` has (site, path, text), ``lists`` (site, list). What the page itself shows goes before what it includes, an earlier file before a later one.
    """
    names = lists.select("site", "list").distinct()
    own = _shown_lists(markup.select("site", "page", F.col("markup").alias("text")), ["site", "page"], names).withColumn("at", F.lit(-1))
    path = F.regexp_replace("path", r"^(\./)+", "")
    wanted = markup.select("site", "page", F.posexplode(F.regexp_extract_all("markup", F.lit(INCLUDED), F.lit(1))).alias("at", "path")).withColumn("path", path)
    shared = _shown_lists(files.withColumn("path", path).select("site", "path", "text"), ["site", "path"], names)
    both = own.unionByName(wanted.join(shared, ["site", "path"]).select("site", "page", "list", "mode", "at"))
    return both.groupBy("site", "page", "list").agg(F.min_by("mode", "at").alias("mode")).select("site", F.col("page").alias("src"), "list", "mode")


def hub_choice(members: DataFrame, perf: DataFrame, plan: DataFrame | None = None, min_size: int = 2) -> DataFrame:
    """J11. (site, cluster, hub, hub_keyword, spoke, keyword) of every group of enough pages.

    A planned group takes the plan's head, or its first page, and the planned pages; another one the best performing page, or the
    representative, and its members.
    """
    key = ["site", "cluster"]
    large = perf.filter(F.col("size") >= min_size)
    free = large.select(*key, F.coalesce("canonical", "representative").alias("hub"))
    parts = []
    if plan is not None:
        pages = plan.filter(F.col("slug") != "").join(large.select(*key), key, "left_semi")
        heads = pages.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("head") != "", F.col("head"))), F.min_by("slug", "pos")).alias("hub"))
        heads = heads.join(pages.select(*key, F.col("slug").alias("hub"), F.col("keyword").alias("hub_keyword"), "pos"), [*key, "hub"], "left").groupBy(*key, "hub").agg(
            F.coalesce(F.min_by("hub_keyword", "pos"), F.lit("")).alias("hub_keyword"))
        parts = [pages.join(heads, key).filter(F.col("slug") != F.col("hub")).select(*key, "hub", "hub_keyword", F.col("slug").alias("spoke"), "keyword")]
        free = free.join(heads.select(*key), key, "left_anti")
    rest = members.join(free, key).filter(F.col("page") != F.col("hub")).select(*key, "hub", F.lit("").alias("hub_keyword"), F.col("page").alias("spoke"), F.lit("").alias("keyword"))
    return parts[0].unionByName(rest) if parts else rest


def template_inbound(emitters: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """J12. Kinds of list links (index, widget) a page receives from other pages.

    A member gets a kind when some emitter of its list is another page, so emitters are only counted:
    a list is never multiplied out into emitter x member pairs.
    """
    shown = emitters.select("site", "src", "list", "mode").distinct()
    count = shown.groupBy("site", "list", "mode").agg(F.count("*").alias("emitters"))
    own = shown.select("site", "list", "mode", F.col("src").alias("dst"), F.lit(1).alias("own"))
    reach = members.select("site", "list", "dst").distinct().join(count, ["site", "list"]).join(own, ["site", "list", "mode", "dst"], "left")
    from_others = reach.filter(F.col("emitters") > F.coalesce("own", F.lit(0)))
    return from_others.join(known.select("site", F.col("page").alias("dst")).distinct(), ["site", "dst"], "left_semi").select("site", "dst", "mode").distinct()


def link_tiers(targets: DataFrame, edges: DataFrame, inbound: DataFrame) -> DataFrame:
    """A12. contextual, template_only or orphan."""
    ctx = edges.select("site", "src", "dst").distinct().groupBy("site", F.col("dst").alias("page")).agg(F.count("*").alias("contextual"))
    tpl = inbound.groupBy("site", F.col("dst").alias("page")).agg(F.array_sort(F.collect_set("mode")).alias("template"))
    key = ["site", "page"]
    return targets.select(*key).join(ctx, key, "left").join(tpl, key, "left").select(
        *key, F.coalesce("contextual", F.lit(0)).alias("contextual"),
        F.coalesce(F.array_join("template", ","), F.lit("")).alias("template"),
        F.when(F.col("contextual") > 0, "contextual").when(F.col("template").isNotNull(), "template_only").otherwise("orphan").alias("tier"),
    )


def tier_counts(tiers: DataFrame) -> DataFrame:
    """A12. Pages per tier and site."""
    return tiers.groupBy("site", "tier").agg(F.count("*").alias("pages"))


def hub_spoke_links(spokes: DataFrame, edges: DataFrame) -> DataFrame:
    """J11. Per spoke (site, cluster, hub, spoke): whether it links its hub and its hub links it."""
    pairs = edges.select("site", "src", "dst").distinct()
    up = pairs.select("site", F.col("src").alias("spoke"), F.col("dst").alias("hub"), F.lit(True).alias("up"))
    down = pairs.select("site", F.col("src").alias("hub"), F.col("dst").alias("spoke"), F.lit(True).alias("down"))
    on = ["site", "hub", "spoke"]
    return spokes.join(up, on, "left").join(down, on, "left").select(
        "site", "cluster", "hub", "spoke",
        F.coalesce("up", F.lit(False)).alias("links_hub"), F.coalesce("down", F.lit(False)).alias("linked_by_hub"),
    )


def hub_spoke_gaps(links: DataFrame) -> DataFrame:
    """J11. Missing links per group."""
    return links.groupBy("site", "cluster", "hub").agg(
        F.count("*").alias("spokes_total"),
        F.count_if(~F.col("links_hub")).alias("missing_to_hub"),
        F.count_if(F.col("links_hub")).alias("have_to_hub"),
        F.count_if(~F.col("linked_by_hub")).alias("missing_from_hub"),
    ).withColumn("complete", (F.col("missing_to_hub") == 0) & (F.col("missing_from_hub") == 0))
