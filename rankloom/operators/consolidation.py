"""Redirect plan over the cannibalization groups (G04).

The rule is a walk over the groups of a site from the most to the least severe: the best URL that is
not redirected yet is the canonical one, the others redirect to it unless they are canonical or
redirected already. A URL changes its state at most once, from free to redirected or to canonical,
and a group matters only while it would redirect one of its free URLs. A free URL is owned by the first
such group that holds it. A group's target is certain when its best URL is canonical already, or
when the group owns it and owns another free URL, which will then leave. All URLs that such groups own are settled
together, also when other URLs of the group still wait. The first open group of a site always qualifies, so every
round settles some, and no site, component or hot URL is ever gathered in one task.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut

_KEYS = ["site", "gkey"]


def _rows(members: DataFrame) -> DataFrame:
    return members.select(
        "site",
        F.struct((-F.col("severity_score")).alias("s"), (-F.col("url_count")).alias("n"), F.col("query").alias("q")).alias("gkey"),
        F.struct(
            (-F.col("clicks")).alias("c"), F.coalesce("position", F.lit(9999.0)).alias("p"),
            (-F.col("impressions")).alias("i"), F.col("url").alias("u"),
        ).alias("fit"),
        "severity",
    )


@dataclass(frozen=True)
class Numbered:
    """Member rows, stored twice: ``names`` (site, gkey, fit, severity, at) and ``numbers`` (g, at, u).

    ``at`` numbers the rows in the order of site, group and fitness, ``g`` is the number of their group's first row and ``u`` that of
    their URL's first row. The rounds see numbers only.
    """

    names: DataFrame
    numbers: DataFrame


def number_members(members: DataFrame) -> Numbered:
    """The member rows in numbers. They are stored before they are dealt by range, which reads them twice; so no site is sorted in one task."""
    rows, order = cut(_rows(members)), ["site", "gkey", "fit"]
    names = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    groups = names.groupBy(*_KEYS).agg(F.min("at").alias("g"))
    urls = names.groupBy("site", F.col("fit.u").alias("url")).agg(F.min("at").alias("u"))
    own = names.select(*_KEYS, "at", F.col("fit.u").alias("url")).join(groups, _KEYS)
    numbers = own.alias("o").join(urls.alias("n"), (F.col("o.site") == F.col("n.site")) & F.col("o.url").eqNullSafe(F.col("n.url")))
    return Numbered(names, cut(numbers.select("g", "at", "u")))


def url_states(members: DataFrame, numbered: Numbered | None = None) -> DataFrame:
    """Final state of every URL that got one: (site, url, kind, to_url, gkey and fit in the deciding group, severity, clicks_from, clicks_to) and the numbers (u, g, to_u)."""
    numbered = number_members(members) if numbered is None else numbered
    decided, names = _decided(numbered.numbers), numbered.names
    clicks, at = -F.col("fit.c"), F.col("at")
    target = names.select(at.alias("to_at"), F.col("fit.u").alias("best_url"), clicks.alias("clicks_to"))
    own = names.select("site", F.col("fit.u").alias("url"), "at", "gkey", "fit", "severity", clicks.alias("clicks_from"))
    goals = numbered.numbers.select(at.alias("to_at"), F.col("u").alias("to_u"))
    found = decided.join(goals, "to_at").join(own, "at").join(target, "to_at")
    return cut(found.select(
        "site", "url", F.when(F.col("stays"), "canonical").otherwise("redirect").alias("kind"), F.when(~F.col("stays"), F.col("best_url")).alias("to_url"),
        "gkey", "fit", "severity", "clicks_from", "clicks_to", "u", "g", "to_u"))


def _decided(numbers: DataFrame) -> DataFrame:
    """(u, g, at, stays, to_at) of every URL that got a state: the deciding row and group, whether the URL is canonical, and the row of the group's best URL.

    A group's best candidate is one number: that of its row, doubled, and one more when its URL is canonical already.
    """
    free, canonical = F.col("stays").isNull(), F.col("best") % 2 == 1
    active = numbers.withColumn("stays", F.lit(None).cast("boolean"))
    decided = None
    while True:
        # a group can act when a free URL other than its best candidate exists; redirected URLs are no rows of it any more
        groups = active.groupBy("g").agg(F.count_if(free).alias("n_free"), F.min(F.col("at") * 2 + F.when(free, 0).otherwise(1)).alias("best"))
        groups = groups.filter((F.col("n_free") >= 2) | ((F.col("n_free") == 1) & canonical))
        open_rows = cut(active.join(groups.select("g", "best"), "g"))
        # rows are numbered in the order of their groups, so a URL's first row is that of its first group
        owned = open_rows.filter(free).groupBy("u").agg(F.min_by("g", "at").alias("g"), F.min_by("best", "at").alias("best"), F.min("at").alias("at"))
        best_at = F.shiftright("best", 1)
        is_best = F.col("at") == best_at
        sure = owned.groupBy("g").agg(F.count_if(~is_best).alias("leave"), F.bool_or(is_best | canonical).alias("fixed"))
        sure = sure.filter((F.col("leave") > 0) & F.col("fixed")).select("g")
        new = cut(owned.join(sure, "g").select("u", "g", "at", is_best.alias("stays"), best_at.alias("to_at")))
        if new.isEmpty():
            break
        decided = new if decided is None else decided.unionByName(new)
        fresh = new.select("u", F.col("stays").alias("now"))
        active = open_rows.join(fresh, "u", "left").select("g", "at", "u", F.coalesce("stays", "now").alias("stays")).filter(free | F.col("stays"))
    return new if decided is None else decided


def consolidation_plan(members: DataFrame, states: DataFrame | None = None, place: bool = False) -> DataFrame:
    """G04. Redirect rows, one per URL; no target is itself redirected. With ``place``, also a column to sort a site's plan by."""
    states = url_states(members) if states is None else states
    return states.filter(F.col("kind") == "redirect").select(
        "site", F.col("url").alias("from_url"), "to_url", F.col("gkey.q").alias("keyword"), "severity", "clicks_from", "clicks_to",
        *([F.struct("gkey", "fit").alias("place")] if place else []),
    )


def consolidation_totals(plan: DataFrame) -> DataFrame:
    """G04. Groups of a site that redirect something, and its redirects."""
    return plan.groupBy("site").agg(F.countDistinct("keyword").alias("total_groups"), F.count("*").alias("total_redirects"))


def consolidation_conflicts(members: DataFrame, states: DataFrame | None = None, numbered: Numbered | None = None) -> DataFrame:
    """G04. Why a URL of a group was not redirected to that group's canonical URL.

    ``states`` are used with the ``numbered`` rows they were found on; without those the walk is done again.
    """
    if numbered is None:
        numbered, states = number_members(members), None
    states = url_states(members, numbered) if states is None else states
    st = states.select("u", (F.col("kind") == "redirect").alias("left"), F.col("g").alias("by"), "to_u", F.col("to_url").alias("kept"))
    rows = numbered.numbers.join(st, "u", "left").withColumn("earlier", F.coalesce(F.col("by") < F.col("g"), F.lit(False)))
    moved = F.col("earlier") & F.col("left")
    best = rows.groupBy("g").agg(F.min(F.when(~moved, F.col("at"))).alias("best_at"), F.min_by("u", F.when(~moved, F.col("at"))).alias("best_u"), F.min("at").alias("at"))
    ignored = best.filter(F.col("best_at").isNull()).select(
        "at", F.lit("grupo_ignorado").alias("conflict"), F.lit(None).cast("string").alias("kept_target"),
    )
    seen = rows.filter("earlier").join(best.filter(F.col("best_at").isNotNull()).select("g", "best_u"), "g").filter(F.col("u") != F.col("best_u"))
    clashes = seen.filter(~moved | (F.col("to_u") != F.col("best_u"))).select(
        "at", F.when(~moved, "canonica_de_outro_grupo").otherwise("destino_mantido").alias("conflict"),
        F.when(moved, F.col("kept")).alias("kept_target"),
    )
    names = numbered.names.select("at", "site", F.col("gkey.q").alias("keyword"), F.col("fit.u").alias("url"))
    told = ignored.unionByName(clashes).join(names, "at")
    return told.select("site", "keyword", F.when(F.col("conflict") != "grupo_ignorado", F.col("url")).alias("url"), "conflict", "kept_target")
