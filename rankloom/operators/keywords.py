"""Collisions between the target keywords of pages in differentiation plans.

Items are (site, cluster, slug, keyword, impressions); their order is (cluster, slug, keyword).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import content_tokens, normalize_keyword
from rankloom.lineage import cut
from rankloom.operators.setjoin import ordered_jaccard_pairs, ordered_subset_pairs, rare_first

#: Sets of a site that the first round of near_groups settles, and how many times as far each next one reaches.
FIRST_PREFIX, GROWTH = 512, 8


def keyword_items(plan: DataFrame) -> DataFrame:
    items = plan.withColumn("norm", normalize_keyword(F.col("keyword"))).filter(F.col("norm") != "")
    return items.withColumn("tokens", F.array_sort(content_tokens(F.col("norm")))).withColumn("ord", F.struct("cluster", "slug", "keyword"))


def _collisions(groups: DataFrame, key: list, kind: str) -> DataFrame:
    owner = F.min(F.struct((-F.col("impressions")).alias("i"), "ord"))
    return groups.groupBy(*key).agg(
        owner["ord"].alias("o"), F.count("*").alias("n"), F.sum("impressions").alias("impr_total"),
        F.countDistinct("slug").alias("slugs"), (F.countDistinct("cluster") >= 2).alias("cross_cluster"),
    ).filter("n >= 2 and slugs >= 2").select(
        *key, F.lit(kind).alias("kind"), F.col("o.keyword").alias("keyword"), F.col("o.cluster").alias("owner_cluster"),
        F.col("o.slug").alias("owner_slug"), "n", "impr_total", "cross_cluster",
    )


def exact_collisions(items: DataFrame) -> DataFrame:
    """A13. The same normalised keyword on two or more pages."""
    return _collisions(items, ["site", "norm"], "exata")


def near_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(site, left, right): pairs of different sets of two rare_first tables that are near: by Jaccard, or one inside the other."""
    similar = ordered_jaccard_pairs(left, right, threshold).select("site", "left", "right").filter(F.col("left") != F.col("right"))
    around = ordered_subset_pairs(right, left).select("site", F.col("right").alias("left"), F.col("left").alias("right"))
    return similar.unionByName(ordered_subset_pairs(left, right)).unionByName(around).distinct()


def near_sets(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """J13. (site, left, right) token sets, both of two or more words, that are near: subset or Jaccard."""
    ordered = cut(rare_first(items.filter(F.size("tokens") >= 2)))
    return near_between(ordered, ordered, threshold)


def numbered(sets: DataFrame) -> DataFrame:
    """(site, tokens, idx): the place of every set (site, tokens, ord) in its site's order, from 0. Rows are dealt by range, so that no site is sorted in one task."""
    dealt = cut(sets.repartitionByRange("site", "ord").sortWithinPartitions("site", "ord").select("site", "tokens", F.monotonically_increasing_id().alias("at")))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    parts = dealt.groupBy("site", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.sum("n").over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("site", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    return dealt.join(starts, ["site", "part"]).select("site", "tokens", (F.col("at") + F.col("shift")).alias("idx"))


def near_groups(items: DataFrame, threshold: float = 0.7, prefix: int = FIRST_PREFIX, growth: int = GROWTH) -> DataFrame:
    """J13. (site, tokens, seed): the token set whose first item opened the group.

    In item order, an unused set opens a group and takes every later set near to it. A round settles the next stretch of every
    site, ``growth`` times as long as all before: near pairs are looked for among the stretch's free sets only, and the sets that open a group
    then take the later ones near to them. A set that is taken is never looked at again, so a dense vocabulary costs
    about a pair for each set, not one for each near pair, and no table of all near pairs is made.
    """
    long_sets = items.filter(F.size("tokens") >= 2)
    first = long_sets.groupBy("site", "tokens").agg(F.min("ord").alias("ord"))
    free = cut(numbered(first).join(rare_first(long_sets), ["site", "tokens"]).select("site", "tokens", "ordered", "idx"))
    end = free.agg(F.max("idx")).first()[0]
    moved, reach = first.select("site", "tokens", F.col("tokens").alias("seed")).limit(0), prefix
    while end is not None:
        stretch = free.filter(F.col("idx") < reach)
        inside = _settled(near_between(stretch, stretch, threshold), stretch)
        moved = moved.unionByName(inside)
        if reach > end:
            break
        later = free.filter(F.col("idx") >= reach)
        openers = cut(stretch.join(inside.select("site", "tokens"), ["site", "tokens"], "left_anti"))
        met = near_between(openers, later, threshold).join(openers.select("site", F.col("tokens").alias("left"), "idx"), ["site", "left"])
        taken = cut(met.groupBy("site", F.col("right").alias("tokens")).agg(F.min_by("left", "idx").alias("seed")))
        moved = moved.unionByName(taken)
        free = cut(later.join(taken.select("site", "tokens"), ["site", "tokens"], "left_anti"))
        reach *= growth
    return first.select("site", "tokens").join(moved, ["site", "tokens"], "left").select("site", "tokens", F.coalesce("seed", "tokens").alias("seed"))


def _settled(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(site, tokens, seed) of the sets that an earlier one takes, from all near pairs among ``sets``; stored.

    A set is settled once the first of its earlier, untaken neighbours is known to open a group, so each round settles
    many sets at once; sequential order is kept exactly and rounds stay few ("Greedy Sequential Maximal
    Independent Set and Matching are Parallel on Average", Blelloch et al., 2012).
    """
    left = sets.select("site", F.col("tokens").alias("left"), F.col("idx").alias("lo"))
    right = sets.select("site", F.col("tokens").alias("right"), F.col("idx").alias("ro"))
    active = cut(near.join(left, ["site", "left"]).join(right, ["site", "right"]).filter(F.col("lo") < F.col("ro")).select("site", "left", "lo", "right"))
    out = active.select("site", F.col("right").alias("tokens"), F.col("left").alias("seed")).limit(0)
    while not active.isEmpty():
        earliest = active.groupBy("site", "right").agg(F.min_by("left", "lo").alias("left"))
        taken = earliest.select("site", F.col("right").alias("left"))
        opening = active.select("site", "left").distinct().join(taken, ["site", "left"], "left_anti")
        settled = cut(earliest.join(opening, ["site", "left"]).select("site", F.col("right").alias("tokens"), F.col("left").alias("seed")))
        out = out.unionByName(settled)
        for side in ("right", "left"):
            active = active.join(settled.select("site", F.col("tokens").alias(side)), ["site", side], "left_anti")
        active = cut(active.select("site", "left", "lo", "right"))
    return out


def near_collisions(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """J13. Groups of near keywords among the items without an exact collision."""
    clashing = exact_collisions(items).select("site", "norm")
    rest = cut(items.join(clashing, ["site", "norm"], "left_anti").select("site", "cluster", "slug", "keyword", "impressions", "tokens", "ord"))
    seeds = near_groups(rest, threshold)
    return _collisions(rest.join(seeds, ["site", "tokens"]), ["site", "seed"], "parecida").drop("seed")
