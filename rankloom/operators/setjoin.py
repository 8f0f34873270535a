"""Exact similarity joins over token sets.

Two sets with a Jaccard of at least t and sizes a, b share at least o = t(a+b)/(1+t) tokens. Ordered
from rare to common, they therefore share two tokens among their first a-o+2 (b-o+2) ones, or one
among the first a-o+1 when o is 1. Only those pairs of rare tokens are joined: the common tokens,
which would pair nearly everything, almost never are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rare_first(sets: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct (site, tokens) with ``ordered``: the tokens from rare to common over all given tables."""
    base = sets.select("site", "tokens").distinct()
    universe = base
    for o in others:
        universe = universe.unionByName(o.select("site", "tokens").distinct())
    df = universe.select("site", F.explode("tokens").alias("token")).groupBy("site", "token").agg(F.count("*").alias("df"))
    exploded = base.select("site", "tokens", F.explode("tokens").alias("token"))
    return exploded.join(df, ["site", "token"]).groupBy("site", "tokens").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ordered")
    )


def _need(a: Column, b: Column, t: float) -> Column:
    return F.ceil(F.round(t * (a + b) / (1 + t), 6))


def _index(sets: DataFrame, t: float, mine: str, other: str) -> DataFrame:
    n = F.size("tokens")
    sizes = F.sequence(F.ceil(F.round(n * t, 6)).cast("int"), F.floor(F.round(n / t, 6)).cast("int"))
    sized = sets.filter(n > 0).select("site", "tokens", "ordered", n.alias(mine), F.explode(sizes).alias(other))
    need = _need(F.col(mine), F.col(other), t).cast("int")
    sized = sized.withColumn("need", need).withColumn("prefix", F.slice("ordered", F.lit(1), F.col(mine) - F.col("need") + F.least("need", F.lit(2))))
    first = sized.select("site", "tokens", mine, other, "need", "prefix", F.posexplode("prefix").alias("i", "t1"))
    seconds = F.when(F.col("need") == 1, F.array(F.lit(""))).otherwise(F.slice("prefix", F.col("i") + 2, F.size("prefix")))
    return first.select("site", "tokens", mine, other, "t1", F.explode(seconds).alias("t2"))


def jaccard(a, b) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def jaccard_pairs(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """(site, left, right, score) for distinct token sets with Jaccard >= t. Inputs: (site, tokens)."""
    return ordered_jaccard_pairs(rare_first(left, right), rare_first(right, left), t)


def ordered_jaccard_pairs(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """As jaccard_pairs over rare_first tables."""
    probe = _index(left, t, "na", "nb").withColumnRenamed("tokens", "left")
    build = _index(right, t, "nb", "na").withColumnRenamed("tokens", "right")
    met = probe.join(build, ["site", "t1", "t2", "na", "nb"]).withColumn("score", jaccard("left", "right"))
    return met.filter(F.col("score") >= t).select("site", "left", "right", "score").distinct()


def ordered_subset_pairs(ordered: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(site, left, right) where left, of two or more tokens, is a proper subset of right, a set of the same table or of ``others``.

    They meet at the two rarest tokens of left, which right holds in the same order.
    """
    o = ordered.filter(F.size("ordered") >= 2)
    small = o.select("site", F.col("tokens").alias("left"), F.element_at("ordered", 1).alias("t1"), F.element_at("ordered", 2).alias("t2"))
    rest = F.slice("ordered", F.col("i") + 2, F.size("ordered"))
    wide = o if others is None else others.filter(F.size("ordered") >= 2)
    large = wide.select("site", "tokens", "ordered", F.posexplode("ordered").alias("i", "t1")).select(
        "site", F.col("tokens").alias("right"), "t1", F.explode(rest).alias("t2")
    )
    inside = (F.size("left") < F.size("right")) & (F.size(F.array_except("left", "right")) == 0)
    return small.join(large, ["site", "t1", "t2"]).filter(inside).select("site", "left", "right")
