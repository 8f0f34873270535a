"""Mixing sources to target weights (operator 8) by weighted fair queueing.

Every source is a queue of its shuffled documents. A document's virtual finish time is its source's cumulative size up to
and with it, over the source's target; a source whose target exceeds its size starts over, up to ``max_repeats`` times.
Serving documents by finish time and stopping when the total budget is used gives every source its target up to one document.

The cumulative sums come in two levels (range slices of a source's shuffled order, then rows within a slice) and the cut is
looked for in one range partition only, so neither a large source, nor copies of one row, nor the whole mix is ever one task's.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.llm.common import free_name, n_words

MAX_REPEATS = 3


def cycled_weights(sources: DataFrame) -> DataFrame:
    """(source, weight): 1, 2, 3, repeating, over the sources by code point, null last. One row a source is ordered."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", (F.pmod(rank - 1, F.lit(3)) + 1).cast("double").alias("weight"))


def targets(sizes: DataFrame, weighed, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target), stored. Targets share ``share`` of all sizes by weight; those over ``max_repeats`` times
    their source's size stop there and the excess is shared again, until none is above. All zero when nothing has a size."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = cut(totals.join(weighed(totals.select("source")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole[0] or not whole[1]:
        return table.withColumn("target", F.lit(0.0))
    cap, budget = F.col("source_size") * max_repeats, whole[0] * share
    level = budget / whole[1]
    while True:
        over = F.lit(level) * F.col("weight") > cap
        fixed, rest = table.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        risen = (budget - fixed) / rest if rest else level
        if risen == level:
            return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))
        level = risen


@dataclass
class Mix:
    """``documents``: the input rows' (row_id, doc_id, source, size, source_size, target, finish, times, taken); ``budget``: words to take."""

    documents: DataFrame
    budget: int


def mix(rows: DataFrame, weighed=cycled_weights, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> Mix:
    """``rows`` has row_id, doc_id, source, size and key, and should be stored, as it is read several times.

    The shuffle follows ``shuffle_key``; rows with equal keys are equal rows, so reruns agree whatever the files' layout. A null source is a source, a document of size 0 is served with the one before it and takes nothing. An empty table gives no rows.
    """
    goal = targets(rows, weighed, share, max_repeats)
    order = [F.col("source").asc_nulls_last(), "key", "row_id"]
    keyed = rows.select("row_id", "doc_id", "source", "size", "key").repartitionByRange(*order)
    keyed = cut(keyed.withColumn("slice", F.spark_partition_id()))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col("source").alias("s"), F.col("slice").alias("sl"), "start")
    upto = Window.partitionBy("source", "slice").orderBy("key", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = keyed.withColumn("within", F.sum("size").over(upto)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target")
    queued = queued.join(goal, F.col("source").eqNullSafe(F.col("g"))).select(
        "row_id", "doc_id", "source", "size", "key", "source_size", "target", (F.col("start") + F.col("within")).alias("reach"))
    queued = cut(queued)
    budget = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * share)

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("reach")) / F.col("target")

    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    items = queued.filter("target > 0").withColumn("turn", turn).filter(F.col("turn") * F.col("source_size") + F.col("reach") - F.col("size") < F.col("target"))
    served = items.select(finish(F.col("turn")).alias("finish"), "key", "row_id", "turn", "size")
    order = ["finish", "key", "row_id", "turn"]
    served = cut(served.repartitionByRange(*order).select(*order, "size", F.spark_partition_id().alias("part")))
    last = _last_served(served, order, budget)
    times = F.lit(0)
    if last is not None:
        bound = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["key"]).alias("key"), F.lit(last["row_id"]).cast("long").alias("row_id"), F.lit(last["turn"]).alias("turn"))
        for i in range(max_repeats):
            turn = F.lit(i)
            now = F.struct(finish(turn).alias("finish"), F.col("key").alias("key"), F.col("row_id").alias("row_id"), turn.alias("turn"))
            begun = turn * F.col("source_size") + F.col("reach") - F.col("size") < F.col("target")
            times = times + F.when((F.col("target") > 0) & begun & (now <= bound), 1).otherwise(0)
    out = queued.withColumn("times", times.cast("int")).select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.when(F.col("target") > 0, finish(F.lit(0))).alias("finish"), "times",
        (F.col("times") * F.col("size")).cast("long").alias("taken"))
    return Mix(out, budget)


def _last_served(served: DataFrame, order: list[str], budget: int):
    """The last item whose cumulative size in serving order stays within the budget, or None."""
    parts = sorted((r["part"], r["n"]) for r in served.groupBy("part").agg(F.sum("size").alias("n")).toLocalIterator())  # one number a partition
    done, inside = 0, None
    for part, n in parts:
        inside = part
        if done + n > budget:
            break
        done += n
    if inside is None:
        return None
    here = served.filter(F.col("part") == inside)
    if done == sum(n for _, n in parts):  # all fit
        return here.orderBy(*[F.desc(c) for c in order]).first()
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fit = here.withColumn("sum", F.sum("size").over(upto)).filter(F.col("sum") <= budget - done)
    found = fit.orderBy(*[F.desc(c) for c in order]).first()
    if found is None and (earlier := [p for p, _ in parts if p < inside]):
        return served.filter(F.col("part") == earlier[-1]).orderBy(*[F.desc(c) for c in order]).first()
    return found


def shuffle_key() -> Column:
    """md5 over doc_id, source and text (a null is the empty string): the place of a document in its source's shuffled order."""
    parts = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))]
    return F.md5(F.concat_ws(":", *parts))


def sized(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, source, size, key), stored: the size of a text is its number of words."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), n_words("text").alias("size"), shuffle_key().alias("key")))


def mixed_documents(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken; the order is for the reader to choose."""
    own = docs.columns
    row, times = free_name(docs, "row_no"), free_name(docs, "times")
    marked = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = marked.select(F.col(row).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("size"), shuffle_key().alias("key"))
    taken = mix(cut(rows), share=share).documents.filter("times > 0").select(F.col("row_id").alias(row + "_taken"), F.col("times").alias(times))
    return marked.join(taken, F.col(row) == F.col(row + "_taken")).select(*own, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).select(*own)
