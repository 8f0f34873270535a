"""Source divergence audit (operator 12): sorted word-start pointers, and how far a source's words are from those of its language.

Counting: a slice of texts stays in its Arrow buffers. Every term's first byte becomes a pointer, and the pointers are sorted by the bytes
they point at with a multikey quicksort: a pass sorts the open stretches of pointers by the next eight bytes of their terms, and
stretches of equal bytes stay open for the next pass, eight bytes deeper. Equal terms then lie in one run, ordered by group and
document, so a run's lengths and changes are its counts and document frequencies. Spark adds the slices' numbers up.

Divergence: f(p, q) of a term depends on two counts only. The sum over all kept terms for a pair of sources is the value where both
lack the term, times all terms, corrected by the terms of either source (by its distinct counts) and by the terms both have (a
join of the counts). So no table of all terms by all sources is made. All numbers are whole and exact.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.llm.common import slices, text_bytes, whole_texts

LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
SLICE = 2 << 20
CELLS = "lang string, source string, term string, count long, docs long"


def term_pointers(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, end bytes) of the terms: runs of ASCII letters and of bytes above 127, within one text."""
    letter = np.zeros(256, dtype=bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    inside = np.concatenate(([False], letter[data], [False]))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[borders] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends


def sort_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the order that sorts terms by their bytes, equal ones as they came, and the number of each sorted term's run."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded.tobytes(), strides=(1,))

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(ends[which] - starts[which] - depth, 0, 8)
        at = np.minimum(starts[which] + depth, len(data))
        spare = (np.uint64(8) * (8 - left).astype(np.uint64)) % np.uint64(64)
        return np.where(left == 0, np.uint64(0), (eight[at].astype(np.uint64) >> spare) << spare)

    order, depth = np.arange(len(starts)), 0
    run = np.zeros(len(starts), dtype=np.int64)
    open_at = np.arange(len(starts))  # places of the sorted order in open stretches
    new = np.zeros(len(starts), dtype=bool)
    new[:1] = True
    while len(open_at):
        which = order[open_at]
        keys, stretch = key(which, depth), run[open_at]
        by = np.lexsort((keys, stretch)) if depth else np.argsort(keys, kind="stable")
        which, keys = which[by], keys[by]
        order[open_at] = which
        apart = np.ones(len(by), dtype=bool)
        apart[1:] = (keys[1:] != keys[:-1]) | (stretch[1:] != stretch[:-1])
        new[open_at] |= apart
        run = np.cumsum(new) - 1
        depth += 8
        alone = apart & np.append(apart[1:], True)
        open_at = open_at[~alone & ((keys & np.uint64(255)) != 0)]  # a last byte of 0: its terms end here
    return order, run


def slice_cells(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, count, docs) of one slice of documents; the term '' counts the documents of a group."""
    lang, source = (pc.dictionary_encode(a) for a in (langs, sources))
    code = lang.indices.to_numpy().astype(np.int64) * (len(source.dictionary) + 1) + source.indices.to_numpy()
    groups, group = np.unique(code, return_inverse=True)
    data, borders = text_bytes(texts)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    starts, ends = term_pointers(data, borders)
    doc = np.searchsorted(borders, starts, side="right") - 1
    by_group = np.argsort(group[doc], kind="stable")
    starts, ends, doc = starts[by_group], ends[by_group], doc[by_group]
    order, run = sort_pointers(data, starts, ends)
    starts, ends, doc = starts[order], ends[order], doc[order]
    of_group = group[doc]
    new_cell = np.ones(len(run), dtype=bool)
    new_cell[1:] = (run[1:] != run[:-1]) | (of_group[1:] != of_group[:-1])
    new_doc = new_cell.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    cell = np.flatnonzero(new_cell)
    count = np.diff(np.append(cell, len(run)))
    docs = np.add.reduceat(new_doc.astype(np.int64), cell) if len(cell) else count
    size = ends[cell] - starts[cell]
    reach = np.concatenate(([0], np.cumsum(size)))
    taken = data[np.repeat(starts[cell] - reach[:-1], size) + np.arange(reach[-1])]
    terms = pa.LargeStringArray.from_buffers(len(cell), pa.py_buffer(reach.astype(np.int64)), pa.py_buffer(taken)).cast(pa.string())
    names = np.concatenate((groups, groups[of_group[cell]]))
    wide = len(source.dictionary) + 1
    columns = [
        lang.dictionary.take(pa.array(names // wide)), source.dictionary.take(pa.array(names % wide)), pa.concat_arrays([pa.array([""] * len(groups), pa.string()), terms]),
        pa.array(np.concatenate((np.zeros(len(groups), dtype=np.int64), count))), pa.array(np.concatenate((np.bincount(group, minlength=len(groups)), docs)).astype(np.int64)),
    ]
    return pa.record_batch(columns, names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), stored: occurrences and documents of every term in every group; the term '' has a group's documents.

    Null text, lang and source count as ''. A row is a document, whatever its id. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield slice_cells(b.column("text"), b.column("lang"), b.column("source"))

    rows = whole_texts(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cells = rows.mapInArrow(run, CELLS)
    return cut(cells.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))


def _share(count: Column | str, total: str, terms: str) -> Column:
    """p = 1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals wide enough for any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    count = F.col(count) if isinstance(count, str) else count
    over = (F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2)).cast("decimal(38,0)")
    under = wide(F.col(total) + 2 * F.col(terms)).cast("decimal(38,0)")
    return 1 + F.call_function("div", over, under)


def _apart(p: str, q: str) -> Column:
    """f = floor((p - q)^2 / (p + q)), exact: a share is at most SCALE + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) that occurs.

    Part ``pair``: the group's divergence from each other source of its language, over the language's kept terms (those in ``least_docs`` of its
    documents), 0 without kept terms. Part ``term``: the ``top`` terms the group has more often than its language. Ties go by the
    item's bytes. Null and empty texts make a group without terms; an empty table gives no rows.
    """
    cells = term_counts(docs)
    terms = cells.filter("term <> ''")
    in_lang = terms.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("in_docs")).filter(F.col("in_docs") >= least_docs)
    held = cut(terms.join(in_lang.select("lang", "term", "lang_count"), ["lang", "term"]).select("lang", "source", "term", "count", "lang_count"))
    kept_terms = held.select("lang", "term", "lang_count").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("n_lang"))
    sizes = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = cells.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(kept_terms, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    groups = cut(groups.withColumn("zero", F.when(F.col("v") > 0, _share(F.lit(0), "n", "v"))))
    shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", _share("count", "n", "v").alias("p"), _share("lang_count", "n_lang", "v").alias("q"))
    shares = cut(shares)
    return _pairs(groups, shares).unionByName(_top_terms(shares, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    a, b = (groups.select("lang", F.col("source").alias(s), F.col("zero").alias(f"zero_{s}"), "v") for s in "ab")
    # both lack every term
    lacking = a.join(b.drop("v"), "lang").filter("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * _apart("zero_a", "zero_b"), F.lit(0)).alias("value"))
    # the terms one of the two has, by its distinct shares
    levels = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    one = levels.join(others, "lang").filter("source <> other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("terms") * (_apart("p", "other_zero") - _apart("zero", "other_zero"))).alias("value"))
    # the terms both have
    x, y = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("zero").alias(f"zero_{s}")) for s in "ab")
    both = x.join(y, ["lang", "term"]).filter("a < b").select(
        "lang", "a", "b", (_apart("p_a", "p_b") - _apart("p_a", "zero_b") - _apart("zero_a", "p_b") + _apart("zero_a", "zero_b")).alias("value"))
    sums = lacking.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sides.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(w))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
