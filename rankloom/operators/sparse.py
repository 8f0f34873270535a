"""Near-duplicate pages by sparse vectors: an exact cosine join over blocks of pages.

Input weights are (site, page, term, weight) rows of unit vectors, as ``vectors.tfidf`` makes them. A page becomes one row of numbered terms and
weights, a site's pages are dealt to blocks of bounded size, and a task holds one block while the pages that it meets pass by. Terms
that many of the block's pages have are columns of a matrix and are multiplied at once; of the others the block is an inverted
index, and a page adds up the products of its terms' postings. Only sums of some pages are held, and products never reach a shuffle.
At usual thresholds no prefix of rare terms is short enough to join on: the indexed terms would hold most of a vector's norm, and
their joined rows grow with the square of a term's pages.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut, drop
from rankloom.operators.similarity import components
from rankloom.operators.vectors import SENT_ROWS

#: Decimals to which the weights of two vectors agree when they count as equal.
EQUAL_DECIMALS = 6
#: Pages of a block, about; a site of fewer pages has up to ``LEAST_BLOCKS`` blocks of at least ``LEAST_PAGES``.
BLOCK_PAGES = 40960
LEAST_BLOCKS = 3
LEAST_PAGES = 512
#: A term that one in so many of a block's pages has is a column of the block's matrix, as long as it has no more than so many entries.
DENSE_SHARE, DENSE_ENTRIES = 8, 1 << 23
#: Pages that are compared with a block at once.
STRIP_PAGES = 64
#: Pairs that a task hands on at once.
PAIRS_OUT = 1 << 18


def distinct_sparse(weights: DataFrame) -> DataFrame:
    """(site, page, same_as): the smallest page with an equal vector, for every page; stored.

    A vector is named by two sums of hashes over its rounded entries, so no vector is ever gathered.
    """
    entry = lambda seed: F.xxhash64("term", F.round("weight", EQUAL_DECIMALS), F.lit(seed)).cast("decimal(20,0)")
    named = weights.groupBy("site", "page").agg(F.sum(entry(1)).alias("h1"), F.sum(entry(2)).alias("h2"), F.count("*").alias("n"))
    key = ["site", "h1", "h2", "n"]
    first = named.groupBy(*key).agg(F.min("page").alias("same_as"))
    return cut(named.join(first, key).select("site", "page", "same_as"))


def _packed(weights: DataFrame, same: DataFrame) -> DataFrame:
    """(site, page, pages, terms, weights): every page that stands for itself, its entries in one row with terms as numbers; ``pages`` counts the site's. Stored.

    Numbers are as short as their count allows, as they make up much of what is sent to the tasks.
    """
    kept = same.filter("page = same_as").select("site", "page")
    kept = cut(kept.join(kept.groupBy("site").agg(F.count("*").alias("pages")), "site"))
    known = weights.filter(F.col("weight").isNotNull())
    numbered = cut(known.select("site", "term").distinct().withColumn("id", F.monotonically_increasing_id()))
    held = sorted(numbered.groupBy(F.shiftright("id", 33).alias("part")).count().collect())  # a row a partition
    starts, total = [], 0
    for part, n in held:
        starts += [F.lit(part), F.lit(total - (part << 33)).cast("long")]
        total += n
    number = F.col("id") + F.element_at(F.create_map(*starts), F.shiftright("id", 33)) if starts else F.col("id")
    numbers = numbered.select("site", "term", number.cast("int" if total < 1 << 31 else "long").alias("number"))
    numbers = F.broadcast(numbers) if total <= SENT_ROWS else numbers
    # dealt by page once: the pages that are kept come to the entries, not the entries to them
    entries = known.join(numbers, ["site", "term"]).groupBy("site", "page").agg(F.collect_list(F.struct("number", "weight")).alias("e"))
    packed = cut(entries.join(kept, ["site", "page"]).select("site", "page", "pages", F.col("e.number").alias("terms"), F.col("e.weight").alias("weights")))
    drop(kept, numbered)
    return packed


def _dealt(packed: DataFrame, block_pages: int) -> DataFrame:
    """Rows with ``site`` and ``task``, once for every task that they are compared in: a block's task has its own rows first, then the ``other`` ones.

    The blocks of a site stand in a circle, and a block meets those up to half the circle after it, so of two blocks one meets the other and a row is
    sent about half as often as its site has blocks.
    """
    blocks = F.greatest(F.ceil(F.col("pages") / block_pages), F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("pages") / LEAST_PAGES))).cast("int")
    dealt = packed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(F.col("blocks") / 2).cast("int"))))
    met = met.withColumn("task", F.pmod(F.col("block") - F.col("step"), F.col("blocks"))).filter((F.col("step") * 2 != F.col("blocks")) | (F.col("task") < F.col("step")))
    return met.select("site", "task", (F.col("step") > 0).alias("other"), "page", "terms", "weights").repartition("site", "task").sortWithinPartitions("site", "task", "other")


def _entries(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pages, sizes, terms, weights) of rows: the entries of all pages one after another."""
    sizes = rows.column("terms").value_lengths().to_numpy(zero_copy_only=False)
    return rows.column("page").to_numpy(zero_copy_only=False), sizes, rows.column("terms").flatten().to_numpy(), rows.column("weights").flatten().to_numpy()


class _Block:
    """Pages of a block and their entries: terms that many of them have as columns of a matrix, the others as postings."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.pages, sizes, terms, self.weight = (np.concatenate(x) for x in zip(*map(_entries, rows)))
        n = len(self.pages)
        self.ends = np.append(0, np.cumsum(sizes))
        self.known, at = np.unique(terms, return_inverse=True)
        self.at = at.astype(np.int32)
        held = np.bincount(self.at, minlength=len(self.known))
        odd = np.bincount(self.at, ~np.isfinite(self.weight), minlength=len(self.known)) > 0  # a product with one must not reach other pages
        often = np.flatnonzero((held * DENSE_SHARE >= n) & ~odd)
        often = often[np.argsort(-held[often], kind="stable")][:max(1, DENSE_ENTRIES // max(n, 1))]
        self.column = np.full(len(self.known), -1)
        self.column[often] = np.arange(len(often))
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        self.matrix = self._columns(owner, self.at, self.weight, n)
        rest = np.flatnonzero(self.column[self.at] < 0)
        rest = rest[np.argsort(self.at[rest], kind="stable")]
        self.owner, self.posted = owner[rest], self.weight[rest]
        self.first = np.append(0, np.cumsum(np.where(self.column < 0, held, 0)))

    def _columns(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        width, column = int(self.column.max(initial=-1)) + 1, self.column[at]
        use = column >= 0
        return np.bincount(row[use] * np.int64(width) + column[use], weight[use], minlength=n * width).astype(np.float64, copy=False).reshape(n, width)  # of none it is of integers

    def _strip(self, sizes: np.ndarray, at: np.ndarray, weight: np.ndarray, start: int) -> np.ndarray:
        """The similarities of some pages, given as known terms and weights, to the block's pages from ``start`` on."""
        ends = np.append(0, np.cumsum(sizes))
        row = np.repeat(np.arange(len(sizes)), sizes)
        finite = np.isfinite(weight)
        sim = self._columns(row[finite], at[finite], weight[finite], len(sizes)) @ self.matrix[start:].T
        for i, k in zip(row[~finite], np.flatnonzero(~finite)):
            if self.column[at[k]] >= 0:
                x = self.matrix[start:, self.column[at[k]]]
                sim[i, x != 0] += weight[k] * x[x != 0]
        sparse = self.column[at] < 0
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            use = sparse[a:b]
            t, x = at[a:b][use], weight[a:b][use]
            if len(t):
                first, last = self.first[t], self.first[t + 1]
                postings = [slice(c, d) for c, d in zip(first, last)]
                products = np.concatenate([self.posted[p] for p in postings]) * np.repeat(x, last - first)
                sim[i] += np.bincount(np.concatenate([self.owner[p] for p in postings]), products, minlength=len(self.pages))[start:]
        return sim

    def within(self, threshold: float) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(page, its number, numbers of its partners after it, their similarities) for the block's pages with one."""
        for a in range(0, len(self.pages), STRIP_PAGES):
            b = min(a + STRIP_PAGES, len(self.pages))
            part = slice(self.ends[a], self.ends[b])
            sim = self._strip(np.diff(self.ends[a:b + 1]), self.at[part], self.weight[part], a)
            for i, x in enumerate(sim):
                x[:i + 1] = 0.0
                j = np.flatnonzero((x >= threshold) & (x != 0))
                if len(j):
                    yield self.pages[a + i], a + i, a + j, x[j]

    def across(self, rows: pa.RecordBatch, threshold: float) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """The same for other pages, without a number (-1), and their partners in the block."""
        for k in range(0, rows.num_rows, STRIP_PAGES):
            pages, sizes, terms, weight = _entries(rows.slice(k, STRIP_PAGES))
            at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
            hit = self.known[at] == terms
            left = np.diff(np.append(0, np.cumsum(hit))[np.append(0, np.cumsum(sizes))])
            for page, x in zip(pages, self._strip(left, at[hit], weight[hit], 0)):
                j = np.flatnonzero((x >= threshold) & (x != 0))
                if len(j):
                    yield page, -1, j, x[j]


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[str, _Block, str, int, np.ndarray, np.ndarray]]:
    """(site, block, page, its number in the block or -1, numbers of its partners in the block, their similarities) of the tasks of a partition, one block at a time."""
    key, own, block = None, [], None
    for b in batches:
        keys = list(zip(b.column("site").to_pylist(), b.column("task").to_pylist(), b.column("other").to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for first, end in zip(cuts[:-1], cuts[1:]):
            if end == first:
                continue
            part, other = b.slice(first, end - first), keys[first][2]
            if key != keys[first][:2]:
                if own:
                    block = _Block(own)
                    yield from ((key[0], block, *x) for x in block.within(threshold))
                key, own, block = keys[first][:2], [], None
            if not other:
                own.append(part)
                continue
            if own:
                block, own = _Block(own), []
                yield from ((key[0], block, *x) for x in block.within(threshold))
            if block is not None:
                yield from ((key[0], block, *x) for x in block.across(part, threshold))
    if own:
        block = _Block(own)
        yield from ((key[0], block, *x) for x in block.within(threshold))


def sparse_cosine_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """J19 on sparse vectors. (site, a, b, sim): pairs a < b of different vectors of a site with a cosine of at least ``threshold``.

    Of pages with equal vectors the smallest stands for all. A page without terms is in no pair.
    """
    return _pairs_of(_packed(weights, distinct_sparse(weights)), threshold)


def _pairs_of(packed: DataFrame, threshold: float, block_pages: int = BLOCK_PAGES) -> DataFrame:
    def named(found: list) -> pa.RecordBatch:
        sizes = [len(x[4]) for x in found]
        site, p = (np.repeat(np.array([x[c] for x in found], dtype=object), sizes) for c in (0, 2))
        q, sim = np.concatenate([x[1].pages[x[4]] for x in found]), np.concatenate([x[5] for x in found])
        swap = p > q
        return pa.record_batch([pa.array(x, kind) for x, kind in ((site, pa.string()), (np.where(swap, q, p), pa.string()), (np.where(swap, p, q), pa.string()), (sim, pa.float64()))], names=["site", "a", "b", "sim"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for x in _similar(batches, threshold):
            found.append(x)
            held += len(x[4])
            if held >= PAIRS_OUT:
                yield named(found)
                found, held = [], 0
        if held:
            yield named(found)

    return _dealt(packed, block_pages).mapInArrow(compare, "site string, a string, b string, sim double")


def sparse_forest(packed: DataFrame, threshold: float, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """(site, a, b) edges with the same components as the pairs, fewer than the pages of a task for each: a dense group of near copies costs its size and not its square."""
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, label, edges = None, None, []
        for site, found, page, i, j, _ in _similar(batches, threshold):
            if found is not block:
                block, label = found, np.arange(len(found.pages))  # a part's smallest number
            parts = np.unique(label[j if i < 0 else np.append(j, i)])
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
            edges += [(site, block.pages[parts[0]], block.pages[k]) for k in parts[1:]]
            if i < 0:
                edges.append((site, block.pages[parts[0]], page))
            if len(edges) >= PAIRS_OUT:
                yield named(edges)
                edges = []
        if edges:
            yield named(edges)

    def named(edges: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.string()) for x in zip(*edges)], names=["site", "a", "b"])

    return _dealt(packed, block_pages).mapInArrow(forest, "site string, a string, b string")


def sparse_clusters(pages: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """G01 on sparse vectors: (site, page, cluster), the smallest page reachable over pairs; a page without partners or terms is its own."""
    same = distinct_sparse(weights)
    copies = same.filter("page <> same_as").select("site", F.col("same_as").alias("a"), F.col("page").alias("b"))
    edges = sparse_forest(_packed(weights, same), threshold).unionByName(copies)
    found = components(edges).select("site", F.col("node").alias("page"), "component")
    return pages.select("site", "page").distinct().join(found, ["site", "page"], "left").select("site", "page", F.coalesce("component", "page").alias("cluster"))
