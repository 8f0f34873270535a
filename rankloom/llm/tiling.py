"""Benchmark decontamination (operator 1): greedy string tiling over shared-token seeds.

Running Karp-Rabin: every window of MIN_MATCH words of the benchmark and of the documents gets a rolling hash; equal hashes are seeds
(document position, item position). Longer matches are runs of seeds on one diagonal. Tiling takes the longest match, marks
its words on both sides, and goes on with what is unmarked until nothing of MIN_MATCH words is left. Tiles may lie in
any order, so a passage whose sentences were moved is still covered. A document is contaminated by an item when its tiles
cover at least MIN_COVERAGE of the item's words.

The documents pass once, against a bit map of the benchmark's seeds (a fixed size, whatever the benchmark's); an exact
join on the seeds follows, and equal texts are tiled once. What meets in one row is one text's seeds with one item.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.llm.common import Words, bit_map, free_name, in_bit_map, mix, slices, whole_texts, window_hashes

MIN_MATCH = 5
MIN_COVERAGE = 0.5


def tiles(pairs: list[tuple[int, int]], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, length) from seeds (i, j): windows of ``min_match`` equal words.

    Of matches of one length the first in the item, then in the document, is taken.
    """
    runs, by_diagonal = [], sorted((i - j, i) for i, j in set(pairs))
    for d, i in by_diagonal:
        if runs and runs[-1][0] == d and runs[-1][1] + runs[-1][2] == i:
            runs[-1][2] += 1
        else:
            runs.append([d, i, 1])
    heap = [(-(n + min_match - 1), i - d, i) for d, i, n in runs]
    heapq.heapify(heap)
    doc_marked, item_marked, out = set(), set(), []
    while heap:
        size, j, i = heapq.heappop(heap)
        free = [k for k in range(-size) if i + k not in doc_marked and j + k not in item_marked]
        if len(free) == -size:
            out.append((i, j, -size))
            doc_marked.update(range(i, i - size))
            item_marked.update(range(j, j - size))
            continue
        start = 0
        for n in range(1, len(free) + 1):
            if n == len(free) or free[n] != free[n - 1] + 1:
                if n - start >= min_match:
                    heapq.heappush(heap, (-(n - start), j + free[start], i + free[start]))
                start = n
    return out


def seeds(texts: DataFrame, key: str, min_match: int = MIN_MATCH, only=None) -> DataFrame:
    """(key, text_key, seed, at, n_words) of every window of every text; ``only``: a broadcast bit map that windows must fall on.

    ``text_key`` is a hash of the whole word sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text", 1 << 20):
            at, h = words(b.column("text"))
            doc, pos, win = window_hashes(at, h, min_match)
            n = np.diff(at)
            if only is not None:
                hit = in_bit_map(only.value, win.view(np.int64))
                doc, pos, win = doc[hit], pos[hit], win[hit]
            if not len(doc):
                continue
            whole = np.array([_sequence(h[at[d] : at[d + 1]]) for d in np.unique(doc)], dtype=np.int64)
            of_doc = np.searchsorted(np.unique(doc), doc)
            ids = b.column(key).take(pa.array(doc))
            yield pa.record_batch([ids, pa.array(whole[of_doc]), pa.array(win.view(np.int64)), pa.array(pos), pa.array(n[doc])], names=[key, "text_key", "seed", "at", "n_words"])

    rows = whole_texts(texts).select(F.col(key).cast("long").alias(key), "text")
    return rows.mapInArrow(run, f"{key} long, text_key long, seed long, at long, n_words long")


def _sequence(words: np.ndarray) -> int:
    place = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    return int(np.bitwise_xor.reduce(mix(words + place)).view(np.int64))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_tiles, tiled_words, coverage) of every document and item whose tiles cover enough of the item.

    Words are runs of other than ASCII white space, A-Z lower-cased. Nulls and empty texts match nothing, nor do items of fewer than
    ``min_match`` words. Rows that repeat a doc_id, also a null one, count as one document when their texts are equal and are judged each for itself
    otherwise. An item_id with several texts is covered by any of them.
    """
    return _covering(docs, "doc_id", benchmark, min_match, min_coverage)


def _covering(docs: DataFrame, name: str, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``contaminated`` with documents named by the column ``name``."""
    items = cut(seeds(benchmark, "item_id", min_match))
    known = docs.sparkSession.sparkContext.broadcast(bit_map(items, "seed"))
    hits = cut(seeds(docs, name, min_match, known).join(items.select("seed").distinct(), "seed", "left_semi"))
    once = hits.select("text_key", "seed", F.col("at").alias("i")).distinct()
    windows = items.select("seed", "item_id", F.col("text_key").alias("item_key"), F.col("at").alias("j"), "n_words")
    met = once.join(windows, "seed").groupBy("text_key", "item_id", "item_key", "n_words").agg(F.collect_list(F.struct("i", "j")).alias("pairs"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("pairs"):
                found = tiles([(x["i"].as_py(), x["j"].as_py()) for x in p.values], min_match)
                out.append((len(found), sum(t[2] for t in found)))
            yield pa.record_batch([b.column("text_key"), b.column("item_id"), b.column("n_words"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())],
                                  names=["text_key", "item_id", "n_item_words", "n_tiles", "tiled_words"])

    tiled = met.mapInArrow(tile, "text_key long, item_id long, n_item_words long, n_tiles long, tiled_words long")
    tiled = tiled.withColumn("coverage", F.round(F.col("tiled_words") / F.col("n_item_words"), 6)).filter(F.col("coverage") >= min_coverage)
    best = tiled.groupBy("text_key", "item_id").agg(F.max(F.struct("coverage", "n_item_words", "tiled_words", "n_tiles")).alias("t"))
    owners = hits.select(name, "text_key").distinct()
    return owners.join(best, "text_key").groupBy(name, "item_id").agg(F.max("t").alias("t")).select(
        name, "item_id", "t.n_item_words", "t.n_tiles", "t.tiled_words", "t.coverage")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item contaminates, with all their columns.

    Each row is judged by its own text, also where rows share a doc_id or have none.
    """
    text_hash, bad = F.xxhash64("text"), free_name(docs, "contaminated_hash")
    found = _covering(docs.select(text_hash.alias("text_hash"), "text"), "text_hash", benchmark)
    return docs.join(cut(found.select(F.col("text_hash").alias(bad)).distinct()), text_hash == F.col(bad), "left_anti")
