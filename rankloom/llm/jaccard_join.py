"""N-gram Jaccard join (operator 3): universe partitions, the pigeonhole principle and exact verification.

Sets r and s with |r| <= |s| and Jaccard >= J differ in at most H = (1 - J) / (1 + J) * (|r| + |s|) elements. Sizes fall into
bands; a band fixes a number of segments m > H, and a hash deals the universe of shingles out to them. Give segment i the
allocation a_i (0: leave it out, 1: equal, 2: equal but for one element). If the a_i sum to more than H, a linked pair differs
by less than a_i within some segment, so it shares that segment's subset or a one-deletion neighbour of it.

- Every set is indexed in its own band and, where a larger partner may fall there, the next: a signature of each
  segment's subset, empty ones too, and for some segments (all of them in small bands) their one-deletion neighbours.
- The larger set of a pair probes its own band only. It chooses its allocation by cost: a sketch counts how often shingles
  occur in all documents, a subset is no more frequent than its rarest shingle, and the cheapest units that sum to
  H + 1 are taken. Common passages and empty segments are thereby left out wherever the rest is enough.

Equal sets share one key from the start. Signatures held by one set end in a streaming pass over the sorted
signatures. Of the others, first every set is verified against one set of its bucket; only sets that are still in different
components are then compared pair by pair. Those pairs pass a parity sketch first: each element flips one bit of a set's sketch, so two
sketches differ in no more bits than the sets do in elements, and a pair that differs in more than H bits is no link. A large group of
near copies thereby costs its size and not its square.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.llm.common import bit_map, free_name, in_bit_map, mix, shingle_sets, slices, whole_texts, Words
from rankloom.operators.similarity import components

WORDS = 5
#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
#: Next band's first size over this one's.
BAND = 1.56
#: Segments beyond H + 1, and segments with one-deletion neighbours, as shares of H + 1.
SPARE, NEIGHBOURS = 0.05, 0.05
SMALL = 8
SKETCH_BITS = 16
#: Star rounds before the rest is compared pair by pair.
ROUNDS = 3
#: 64-bit words of a set's parity sketch.
PARITY_WORDS = 16
#: Rows of one signature that a task holds before it hands them on.
HELD_ROWS = 100_000

INDEX, PROBE, INDEX_LESS, PROBE_LESS = 1, 2, 4, 8
_SEG, _LESS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_PARITY = [f"p{i}" for i in range(PARITY_WORDS)]


class Bands:
    """First sizes of the bands and, for each, its segments and how many of them have neighbours."""

    def __init__(self, top: int = 1 << 40):
        first = [1]
        while first[-1] < top:
            first.append(max(first[-1] + 1, int(np.ceil(BAND * first[-1]))))
        self.first = np.array(first, dtype=np.int64)
        need = self.most_apart(self.first[1:] - 1) + 1
        self.segments = need + np.where(need > 1, np.ceil(SPARE * need), 0).astype(np.int64)
        some = np.maximum(4, np.ceil(NEIGHBOURS * need)).astype(np.int64)
        self.near = np.where(self.segments <= SMALL, self.segments, np.minimum(some, self.segments))
        self.near[self.segments == 1] = 0

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, size, side="right") - 1

    @staticmethod
    def most_apart(size: np.ndarray) -> np.ndarray:
        """H of a set and a partner of at most its size."""
        return 2 * size * (DEN - NUM) // (DEN + NUM)

    @staticmethod
    def largest_partner(size: np.ndarray) -> np.ndarray:
        return size * DEN // NUM


def _sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2^64 by group."""
    low = np.bincount(group, weights=(values & _LOW).astype(np.float64), minlength=n).astype(np.uint64)
    high = np.bincount(group, weights=(values >> _32).astype(np.float64), minlength=n).astype(np.uint64)
    return low + (high << _32)


def signatures(at: np.ndarray, shingles: np.ndarray, keys: np.ndarray, sketch: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, key, size and role) rows of sets given as borders and sorted shingle hashes."""
    size = np.diff(at)
    out = []
    own = bands.of(size)
    reaches = (size > 0) & (bands.largest_partner(size) >= bands.first[np.minimum(own + 1, len(bands.first) - 1)])
    for step, chosen in ((0, size > 0), (1, reaches)):
        docs = np.flatnonzero(chosen)
        if not len(docs):
            continue
        band, n = own[docs] + step, size[docs]
        m, near = bands.segments[band], bands.near[band]
        base = np.cumsum(m) - m
        total = int(m.sum())
        doc_of_token = np.repeat(np.arange(len(docs)), n)
        token = shingles[np.repeat(at[:-1][docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        spread = mix(token + _SEG)
        seg = ((spread >> _32) * m[doc_of_token].astype(np.uint64) >> _32).astype(np.int64)
        group = base[doc_of_token] + seg
        content = _sums(group, spread, total)
        doc = np.repeat(np.arange(len(docs)), m)
        number = np.arange(total) - base[doc]
        tag = mix((band[doc].astype(np.uint64) << _32) + number.astype(np.uint64) + _LESS)
        role = np.full(total, INDEX, dtype=np.int64)
        less = seg < near[doc_of_token]
        less_role = np.full(int(less.sum()), INDEX_LESS, dtype=np.int64)
        if step == 0:
            units = _allocate(doc, number, group, token, near[doc], bands.most_apart(n) + 1, total, sketch)
            role |= np.where(units >= 1, PROBE, 0)
            less_role |= np.where(units[group[less]] == 2, PROBE_LESS, 0)
        out.append((mix(content ^ tag), keys[docs][doc], n[doc] << 4 | role))
        g = group[less]
        out.append((mix((content[g] - spread[less]) ^ tag[g]), keys[docs][doc[g]], n[doc[g]] << 4 | less_role))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x).astype(np.int64) if i else np.concatenate(x).view(np.int64) for i, x in enumerate(zip(*out)))


def _allocate(doc, number, group, token, near, need, total, sketch) -> np.ndarray:
    """Each segment's allocation: per document the cheapest units that sum to ``need``.

    A unit's cost is the number of sets expected under the signatures it probes. The first unit of a segment costs the count of its rarest
    shingle. The second, where there are neighbours, costs the counts of the subsets with one left out: its rarest but for the one
    taken away that gave the least, whose subset has the second rarest. An empty segment costs more than any other.
    """
    count = sketch[(token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.float64)
    order = np.lexsort((count, group))
    g, c = group[order], count[order]
    first = np.searchsorted(g, np.arange(total))
    size = np.diff(np.append(first, len(g)))
    most = float(sketch.sum() + 1)
    low = np.full(total, most)
    low[size > 0] = c[first[size > 0]]
    second = np.full(total, most)
    second[size > 1] = c[first[size > 1] + 1]
    wide = number < near
    units_doc = np.concatenate((doc, doc[wide]))
    units_seg = np.concatenate((np.arange(total), np.flatnonzero(wide)))
    cost = np.concatenate((low, np.maximum(low, (size - 1) * low + second)[wide]))
    turn = np.concatenate((np.zeros(total), np.ones(int(wide.sum()))))
    order = np.lexsort((turn, cost, units_doc))
    rank = np.arange(len(order)) - np.searchsorted(units_doc[order], units_doc[order])
    taken = order[rank < need[units_doc[order]]]
    return np.bincount(units_seg[taken], minlength=total)


def sets_of(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(*words(texts), WORDS)


def set_keys(at: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set from all its elements; equal sets have equal keys, and empty sets 0."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    a, b = _sums(doc, mix(shingles + _LESS), len(at) - 1), _sums(doc, mix(shingles ^ _SEG), len(at) - 1)
    keys = mix(a + mix(b + np.diff(at).astype(np.uint64))).view(np.int64)
    return np.where(np.diff(at) > 0, keys, 0)


def parities(at: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """PARITY_WORDS 64-bit words a set: bit b is the parity of the number of elements that hash to b."""
    bits = PARITY_WORDS * 64
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    slot = (mix(shingles ^ _LESS) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(doc * bits + slot, minlength=(len(at) - 1) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(at) - 1, bits), axis=1).view(np.int64)


def documents_and_sketch(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, n_shingles, key) of every row, stored; how many distinct sets of a task hold a shingle of each hash class, over all tasks)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, seen = Words(), np.zeros(1 << SKETCH_BITS, dtype=np.int64), set()
        for b in slices(batches, "text"):
            at, sh = sets_of(b.column("text"), words)
            keys = set_keys(at, sh)
            new = _unseen(keys, seen)
            mine = np.repeat(new, np.diff(at))
            counts += np.bincount((sh[mine] & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(at)), pa.array(keys), pa.array(np.zeros(len(keys), dtype=np.int64))], names=["doc_id", "n_shingles", "key", "seen"])
        some = np.flatnonzero(counts)
        none = np.full(len(some), -1, dtype=np.int64)
        yield pa.record_batch([pa.array(none), pa.array(none), pa.array(some), pa.array(counts[some])], names=["doc_id", "n_shingles", "key", "seen"])

    rows = cut(whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_shingles long, key long, seen long"))
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in rows.filter("n_shingles = -1").groupBy("key").agg(F.sum("seen").alias("n")).toLocalIterator():  # 2^16 numbers at most
        sketch[r["key"]] = r["n"]
    return rows.filter("n_shingles >= 0").select("doc_id", "n_shingles", "key"), sketch


def _unseen(keys: np.ndarray, seen: set) -> np.ndarray:
    """The first row of each key a task meets; at most 2 million keys are remembered, which may repeat rows but drops none."""
    new = np.zeros(len(keys), dtype=bool)
    for i, k in enumerate(keys.tolist()):
        if k and k not in seen:
            new[i] = True
            if len(seen) > 2_000_000:
                seen.clear()
            seen.add(k)
    return new


def buckets(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(sig, key, meta, hub, hub_n, wide), stored: the signatures that at least two sets share and one of them probes.

    ``hub`` is a set of the bucket, ``wide`` says that it has three sets or more.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # 2^16 numbers

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands, seen = Words(), Bands(), set()
        for b in slices(batches, "text", 1 << 20):
            at, sh = sets_of(b.column("text"), words)
            keys = set_keys(at, sh)
            new = _unseen(keys, seen)
            n = np.where(new, np.diff(at), 0)
            sh, at = sh[np.repeat(new, np.diff(at))], np.concatenate(([0], np.cumsum(n)))
            sig, key, meta = signatures(at, sh, keys, shared.value, bands)
            for a in range(0, len(sig), 200_000):
                yield pa.record_batch([pa.array(x[a : a + 200_000]) for x in (sig, key, meta)], names=["sig", "key", "meta"])

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None  # rows of a bucket that may go on; the bucket whose first rows are already out
        for b in batches:
            s, k, m = (b.column(c).to_numpy() for c in ("sig", "key", "meta"))
            if held is not None:
                s, k, m = (np.concatenate(x) for x in zip(held, (s, k, m)))
            if running is not None:
                n = int(np.searchsorted(s, running[0], side="right"))
                yield from _out(s[:n], k[:n], m[:n], np.full(n, running[1]), np.full(n, running[2]), np.ones(n, dtype=bool))
                s, k, m = s[n:], k[n:], m[n:]
            if not len(s):
                held = None
                continue
            last = int(np.searchsorted(s, s[-1]))
            yield from _groups(s[:last], k[:last], m[:last])
            s, k, m = s[last:], k[last:], m[last:]
            running, held = None, (s, k, m)
            if len(s) > HELD_ROWS and m[0] & (PROBE | PROBE_LESS) and k[-1] != k[0]:
                running, held = (s[0], k[0], m[0] >> 4), None
                yield from _out(s, k, m, np.full(len(s), k[0]), np.full(len(s), m[0] >> 4), np.ones(len(s), dtype=bool))
            elif len(s) > HELD_ROWS:  # probing rows come first: without one nothing of this bucket is wanted; of one set, its first row is enough
                held = (s[:1], k[:1], m[:1])
        if held is not None:
            yield from _groups(*held)

    rows = whole_texts(docs).select("text").mapInArrow(emit, "sig long, key long, meta long")
    probing = F.col("meta").bitwiseAND(F.lit(PROBE | PROBE_LESS)) == 0
    grouped = rows.repartition("sig").sortWithinPartitions("sig", probing, "key")
    return cut(grouped.mapInArrow(shared_only, "sig long, key long, meta long, hub long, hub_n long, wide boolean"))


def _out(s, k, m, hub, hub_n, wide) -> Iterator[pa.RecordBatch]:
    if len(s):
        yield pa.record_batch([pa.array(x) for x in (s, k, m, hub, hub_n, wide)], names=["sig", "key", "meta", "hub", "hub_n", "wide"])


def _groups(s: np.ndarray, k: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(s):
        return
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    sets = np.add.reduceat(fresh.astype(np.int64), start)
    probes = np.bitwise_or.reduceat(m & (PROBE | PROBE_LESS), start)
    size = np.diff(np.append(start, len(s)))
    keep = np.repeat((sets > 1) & (probes > 0), size)
    hub, wide = np.repeat(start, size)[keep], np.repeat(sets > 2, size)[keep]
    yield from _out(s[keep], k[keep], m[keep], k[hub], m[hub] >> 4, wide)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough, computed from both whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for b in slices(iter([whole]), "text_b", 2 << 20):
                a_at, a = sets_of(b.column("text_a"), words)
                b_at, t = sets_of(b.column("text_b"), words)
                ok = np.zeros(b.num_rows, dtype=bool)
                for i in range(b.num_rows):
                    x, y = a[a_at[i] : a_at[i + 1]], t[b_at[i] : b_at[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = DEN * both >= NUM * (len(x) + len(y) - both)
                yield pa.record_batch([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _pair(x, y, nx, ny):
    """Distinct unordered pairs of different sets whose sizes allow a link."""
    fits = DEN * F.least(nx, ny) >= NUM * F.greatest(nx, ny)
    return (x != y) & fits, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Words are runs of other than ASCII white space with A-Z lower-cased. A set is a text's distinct 5-word shingles, with fewer words the
    whole sequence; texts without words and nulls have an empty set and are linked with nothing. Equal sets are linked. component_id
    is the smallest doc_id reachable by links. Rows that repeat a doc_id share its smallest component; a null doc_id is part of its component
    without giving it a name, and alone has a null one. An empty table gives no rows.
    """
    own, sketch = documents_and_sketch(docs)
    shared = buckets(docs, sketch)
    linked = similar_keys(docs, own, shared)
    found = own.join(linked, "key", "left").withColumn("group", F.coalesce("component", "key"))
    found = found.withColumn("group", F.when(F.col("n_shingles") > 0, F.col("group")))
    names = found.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return found.join(names, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each component the first row by (doc_id, text) stays.

    A row's component is that of its text, whatever rows share its doc_id. Rows without a doc_id are compared among themselves: of those in a
    component the first by text stays, next to the first with a doc_id. Rows without words are no copies and all stay.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = similar_components(docs.select(row.alias("doc_id"), "text")).filter("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    rows = docs.groupBy(row.alias("row")).agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("n"))
    rows = cut(rows.join(found, "row").withColumn("nameless", F.col("id").isNull()))
    group = ["component", "nameless"]
    # of each component the rows with its least doc_id; by text only where several texts share that
    least = rows.groupBy(*group).agg(F.min_by(F.struct("row", "n"), F.struct("id", "row")).alias("first"), F.min("id").alias("least"), F.count("*").alias("members"))
    first = cut(least.select(*group, "least", "members", "first.row", "first.n"))
    tied = rows.join(first.filter("members > 1").select(*group, "least"), group).filter(F.col("id").eqNullSafe(F.col("least"))).select(*group, "row", "n")
    tied = cut(tied.join(tied.groupBy(*group).agg(F.count("*").alias("ties")).filter("ties > 1").drop("ties"), group))
    kept = first.select(*group, "row", "n")
    if not tied.isEmpty():
        texts = docs.select(row.alias("row"), "text").join(tied, "row").groupBy(*group).agg(F.min(F.struct("text", "row", "n")).alias("t"))
        kept = kept.join(tied.select(*group).distinct(), group, "left_anti").unionByName(texts.select(*group, "t.row", "t.n"))
    kept = cut(kept.select("row", "n"))
    mark = free_name(docs, "row_hash")
    again = kept.filter("n > 1").select(F.col("row").alias(mark + "_again"))
    gone = rows.select("row").join(kept.filter("n = 1"), "row", "left_anti").select(F.col("row").alias(mark))
    rest = docs.join(gone, row == F.col(mark), "left_anti")
    if not again.isEmpty():  # rows that repeat doc_id and text: one of them
        same = docs.withColumn(mark, row).join(again, F.col(mark) == F.col(mark + "_again"), "left_semi").dropDuplicates([mark]).drop(mark)
        rest = rest.unionByName(same)
    return rest


def similar_keys(docs: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, component) of the sets that are linked with another one; stored."""
    in_pairs = shared.select("key").distinct()
    reps = own.filter("n_shingles > 0").groupBy("key").agg(F.min(F.struct("doc_id")).alias("d")).select("key", F.col("d.doc_id").alias("doc_id"))
    wanted = cut(reps.join(in_pairs, "key", "left_semi"))
    texts = cut(_texts_of(docs, wanted))
    ok, a, b = _pair(F.col("key"), F.col("hub"), F.shiftright("meta", 4), F.col("hub_n"))
    tried = cut(shared.filter(ok).select(a, b).distinct())
    links = cut(verified(tried, texts))
    label = components(links.select(F.lit(0).alias("site"), "a", "b")).select(F.col("node").alias("key"), "component")
    wide = shared.filter("wide").select("sig", "key", "meta")
    for turn in range(1, ROUNDS + 1):
        label = cut(label)
        open_rows = wide.join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
        split = open_rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by(
            F.struct("key", F.shiftright("meta", 4).alias("n"), "component"), F.xxhash64("key", F.lit(turn))).alias("hub")).filter("lo <> hi")
        rows = cut(open_rows.join(split.select("sig", "hub"), "sig"))
        if turn < ROUNDS:  # again one set of each bucket, another one
            ok, a, b = _pair(F.col("key"), F.col("hub.key"), F.shiftright("meta", 4), F.col("hub.n"))
            new = rows.filter(ok & (F.col("component") != F.col("hub.component"))).select(a, b).distinct()
        else:  # what is left: all pairs of a bucket between components where one of them probes
            known = rows.join(texts.select("key", *_PARITY), "key")
            l = known.select("sig", F.col("key").alias("x"), F.col("meta").alias("mx"), F.col("component").alias("cx"), *[F.col(p).alias(f"x{p}") for p in _PARITY])
            r = known.select("sig", F.col("key").alias("y"), F.col("meta").alias("my"), F.col("component").alias("cy"), *[F.col(p).alias(f"y{p}") for p in _PARITY])
            ok, a, b = _pair(F.col("x"), F.col("y"), F.shiftright("mx", 4), F.shiftright("my", 4))
            met = (F.col("mx").bitwiseAND(F.lit(PROBE)) > 0) & (F.col("my").bitwiseAND(F.lit(INDEX | INDEX_LESS)) > 0) | (F.col("mx").bitwiseAND(F.lit(PROBE_LESS)) > 0) & (
                F.col("my").bitwiseAND(F.lit(INDEX)) > 0)
            larger = F.shiftright("mx", 4) >= F.shiftright("my", 4)
            apart = sum((F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in _PARITY), F.lit(0))
            near = (DEN + NUM) * apart <= (DEN - NUM) * (F.shiftright("mx", 4) + F.shiftright("my", 4))
            new = l.join(r, "sig").filter((F.col("cx") != F.col("cy")) & met & larger & ok & near).select(a, b).distinct()
        new = cut(new.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(new)
        more = cut(verified(new, texts))
        if not more.isEmpty():
            links = links.unionByName(more)
            label = components(links.select(F.lit(0).alias("site"), "a", "b")).select(F.col("node").alias("key"), "component")
        wide = rows.select("sig", "key", "meta")
    return cut(label)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text, parity words) of one document of each wanted key. A bit map of fixed size keeps most other texts from the shuffle."""
    hashed = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")))
    found = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.select(hashed.alias("h")), "h"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            some = whole.filter(pa.array(in_bit_map(found.value, whole.column("h").to_numpy())))
            for b in slices(iter([some]), "text"):
                found_sets = sets_of(b.column("text"), words)
                bits = parities(*found_sets)
                columns = [pa.array(set_keys(*found_sets)), b.column("text"), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(PARITY_WORDS))]
                yield pa.record_batch(columns, names=["key", "text", *_PARITY])

    fields = "".join(f", {p} long" for p in _PARITY)
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("text", hashed.alias("h")).mapInArrow(likely, f"key long, text string{fields}")
    return rows.join(wanted.select("key"), "key").dropDuplicates(["key"])
