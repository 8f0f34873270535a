"""Near-duplicate pages: cosine pairs by blocks, components, linkage clusters and their measures.

Input vectors are (site, page, vec). Pages with identical vectors are compared once: the smallest page
stands for its copies. Vectors are put into blocks of bounded size; a pair of blocks is one task, and
pairs of blocks that are too far apart to hold a pair above the threshold are left out by the
triangle inequality on angles, which loses nothing.
"""

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.lineage import cut

BLOCK_ROWS = 4096
#: Rows of a block that are compared at once, so a task's memory is this many rows of similarities.
STRIP_ROWS = 256
#: Linkage looks for components after this many rounds, and again after twice as many each time; one of up to so many clusters is settled in a task.
FIRST_SPLIT, TASK_CLUSTERS = 4, 2048


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per site and vector: the smallest page and the number of copies."""
    return vectors.groupBy("site", "vec").agg(F.min("page").alias("page"), F.count("*").alias("copies")).select("site", "page", "vec", "copies")


def copy_edges(vectors: DataFrame, reps: DataFrame) -> DataFrame:
    """(site, a, b): every further copy b of a page a with the same vector."""
    r = reps.select("site", "vec", F.col("page").alias("a"))
    return vectors.join(r, ["site", "vec"]).filter(F.col("page") != F.col("a")).select("site", "a", F.col("page").alias("b"))


def _unit(vecs) -> np.ndarray:
    m = np.vstack(vecs).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _cell(v, planes: int, width: int):
    """Side of a few fixed planes with pseudo-random signs: near vectors tend to share it."""
    side = F.lit(0)
    for plane in range(planes):
        signs = F.array(*[F.lit(1.0 if zlib.crc32(f"{plane}:{i}".encode()) % 2 else -1.0) for i in range(width)])
        dot = F.aggregate(F.zip_with(v, signs, lambda x, s: x.cast("double") * s), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        side = side * 2 + F.when(dot > 0, 1).otherwise(0)
    return side


def _blocks(reps: DataFrame, block_rows: int) -> DataFrame:
    """Rows with a block of at most about ``block_rows`` rows: as many cells as a site has blocks, full cells split by page hash.

    ``coarse`` groups neighbouring cells, about as many as a group has cells.
    """
    site = reps.groupBy("site").agg(F.count("*").alias("site_n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("site_n") / block_rows))).cast("int")
    site = site.select("site", bits.alias("bits"))
    planes, width = site.agg(F.max("bits")).first()[0] or 0, reps.agg(F.max(F.size("vec"))).first()[0] or 0  # two numbers
    cell = _cell(F.col("vec"), planes, width)
    celled = reps.join(site, "site").select(
        "site", "page", "vec", F.floor(cell / F.pow(F.lit(2.0), planes - F.col("bits"))).alias("cell"), F.pow(F.lit(2.0), F.ceil(F.col("bits") / 2)).alias("near")
    )
    parts = celled.groupBy("site", "cell").agg(F.ceil(F.count("*") / block_rows).alias("split"))
    block = F.concat_ws("-", "cell", F.pmod(F.xxhash64("page"), F.col("split")))
    return celled.join(parts, ["site", "cell"]).select("site", "page", "vec", block.alias("block"), F.floor(F.col("cell") / F.col("near")).cast("long").alias("coarse"))


_SPAN = "centre array<double>, radius double"


def _block_spans(rows: DataFrame) -> DataFrame:
    """Mean direction and widest angle of every block."""
    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _unit(pdf["vec"])
        zero = not m.any(axis=1).all()
        c = m.mean(axis=0)
        n = np.linalg.norm(c)
        # without a usable direction the block meets every other one
        wide = zero or n < 1e-9
        r = math.pi if wide else float(np.arccos(np.clip(m @ (c / n), -1, 1)).max())
        return pd.DataFrame([{"site": pdf["site"].iloc[0], "coarse": pdf["coarse"].iloc[0], "block": pdf["block"].iloc[0], "centre": (c / n if not wide else c).tolist(), "radius": r}])

    return rows.groupBy("site", "block").applyInPandas(span, f"site string, coarse long, block string, {_SPAN}")


def _coarse_spans(spans: DataFrame) -> DataFrame:
    """Direction and angle that hold all vectors of a group of blocks."""
    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.vstack(pdf["centre"])
        mean = c.mean(axis=0)
        n = np.linalg.norm(mean)
        wide = n < 1e-9 or (pdf["radius"] >= math.pi).any()
        r = math.pi if wide else float((np.arccos(np.clip(c @ (mean / n), -1, 1)) + pdf["radius"].to_numpy()).max())
        return pd.DataFrame([{"site": pdf["site"].iloc[0], "coarse": pdf["coarse"].iloc[0], "centre": (mean if wide else mean / n).tolist(), "radius": r}])

    return spans.groupBy("site", "coarse").applyInPandas(span, f"site string, coarse long, {_SPAN}")


def _sides(t: DataFrame):
    return [t.select(*[F.col(c).alias(f"{c}_{side}") if c != "site" else F.col(c) for c in t.columns]) for side in "ab"]


def _reachable(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs of spans that can hold two vectors of at least the site's limit, by the triangle inequality on angles."""
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius_a") - F.col("radius_b")
    return pairs.join(limits, "site").filter(gap <= F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("limit")))) + 1e-6).drop("limit")


def _block_pairs(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs of different blocks that can hold a pair of at least the site's ``limit``.

    Groups of blocks are paired first, a few per site, and only the blocks of groups within reach meet.
    """
    spans = cut(_block_spans(rows))
    ca, cb = _sides(_coarse_spans(spans))
    near = _reachable(ca.join(cb, "site").filter("coarse_a <= coarse_b"), limits).select("site", "coarse_a", "coarse_b")
    a, b = _sides(spans)
    met = near.join(a, ["site", "coarse_a"]).join(b, ["site", "coarse_b"]).filter((F.col("coarse_a") < F.col("coarse_b")) | (F.col("block_a") < F.col("block_b")))
    return _reachable(met, limits).select("site", F.least("block_a", "block_b").alias("block_a"), F.greatest("block_a", "block_b").alias("block_b"))


def _own_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("site", F.col("block").alias("block_a"), F.col("block").alias("block_b")).distinct()


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of every block with itself and with the blocks in reach of the threshold."""
    limits = rows.select("site").distinct().withColumn("limit", F.lit(float(threshold)))
    return _paired_rows(rows, _own_pairs(rows).unionByName(_block_pairs(rows, limits)))


def _paired_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    left = pairs.select("site", F.col("block_a").alias("block"), "block_a", "block_b")
    right = pairs.filter(F.col("block_a") != F.col("block_b")).select("site", F.col("block_b").alias("block"), "block_a", "block_b")
    return rows.join(left.unionByName(right), ["site", "block"])


def _strips(pdf: pd.DataFrame):
    """The pages of both sides of a block pair, and an iterator of its similarities, ``STRIP_ROWS`` left pages at a time: (first left row, similarities,
    which of them are pairs). No matrix of a whole block pair is ever made."""
    pdf = pdf.sort_values("page", kind="stable")
    left = pdf[pdf["block"] == pdf["block_a"].iloc[0]]
    same = pdf["block_a"].iloc[0] == pdf["block_b"].iloc[0]
    right = left if same else pdf[pdf["block"] == pdf["block_b"].iloc[0]]

    def strips():
        a, b = _unit(left["vec"]), _unit(right["vec"]).T
        for at in range(0, len(a), STRIP_ROWS):
            sim = a[at:at + STRIP_ROWS] @ b
            rows, cols = np.arange(at, at + len(sim))[:, None], np.arange(b.shape[1])[None, :]
            yield at, sim, cols > rows if same else np.ones(sim.shape, dtype=bool)

    return left["page"].to_numpy(), right["page"].to_numpy(), same, strips()


def _named(site, a, b, sim) -> pd.DataFrame:
    swap = a > b
    return pd.DataFrame({"site": site, "a": np.where(swap, b, a), "b": np.where(swap, a, b), "sim": sim})


def cosine_pairs(reps: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """J19. Pairs a < b of distinct vectors of a site with cosine >= threshold."""
    return _block_cosines(_blocks(reps, block_rows), threshold)


def _block_cosines(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of the rows of blocks with cosine >= threshold; a page may be a string or a number."""
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, _, strips = _strips(pdf)
        found = []
        for at, sim, usable in strips:
            i, j = np.nonzero(usable & (sim >= threshold))
            found.append(_named(pdf["site"].iloc[0], p[at + i], q[j], sim[i, j]))
        return pd.concat(found)

    return _compared(blocks, threshold).groupBy("site", "block_a", "block_b").applyInPandas(
        compare, "site string, a {0}, b {0}, sim double".format(blocks.schema["page"].dataType.simpleString())
    )


def link_forest(reps: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(site, a, b) edges with the same components as J19 but at most one edge per vector and block pair,
    so a dense group of near copies costs its size and not its square."""
    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, same, strips = _strips(pdf)
        near = np.zeros((len(p), len(q)), dtype=bool)
        for at, sim, usable in strips:
            near[at:at + len(sim)] = usable & (sim >= threshold)
        if same:
            near = near | near.T
        todo_l, todo_r = near.any(axis=1), near.any(axis=0)
        out_a, out_b = [], []
        while todo_l.any():
            root = int(np.argmax(todo_l))
            todo_l[root] = False
            wave = np.array([root])
            while wave.size:
                hit = near[wave].any(axis=0) & todo_r
                todo_r &= ~hit
                if same:
                    hit &= todo_l
                    new = np.nonzero(hit)[0]
                    todo_l[new] = False
                    reached, wave = p[new], new
                    out_b.extend(reached)
                else:
                    back = near[:, hit].any(axis=1) & todo_l
                    todo_l &= ~back
                    wave = np.nonzero(back)[0]
                    reached = np.concatenate([q[hit], p[wave]])
                    out_b.extend(reached)
                out_a.extend([p[root]] * len(reached))
        return pd.DataFrame({"site": pdf["site"].iloc[0], "a": out_a, "b": out_b}).astype(str)

    return _compared(_blocks(reps, block_rows), threshold).groupBy("site", "block_a", "block_b").applyInPandas(
        forest, "site string, a string, b string"
    )


def nearest_pairs(vectors: DataFrame, top: int = 15, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """L01. The most similar pairs of a site. Only the first top + 1 pages of each set of equal vectors can
    reach the list, and every block pair hands on its own best pairs only. Pairs within blocks come first: the last of a site's
    best ones bounds what other block pairs must be able to reach."""
    w = Window.partitionBy("site", "vec").orderBy("page")
    rows = vectors.withColumn("copy", F.row_number().over(w)).filter(F.col("copy") <= top + 1)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, _, strips = _strips(pdf)
        out = _named(pdf["site"].iloc[0], p[:0], q[:0], np.empty(0))
        for at, sim, usable in strips:
            s = np.where(usable, np.round(sim, 3), -np.inf)
            k = min(top, int(usable.sum()))
            if k == 0:
                continue
            limit = np.partition(s.ravel(), s.size - k)[s.size - k]
            if len(out) == top:
                limit = max(limit, out["sim"].iloc[-1])
            i, j = np.nonzero(usable & (s >= limit))
            found = _named(pdf["site"].iloc[0], p[at + i], q[j], s[i, j])
            out = pd.concat([out, found]).sort_values(["sim", "a", "b"], ascending=[False, True, True]).head(top)
        return out

    def best_of(pairs: DataFrame) -> DataFrame:
        found = _paired_rows(blocks, pairs).groupBy("site", "block_a", "block_b").applyInPandas(best, "site string, a string, b string, sim double")
        return ranked(found)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("site").orderBy(F.desc("sim"), "a", "b")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    blocks = cut(_blocks(rows, block_rows))
    inside = cut(best_of(_own_pairs(blocks)))
    # similarities are rounded to three places, so a pair may round up to the bound
    known = inside.groupBy("site").agg(F.when(F.count("*") >= top, F.min("sim") - 0.0006).alias("limit"))
    limits = blocks.select("site").distinct().join(known, "site", "left").select("site", F.coalesce("limit", F.lit(-1.0)).alias("limit"))
    return ranked(inside.drop("rank").unionByName(best_of(_block_pairs(blocks, limits)).drop("rank")))


def components(edges: DataFrame) -> DataFrame:
    """G01. (site, node, component): the smallest node reachable over (site, a, b) edges.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): every step is a min-aggregate and a join, a node's neighbours are never gathered.
    """
    e = cut(edges.select("site", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.select("site", "u", "v").unionByName(e.select("site", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("site", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(low, ["site", "u"]).select("site", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("site", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["site", "u"]).select("site", F.col("v").alias("u"), F.col("m").alias("v"))
        star = small.filter("u <> v").unionByName(low.select("site", "u", F.col("m").alias("v"))).distinct()
        before, e = e, cut(star)
        if e.count() == before.count() and e.join(before, ["site", "u", "v"], "left_anti").isEmpty():
            break
    return e.select("site", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select("site", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def threshold_clusters(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """G01 over vectors: (site, page, cluster); singletons keep their own page as cluster."""
    reps = distinct_vectors(vectors)
    edges = link_forest(reps, threshold, block_rows).unionByName(copy_edges(vectors, reps))
    comp = components(edges).select("site", F.col("node").alias("page"), "component")
    return vectors.select("site", "page").join(comp, ["site", "page"], "left").select(
        "site", "page", F.coalesce("component", "page").alias("cluster")
    )


def linkage_clusters(vectors: DataFrame, threshold: float, linkage: str = "complete", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """G02. Agglomerative clusters whose linkage similarity stays above the threshold: (site, page, cluster).

    Complete and average linkage are reducible, so all pairs of clusters that are each other's nearest
    can merge in the same round and the outcome equals merging one pair at a time. Only cluster pairs above the threshold are kept: a
    merged cluster's similarity to another is the least or the mean of its parts', so a pair can be above it only where a pair of parts was, with
    complete linkage only where all were. A mean whose parts are not all kept is taken from the two clusters' mean vectors. Copies start merged.
    Clusters are numbers in the order of their first pages, so pairs are three numbers. Clusters of different components of the kept pairs never
    merge, so components of bounded size are settled in a task each; the rounds go on with larger ones.
    """
    if linkage not in ("complete", "average"):
        raise ValueError(f"unknown linkage {linkage!r}")
    reps = _numbered_vectors(vectors)
    blocks = cut(_blocks(reps.select("site", F.col("id").alias("page"), "vec"), block_rows))
    edges = cut(_block_cosines(blocks, threshold).filter(F.col("sim") > threshold).select("a", "b", "sim"))
    nodes = None
    if linkage == "average":
        units = blocks.select(F.col("page").alias("c"), "site", "block", _unit_column("vec").alias("mean"))
        nodes = cut(units.join(reps.select(F.col("id").alias("c"), F.col("copies").alias("weight")), "c"))
    member, rounds, split = reps.select("id", F.col("id").alias("c")), 0, FIRST_SPLIT
    while True:
        if rounds == split:
            split *= 2
            own = _bounded_components(edges)
            inside = edges.join(own.withColumnRenamed("c", "a"), "a")
            settled = _settled_components(inside, nodes.join(own, "c") if nodes is not None else None, threshold, linkage)
            member = cut(member.join(settled, "c", "left").select("id", F.coalesce("to", "c").alias("c")))
            edges = cut(edges.join(own.select(F.col("c").alias("a")), "a", "left_anti").select("a", "b", "sim"))
        rounds += 1
        merge = _mutual(edges)
        for end in "ab" if nodes is not None else "":
            merge = merge.join(nodes.select(F.col("c").alias(end), F.col("weight").alias(f"w{end}")), end)
        merge = cut(merge)
        if merge.isEmpty():
            break
        share = lambda end: F.col(f"w{end}") / (F.col("wa") + F.col("wb")) if nodes is not None else F.lit(1.0)
        into = merge.select(F.explode(F.array(*[F.struct(F.col(end).alias("c"), F.col("a").alias("to"), share(end).alias("share")) for end in "ab"])).alias("m")).select("m.*")
        member = cut(member.join(into.drop("share"), "c", "left").select("id", F.coalesce("to", "c").alias("c")))
        moved = _moved(edges, into, linkage)
        if nodes is None:
            edges = cut(moved.filter("n = needed").select("a", "b", "sim"))
            continue
        moved, nodes = cut(moved), cut(_merged_nodes(nodes, into))
        kept = moved.filter("n = needed").select("a", "b", "sim").unionByName(_mean_cosines(moved.filter("n < needed").select("a", "b"), nodes))
        edges = cut(kept.filter(F.col("sim") > threshold))
        nodes = nodes.join(edges.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    r = reps.select("site", "vec", F.col("page").alias("first"), "id")
    copies = vectors.join(r, ["site", "vec"]).filter(F.col("page") != F.col("first")).select("site", "page", "id")
    named = member.join(reps.select(F.col("id").alias("c"), F.col("page").alias("cluster")), "c")
    return copies.unionByName(reps.select("site", "page", "id")).join(named, "id").select("site", "page", "cluster")


def _numbered_vectors(vectors: DataFrame) -> DataFrame:
    """distinct_vectors with ``id``, their number in the order of site and page; stored. Rows are dealt by range, so no site is sorted in one task."""
    reps = cut(distinct_vectors(vectors).filter(F.col("site").isNotNull() & F.col("page").isNotNull()))
    return cut(reps.repartitionByRange("site", "page").sortWithinPartitions("site", "page").withColumn("id", F.monotonically_increasing_id()))


def _bounded_components(edges: DataFrame) -> DataFrame:
    """(c, component) of the clusters in components of at most TASK_CLUSTERS of them; stored."""
    found = cut(components(edges.select(F.lit("").alias("site"), "a", "b")).select(F.col("node").alias("c"), "component"))
    small = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= TASK_CLUSTERS).select("component")
    return cut(found.join(small, "component").select("c", "component"))


def _settled_components(edges: DataFrame, nodes: DataFrame | None, threshold: float, linkage: str) -> DataFrame:
    """(c, to): the final cluster of the clusters of whole components, a component in a task."""
    def merged(sim: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
        # rows are in the order of ids, so the first of equal similarities is the pair that comes first
        all_ids, to, live = ids, np.arange(len(ids)), np.arange(len(ids))
        while len(live) > 1:
            np.fill_diagonal(sim, -np.inf)
            near = sim.argmax(axis=1)
            at = np.arange(len(live))
            a = at[(near[near] == at) & (at < near) & (sim[at, near] > threshold)]
            if not a.size:
                break
            b = near[a]
            for m in (sim, sim.T):
                if linkage == "complete":
                    m[a] = np.minimum(m[a], m[b])
                else:
                    share = (weight[a] / (weight[a] + weight[b]))[:, None]
                    np.fill_diagonal(sim, 0.0)
                    m[a] = share * m[a] + (1 - share) * m[b]
            weight[a] += weight[b]
            into = np.arange(len(all_ids))
            into[live[b]] = live[a]
            to, stay = into[to], np.delete(at, b)
            sim, weight, live = sim[np.ix_(stay, stay)], weight[stay], live[stay]
            sim = (sim + sim.T) / 2  # rounding must not make one side's nearest differ from the other's
        return pd.DataFrame({"c": all_ids, "to": all_ids[to]})

    def complete(e: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(e[["a", "b"]].to_numpy())
        i, j = np.searchsorted(ids, e["a"]), np.searchsorted(ids, e["b"])
        sim = np.full((len(ids), len(ids)), -np.inf)
        sim[i, j] = sim[j, i] = e["sim"]
        return merged(sim, ids, np.ones(len(ids)))

    def average(n: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("c")
        m = np.vstack(n["mean"])
        sim = m @ m.T
        return merged((sim + sim.T) / 2, n["c"].to_numpy(), n["weight"].to_numpy(dtype=np.float64))

    if linkage == "complete":
        return edges.groupBy("component").applyInPandas(complete, "c long, to long")
    return nodes.select("component", "c", "mean", "weight").groupBy("component").applyInPandas(average, "c long, to long")


def _mutual(edges: DataFrame) -> DataFrame:
    """(a, b) of the clusters that are each other's nearest."""
    ends = edges.select(F.col("a").alias("c"), F.col("b").alias("o"), "sim").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("o"), "sim"))
    near = ends.groupBy("c").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))).alias("m"))
    return near.groupBy("m.a", "m.b").agg(F.count("*").alias("k")).filter("k = 2").select("a", "b")


def _moved(edges: DataFrame, into: DataFrame, linkage: str) -> DataFrame:
    """(a, b, sim, n, needed): pairs of merged clusters from the ``n`` pairs of their parts that are kept, of ``needed`` in all."""
    for end in "ab":
        edges = edges.join(into.select(F.col("c").alias(end), F.col("to").alias(f"to_{end}"), F.col("share").alias(f"share_{end}")), end, "left")
    a, b = F.coalesce("to_a", "a"), F.coalesce("to_b", "b")
    needed = F.when(F.col("to_a").isNull(), 1).otherwise(2) * F.when(F.col("to_b").isNull(), 1).otherwise(2)
    share = F.coalesce("share_a", F.lit(1.0)) * F.coalesce("share_b", F.lit(1.0))
    sim = F.min("sim") if linkage == "complete" else F.sum("part")
    return edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "sim", (F.col("sim") * share).alias("part"), needed.alias("needed")).groupBy(
        "a", "b", "needed").agg(sim.alias("sim"), F.count("*").alias("n"))


def _merged_nodes(nodes: DataFrame, into: DataFrame) -> DataFrame:
    """(c, site, block, mean, weight) with merged clusters in the block of their first one."""
    shared = nodes.join(into, "c", "left").select(
        F.coalesce("to", "c").alias("c"), F.col("c").alias("was"), "site", "block", "weight", F.when(F.col("to").isNull(), F.col("mean")).otherwise(F.transform("mean", lambda x: x * F.col("share"))).alias("mean"))
    first, other = shared.filter(F.col("c") == F.col("was")), shared.filter(F.col("c") != F.col("was")).select("c", F.col("weight").alias("w2"), F.col("mean").alias("m2"))
    return first.join(other, "c", "left").select(
        "c", "site", "block", F.when(F.col("m2").isNull(), F.col("mean")).otherwise(F.zip_with("mean", "m2", lambda x, y: x + y)).alias("mean"), (F.col("weight") + F.coalesce("w2", F.lit(0))).alias("weight"))


def _mean_cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, sim): the products of the mean vectors of given pairs, by pairs of blocks, so a vector is sent once for each block that it has pairs in."""
    def products(e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if e.empty:
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        at, m = pd.Index(n["c"]), np.vstack(n["mean"])
        i, j, sim = at.get_indexer(e["a"]), at.get_indexer(e["b"]), np.empty(len(e))
        for k in range(0, len(e), BLOCK_ROWS):
            sim[k:k + BLOCK_ROWS] = np.einsum("ij,ij->i", m[i[k:k + BLOCK_ROWS]], m[j[k:k + BLOCK_ROWS]])
        return pd.DataFrame({"a": e["a"], "b": e["b"], "sim": sim})

    key = ["site", "block_a", "block_b"]
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("c").alias(end), *([F.col("site")] if end == "a" else []), F.col("block").alias(f"in_{end}")), end)
    placed = cut(pairs.select("site", F.least("in_a", "in_b").alias("block_a"), F.greatest("in_a", "in_b").alias("block_b"), "a", "b"))
    rows = _paired_rows(nodes.select("site", "block", "c", "mean"), placed.select(*key).distinct())
    rows = rows.select(F.col("site").alias("s"), F.col("block_a").alias("left"), F.col("block_b").alias("right"), "c", "mean")
    return placed.groupBy(*key).cogroup(rows.groupBy("s", "left", "right")).applyInPandas(products, "a long, b long, sim double")


def _unit_column(col: str):
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def cluster_members(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """G03. (site, cluster, page, size, cohesion, representative).

    With S the sum of a group's unit vectors, its mean off-diagonal similarity is (|S|^2 - sum |v|^2) / n(n-1)
    and a page's similarity sum is v.S, so no pair of a group is ever formed (A08, A09).
    """
    key = ["site", "cluster"]
    sizes = assigned.groupBy(*key).agg(F.count("*").alias("size"), F.min("page").alias("only"))
    unit = vectors.select("site", "page", _unit_column("vec").alias("vec")).join(assigned, ["site", "page"])
    unit = unit.join(sizes.filter("size >= 2").select(*key), key, "left_semi")
    dims = unit.select(*key, F.posexplode("vec").alias("d", "x")).groupBy(*key, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = dims.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("total"),
        (F.sum(F.col("s") * F.col("s")) - F.sum("q")).alias("off"),
    )
    pull = F.aggregate(F.zip_with("vec", "total", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    centre = unit.join(sums.select(*key, "total"), key).select(*key, "page", F.round(pull, 9).alias("pull")).groupBy(*key).agg(
        F.min(F.struct((-F.col("pull")).alias("p"), "page")).alias("c")
    )
    facts = sizes.join(sums.select(*key, "off"), key, "left").join(centre, key, "left").select(
        *key, "size",
        F.when(F.col("size") < 2, 1.0).otherwise(F.round(F.col("off") / (F.col("size") * (F.col("size") - 1)), 3)).alias("cohesion"),
        F.coalesce("c.page", "only").alias("representative"),
    )
    return assigned.join(facts, key).select("site", "cluster", "page", "size", "cohesion", "representative")


def cluster_table(members: DataFrame) -> DataFrame:
    """G03. One row per cluster, biggest first."""
    return members.select("site", "cluster", "size", "cohesion", "representative").distinct().orderBy(
        "site", F.desc("size"), F.desc("cohesion"), "cluster"
    )


def members_with_metrics(members: DataFrame, metrics: DataFrame) -> DataFrame:
    """J08. Members with the metrics of their slug (site, page, clicks, impressions, position); zeros when missing."""
    return members.join(metrics, ["site", "page"], "left").select(
        *members.columns, F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("impressions", F.lit(0)).alias("impressions"), "position"
    )


def perf_order():
    """Best performer first: clicks, impressions, position, page."""
    return F.struct(
        (-F.col("clicks")).alias("c"), (-F.col("impressions")).alias("i"), F.coalesce("position", F.lit(9999.0)).alias("p"), F.col("page").alias("g")
    )


def cluster_performance(enriched: DataFrame) -> DataFrame:
    """J08. Canonical page by performance and sums of every cluster."""
    return enriched.groupBy("site", "cluster", "size", "cohesion", "representative").agg(
        F.min(perf_order())["g"].alias("canonical"), F.sum("clicks").alias("group_clicks"), F.sum("impressions").alias("group_impressions")
    ).withColumn("canonical_differs", F.col("canonical") != F.col("representative"))


def group_totals(perf: DataFrame) -> DataFrame:
    """A24."""
    multi = F.col("size") >= 2
    return perf.groupBy("site").agg(
        F.count("*").alias("groups"), F.count_if(multi).alias("multi_groups"), F.count_if(~multi).alias("single_groups"),
        F.sum("size").alias("pages"),
        F.sum(F.when(multi, F.col("group_clicks")).otherwise(0)).alias("clicks"),
        F.sum(F.when(multi, F.col("group_impressions")).otherwise(0)).alias("impressions"),
    )


def group_priority(perf: DataFrame, top: int = 8) -> DataFrame:
    """L02. The groups worth a closer look: most impressions, then size."""
    w = Window.partitionBy("site").orderBy(F.desc("group_impressions"), F.desc("size"), "cluster")
    return perf.filter("size >= 2").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
