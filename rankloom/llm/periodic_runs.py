"""Periodic run detection (operator 11): recompression and extension queries on the run-length grammar.

A run is a maximal stretch of words with smallest period q, of at least max(LEAST_WORDS, LEAST_POWERS * q) words.

Candidates lie on harmonic grids: a stretch of four periods p holds four multiples of p, whose words are equal; all grids of a text
of n words have about n ln n points. A slice of texts (with a symbol of its own between any two) is recompressed: blocks of one
symbol become (symbol, count), then a hash bit parts the symbols into left and right ones and every left-right pair becomes one
symbol, until one symbol is left. Two candidate positions p apart are extended to both sides on that grammar: equal symbols of a
level are skipped as a whole, the walk climbs where both sides are at a border of the next level and descends where they differ, so
a query takes a few steps a level and gives the exact number of equal words. No suffix array is built.

Texts are handled where they lie, in slices of Arrow batches; nothing is shuffled. Memory follows the slice, or the longest text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import WORD, Words, mix, slices, text_bytes, whole_texts

LEAST_WORDS, LEAST_POWERS = 6, 4
#: Grid points looked at together, and extension queries asked together.
GRID_POINTS, QUERIES = 1 << 18, 1 << 17
SLICE = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


class Grammar:
    """A run-length grammar of one sequence of symbols (non-negative integers), by recompression.

    The levels lie one after another in flat arrays. Entry k of a level is its k-th symbol and the border before it; each level ends with a border
    entry of symbol -1. ``first`` and ``last`` bound the block of equal symbols an entry lies in, ``place`` is the border's
    position in the sequence, ``up`` the same border one level higher or -1, ``down`` the same border one level lower.
    """

    def __init__(self, symbols: np.ndarray):
        names, place = symbols.astype(np.int64), np.arange(len(symbols) + 1)
        parts, base, down, round_no = {k: [] for k in ("sym", "first", "last", "place", "up", "down")}, 0, np.full(len(symbols) + 1, -1), 0
        while True:
            n = len(names)
            heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            counts = np.diff(np.append(heads, n))
            block = np.repeat(np.arange(len(heads)), counts)
            first, last = np.append(heads[block], n), np.append((heads + counts)[block], n)
            for k, v in (("sym", np.append(names, -1)), ("first", base + first), ("last", base + last), ("place", place), ("down", down)):
                parts[k].append(v)
            if len(heads) == 1:
                parts["up"].append(np.full(n + 1, -1))
                break
            blocks = np.unique(names[heads] * (n + 1) + counts, return_inverse=True)[1]
            starts_pair, round_no = self._left_of_pairs(blocks, round_no)
            kept = np.ones(len(blocks), dtype=bool)
            kept[1:] = ~starts_pair[:-1]
            mate = np.where(starts_pair, np.append(blocks[1:], 0) + 1, 0)
            names = np.unique((blocks * (len(blocks) + 2) + mate)[kept], return_inverse=True)[1]
            borders = np.append(heads[kept], n)  # entries of this level that begin a symbol of the next
            up = np.full(n + 1, -1)
            up[borders] = base + n + 1 + np.arange(len(borders))
            parts["up"].append(up)
            place, down, base = place[borders], base + borders, base + n + 1
        self.sym, self.first, self.last, self.place, self.up, self.down = (np.concatenate(parts[k]) for k in ("sym", "first", "last", "place", "up", "down"))

    @staticmethod
    def _left_of_pairs(blocks: np.ndarray, round_no: int) -> tuple[np.ndarray, int]:
        """Which symbols begin a pair; neighbours differ, so a quarter of them do on average, whatever the text."""
        while True:
            round_no += 1
            right = (mix(blocks.astype(np.uint64) + np.uint64(round_no << 40)) & np.uint64(1)).astype(bool)
            left_right, right_left = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
            pairs = left_right if left_right.sum() >= right_left.sum() else right_left
            if pairs.any():
                return np.append(pairs, False), round_no

    def extend(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """For positions x < y, how many symbols from them on (or before them, backward) are equal."""
        out, query, a, b = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), x.copy(), y.copy()
        while len(query):
            at_a, at_b = (a, b) if forward else (a - 1, b - 1)
            equal = self.sym[at_a] == self.sym[at_b]
            if forward:
                skip = np.minimum(self.last[at_a] - a, self.last[at_b] - b)
            else:
                skip = -np.minimum(a - self.first[at_a], b - self.first[at_b])
            a, b = np.where(equal, a + skip, a), np.where(equal, b + skip, b)
            up_a, up_b, down_a, down_b = self.up[a], self.up[b], self.down[a], self.down[b]
            climb, done = equal & (up_a >= 0) & (up_b >= 0), ~equal & (down_a < 0)
            out[query[done]] = self.place[a[done]]
            a, b = np.where(climb, up_a, np.where(equal, a, down_a)), np.where(climb, up_b, np.where(equal, b, down_b))
            query, a, b = query[~done], a[~done], b[~done]
        return out - x if forward else x - out


def grid_candidates(offsets: np.ndarray, words: np.ndarray, powers: int = LEAST_POWERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, position) of all grid points i, a multiple of the period p, with equal words at i, i + p, ... i + (powers - 1) * p."""
    size = np.diff(offsets)
    longest = size // powers
    text = np.repeat(np.arange(len(size)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    points = (size[text] - 1) // period - (powers - 2)
    reach = np.cumsum(points)
    found, a = [], 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + GRID_POINTS, side="right")))
        row = np.repeat(np.arange(a, b), points[a:b])
        step = period[row]
        at = (np.arange(len(row)) - np.repeat(reach[a:b] - points[a:b] - (reach[a - 1] if a else 0), points[a:b])) * step
        place = offsets[text[row]] + at
        for k in range(1, powers):
            same = words[place] == words[place + k * step]
            row, step, place = row[same], step[same], place[same]
        found.append((text[row], step, place))
        a = b
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (none, none, none)


def find_runs(offsets: np.ndarray, words: np.ndarray, least: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> np.ndarray:
    """(text, start, length, period) rows of all runs, by text, start and period; ``words``: one number a word, texts one after another."""
    text, period, place = grid_candidates(offsets, words, powers)
    if not len(text):
        return np.zeros((0, 4), dtype=np.int64)
    # the texts with candidates in one sequence, each followed by a symbol of its own
    chosen = np.unique(text)
    size = np.diff(offsets)[chosen]
    begin = np.cumsum(size + 1) - size - 1
    at = np.repeat(begin, size) + (ranks := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    sequence = np.empty(int(size.sum() + len(size)), dtype=np.int64)
    ids = np.unique(words[np.repeat(offsets[chosen], size) + ranks], return_inverse=True)[1]
    sequence[at] = ids
    sequence[begin + size] = len(ids) + np.arange(len(size))
    grammar = Grammar(sequence)
    slot = np.searchsorted(chosen, text)
    place = place - offsets[text] + begin[slot]
    # short periods first: what lies in a run of four periods p already needs no look at multiples of p again
    covering, until = np.zeros(len(sequence), dtype=np.int64), np.zeros(len(sequence), dtype=np.int64)
    found = {}
    order = np.argsort(period, kind="stable")
    text, period, place, slot = text[order], period[order], place[order], slot[order]
    low = 1
    while low <= period[-1]:
        a, b = np.searchsorted(period, [low, 2 * low])
        low *= 2
        for c in range(a, b, QUERIES):
            p, i, s = (v[c : min(b, c + QUERIES)] for v in (period, place, slot))
            known = covering[i]
            new = (known == 0) | (p % np.maximum(known, 1) != 0) | (until[i] < i + powers * p)
            p, i, s = p[new], i[new], s[new]
            left, right = grammar.extend(i, i + p, False), grammar.extend(i, i + p, True)
            start, length = i - left, left + right + p
            long = length >= np.maximum(least, powers * p)
            rows = np.stack((s[long], start[long], length[long], p[long]), axis=1)
            for k, first, n, q in np.unique(rows, axis=0).tolist():
                if found.setdefault((first, n), (k, q))[1] == q:
                    covering[first : first + n], until[first : first + n] = q, first + n
    rows = np.array([(k, first, n, q) for (first, n), (k, q) in found.items()], dtype=np.int64).reshape(-1, 4)
    rows = np.stack((chosen[rows[:, 0]], rows[:, 1] - begin[rows[:, 0]], rows[:, 2], rows[:, 3]), axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The texts without words that a run holds beyond its first period, their other words joined by one blank."""
    n = len(starts)
    edge = np.zeros(n + 1, dtype=np.int64)
    first = offsets[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, first + runs[:, 3], 1)
    np.add.at(edge, first + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    text = np.searchsorted(offsets, kept, side="right") - 1
    last = np.ones(len(kept), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    # a kept word brings its bytes and, unless it is its text's last, the white space after it as a blank
    data = data.copy()
    data[ends[kept[~last]]] = 32
    stop = ends[kept] + ~last
    size = stop - starts[kept]
    taken = data[np.repeat(starts[kept] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    reach = np.concatenate(([0], np.cumsum(np.bincount(text, weights=size, minlength=len(offsets) - 1)))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(reach), pa.py_buffer(taken)).cast(pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, powers: int = LEAST_POWERS) -> DataFrame:
    """Every row of ``docs`` with ``runs`` (all runs of its whole text, in words, by start and period) and ``collapsed``.

    ``collapsed`` has the words that no run holds beyond its first period, joined by one blank. A null, empty or blank text has no runs and an
    empty ``collapsed``. Each row is judged alone, so repeated rows or ids and null ids need no rule; an empty table gives an empty
    one. Columns named like the new ones are replaced. Words are compared by 64-bit hashes.
    """
    if powers < 3:
        raise ValueError("candidates need three equal grid words at least")
    docs = docs.drop("runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lower=False)
        for b in slices(batches, text, SLICE):
            data, borders = text_bytes(b.column(text))
            offsets, hashes, starts, ends = words.located(data, borders)
            found = find_runs(offsets, hashes.view(np.int64), least, powers)
            at = pa.array(np.searchsorted(found[:, 0], np.arange(b.num_rows + 1)).astype(np.int32))
            rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(at, rows), _collapsed(offsets, data, starts, ends, found)], names=[*b.schema.names, "runs", "collapsed"])

    return whole_texts(docs).mapInArrow(run, schema)


def with_repetition(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a repetition in about a tenth of the texts, as the query's contract lays down: chosen and placed by a checksum of doc_id.

    From word a on a text goes on with its words from a in a circle of p words. A null doc_id gets none.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    a = F.pmod("g", n).cast("int")
    counted = chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    circle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(circle, F.lit(1), n - F.col("a"))), " ")
    return counted.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def _line(run: Column) -> Column:
    return F.concat_ws(",", run["start"], run["length"], run["period"])


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run and digests of all of them.

    Of runs of one length the first counts, then that of the shorter period; without a run the four are null.
    """
    rows = periodic_runs(with_repetition(docs)).drop("text")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.withColumn("longest", longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_line(r), F.lit("\n"))), "")
    length, period = F.col("longest.length"), -F.col("longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
