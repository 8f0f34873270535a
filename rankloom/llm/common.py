"""Helpers shared by the operators: bounded slices of Arrow batches, vectorised word hashes, bit maps of bounded size."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


#: Rows of an Arrow batch between the JVM and Python; whole texts make the usual ten thousand too many for a small executor.
BATCH_ROWS = 2048
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows, as the operators that send whole texts to Python need it."""
    if not 0 < int(df.sparkSession.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most, or one row. Freed batches go back to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size + 1) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class Words:
    """Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow array without a Python object per word.

    Equal words have equal hashes; two different words share one with a chance of about 2^-64.
    ``lower`` folds A-Z only.
    """

    def __init__(self, lower: bool = True):
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        codes = np.arange(256, dtype=np.uint64)
        if lower:
            codes[65:91] += np.uint64(32)
        self.codes = mix((codes + np.uint64(1)) * _MULT)
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            base = int(_MULT) | 1
            back = pow(base, -1, 1 << 64)
            p = np.full(n, base, dtype=np.uint64)
            q = np.full(n, back, dtype=np.uint64)
            p[0] = q[0] = 1
            self.powers, self.inverse = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, hashes): the words of text i are hashes[offsets[i]:offsets[i + 1]]; a null has none."""
        return self.located(*text_bytes(texts))[:2]

    def located(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, hashes, first bytes, end bytes) of the words of texts given as bytes and borders."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(len(at), dtype=np.int64), np.zeros(0, dtype=np.uint64), none, none
        self._room(n + 1)
        blank = self.space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        starts = np.flatnonzero(~blank & (edge[:n] | np.concatenate(([True], blank[:-1]))))
        ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.powers[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _MIX2)
        return np.searchsorted(starts, at).astype(np.int64), hashes, starts, ends


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[at[0] : at[-1]] if buf is not None and len(at) and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return data, at - (at[0] if len(at) else 0)


def window_hashes(offsets: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of every window of k consecutive words of one document, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _MULT + words[i : i + n]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[k - 1 :]
    doc = doc[:n][inside]
    pos = np.flatnonzero(inside) - offsets[doc]
    return doc, pos, mix(h[inside])


def shingle_sets(offsets: np.ndarray, words: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): every document's sorted distinct k-word shingles; fewer than k words make one shingle, none an empty set."""
    doc, _, h = window_hashes(offsets, words, k)
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([_whole(words[offsets[i] : offsets[i + 1]]) for i in short], dtype=np.uint64)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, own))
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    at = np.searchsorted(doc, np.arange(len(count) + 1))
    h = h.copy()
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[new], np.arange(len(count) + 1)), h[new]


def _whole(words: np.ndarray) -> int:
    total = len(words)
    for w in words.tolist():
        total = (total * int(_MULT) + w) & 0xFFFFFFFFFFFFFFFF
    return total


def bit_map(keys: DataFrame, key: str, bits: int = 24) -> np.ndarray:
    """Which of 2^bits positions the 64-bit ``key`` values fall on, as packed bytes: 2^(bits - 3) bytes whatever the input's size.

    A filter by it may let other keys pass, never hold back one of these; an exact join follows it.
    """
    slot = keys.select(F.pmod(F.col(key), F.lit(1 << bits)).alias("slot"))
    parts = slot.groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("map"))
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for row in parts.toLocalIterator():  # 2^bits / 32768 rows of 4 KB at most
        # bucket b holds slots (b - 1) * 32768 + 1 to b * 32768, bucket 0 slot 0 alone
        first = (row["b"] - 1) * 4096
        if row["b"] == 0:
            out[-1] = 1
        else:
            out[first : first + 4096] |= np.frombuffer(bytes(row["map"]), dtype=np.uint8)
    return out


def in_bit_map(found: np.ndarray, keys: np.ndarray, bits: int = 24) -> np.ndarray:
    """For 64-bit keys, whether each may be among those of the map."""
    slot = (keys.astype(np.int64) & ((1 << bits) - 1)).astype(np.int64)
    bit = slot - 1  # bitmap_bit_position counts from the second slot of a bucket
    hit = (found[np.maximum(bit, 0) >> 3] >> (np.maximum(bit, 0) & 7).astype(np.uint8)) & 1
    return np.where(slot == 0, found[-1] == 1, hit == 1)


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")
