"""BPE encoding and decoding (operator 13): a segment tree over the ranks of adjacent pairs.

A text is cut at the vocabulary's special tokens, the rest into words by the byte-level pattern. A word starts as its bytes. Leaf i of
its tree holds the merge rank of live symbol i and the one after it; an inner node holds the lower of its two children, so the
root names the leftmost pair of the lowest rank. Merging it changes three leaves, each with one walk to the root, until no
pair can be merged: O(n log n) for a word of n bytes, however long. The short words of a slice that are new to a worker are merged side
by side, their trees as rows of one array; long words one by one.

Rows are encoded where they lie, in slices of Arrow batches; nothing is shuffled or gathered. A worker keeps the tokens of
short words it has met, up to a fixed number.
"""

import json
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import slices, whole_texts

VOCABULARY = "byte_bpe_50k.json"
#: White space of the splitting pattern, spelled out.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitting(letter: str, digit: str, blank: str) -> str:
    """Fixed value: the splitting pattern of byte-level vocabularies over the given classes."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


#: Words a worker remembers at most, and the longest of them in characters.
KEEP_WORDS, KEEP_BYTES = 300_000, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The symbols left when no adjacent pair has a rank any more; ``made`` has the symbol that each rank's merge gives."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, rank_of = symbols.copy(), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size, none = 1 << (n - 2).bit_length(), len(ranks) * n
    # a leaf is rank and place of its pair as one number, so that the least one is the leftmost of the lowest rank
    tree = [none] * (2 * size)
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        rank = rank_of(pair)
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    while tree[1] < none:
        rank, i = divmod(tree[1], n)
        j = after[i]
        symbols[i], symbols[j] = made[rank], -1
        after[i] = k = after[j]
        changes = [(i, none)] if k == n else [(i, rank_of((symbols[i], symbols[k]))), (j, none)]
        if k < n:
            before[k] = i
        if before[i] >= 0:
            changes.append((before[i], rank_of((symbols[before[i]], symbols[i]))))
        for at, low in changes:
            node = size + at
            tree[node] = low = none if low is None or low == none else low * n + at
            while node > 1:
                other = tree[node ^ 1]
                if other < low:
                    low = other
                node >>= 1
                if tree[node] == low:
                    break
                tree[node] = low
    return [s for s in symbols if s >= 0]


class PairForest:
    """The trees of many short words side by side, one row a word: each step merges the root's pair of every word that still has one."""

    def __init__(self, words: list[bytes], leaves: int, pairs: "BytePairs"):
        self.pairs, self.leaves, n = pairs, leaves, np.array([len(w) for w in words])
        self.n, self.none = n, (len(pairs.made) + 1) * leaves
        self.symbols = np.full((len(words), leaves + 1), -1, dtype=np.int64)
        self.symbols[np.arange(leaves + 1) < n[:, None]] = pairs.first_of[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.after = np.tile(np.arange(1, leaves + 2), (len(words), 1))
        self.before = self.after - 2
        self.tree = np.full((len(words), 2 * leaves), self.none, dtype=np.int64)
        row, i = np.nonzero(np.arange(leaves) + 1 < n[:, None])
        self.tree[row, leaves + i] = self._leaf(row, i, i + 1)
        for node in range(leaves - 1, 0, -1):
            self.tree[:, node] = np.minimum(self.tree[:, 2 * node], self.tree[:, 2 * node + 1])

    def _leaf(self, row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rank and place of the pairs of symbols at i and j; where one is missing or the pair has no rank, ``none``."""
        rank = self.pairs.rank_of(self.symbols[row, i], self.symbols[row, j])
        return np.where((i >= 0) & (j < self.n[row]) & (rank >= 0), rank * self.leaves + i, self.none)

    def merge_all(self) -> list[tuple[int, ...]]:
        row = np.arange(len(self.n))
        while True:
            row = row[self.tree[row, 1] < self.none]
            if not len(row):
                break
            rank, i = np.divmod(self.tree[row, 1], self.leaves)
            j = self.after[row, i]
            k, h = self.after[row, j], self.before[row, i]
            self.symbols[row, i], self.symbols[row, j] = self.pairs.made_of[rank], -1
            self.after[row, i], self.before[row, k] = k, i
            own, has_left = self._leaf(row, i, k), h >= 0
            three = np.tile(row, 3)
            at = np.concatenate((i, j, np.where(has_left, h, i)))
            low = np.concatenate((own, np.full(len(row), self.none), np.where(has_left, self._leaf(row, h, i), own)))
            node = self.leaves + at
            self.tree[three, node] = low
            while node[0] > 1:
                node = node >> 1
                self.tree[three, node] = np.minimum(self.tree[three, 2 * node], self.tree[three, 2 * node + 1])
        left = self.symbols >= 0
        flat, ends = self.symbols[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class BytePairs(dict):
    """A byte-level vocabulary: texts to ids and ids to texts. As a dict it holds the ids of words met before."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.first = [vocab[c] for c in letters]
        self.first_of = np.array(self.first)
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: content.encode() for content, i in self.special.items()}
        # the same as arrays: sorted pairs with their ranks, and the pieces' bytes one after another
        self.wide = max(pieces) + 1
        keys = np.array([a * self.wide + b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.made_of = np.append(keys[order], -1), np.append(np.array(list(self.ranks.values()))[order], -1), np.array(self.made)
        size = np.array([len(pieces.get(i, b"")) for i in range(self.wide)])
        self.piece_size, self.piece_begin = np.append(size, 0), np.append(np.cumsum(size) - size, 0)
        self.piece_bytes = np.frombuffer(b"".join(pieces[i] for i in sorted(pieces)), dtype=np.uint8)
        self.words = regex.compile(splitting(r"\p{L}", r"\p{N}", BLANK))
        self.ascii_words = re.compile(splitting("A-Za-z", "0-9", r"\t-\r "))
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of symbol pairs, -1 for a pair without one."""
        key = a * self.wide + b
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of ``words``; those of up to KEEP_BYTES bytes are merged side by side."""
        groups = {}
        for w in words:
            data = w.encode()
            if len(data) > KEEP_BYTES:
                self[w] = tuple(merge_word([self.first[b] for b in data], self.ranks, self.made))
            else:
                groups.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((w, data))
        for leaves, group in groups.items():
            for a in range(0, len(group), 4096):
                of_word, data = zip(*group[a : a + 4096])
                self.update(zip(of_word, PairForest(data, leaves, self).merge_all()))

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        words = (self.ascii_words if text.isascii() else self.words).findall
        if self.marks is None or not any(s in text for s in self.special):
            return words(text)
        return list(chain.from_iterable([part] if part in self.special else words(part) for part in self.marks.split(text)))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts; none for a null."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self) > KEEP_WORDS:
            self.clear()
        self.update((s, (i,)) for s, i in self.special.items())
        new = set().union(*split) - self.keys()
        self.learn(list(new))
        ids = [np.array(list(chain.from_iterable(map(self.__getitem__, words))), dtype=np.int32) for words in split]
        for w in new:
            if len(w) > KEEP_BYTES:
                del self[w]
        return ids

    def decode_all(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of runs of ids; an id outside the vocabulary gives nothing, bytes that are not UTF-8 give U+FFFD."""
        known = np.where((ids >= 0) & (ids < self.wide), ids, self.wide)
        size = self.piece_size[known]
        reach = np.concatenate(([0], np.cumsum(size)))
        data = self.piece_bytes[np.repeat(self.piece_begin[known] - reach[:-1], size) + np.arange(reach[-1])].tobytes()
        borders = reach[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(borders, borders[1:])]


def worker_pairs(path: str) -> BytePairs:
    """The vocabulary of this Python worker, read once and kept for its later tasks."""
    held = sys.modules.setdefault("rankloom_worker_pairs", types.ModuleType("rankloom_worker_pairs"))
    if getattr(held, "path", None) != path:
        held.pairs, held.path = BytePairs(path), path
    return held.pairs


def encode_texts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """Every row of ``docs`` with the token ids of its whole ``text`` in the array column ``into``, and all its columns.

    A null or empty text has an empty array. Rows are taken one by one, so repeated rows and ids, null ids and an empty table need
    no rule. A column named like ``into`` is replaced.
    """
    path = vocabulary or vocabulary_path()
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_pairs(path)
        for b in slices(batches, text, 1 << 20):
            ids = pairs.encode_all(b.column(text).to_pylist())
            at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids])))], names=[*b.schema.names, into])

    return whole_texts(docs).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, vocabulary: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Every row with the text of its array ``ids`` in the column ``into``; null ids give a null, an empty array an empty text.

    An id outside the vocabulary, or a null one, gives nothing; special tokens give their strings. A column named like ``into`` is replaced.
    """
    path = vocabulary or vocabulary_path()
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_pairs(path)
        for batch in batches:
            # a few rows at a time, so that the arrays of one group are held
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                lists = b.column(ids)
                values = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
                texts = pa.array(pairs.decode_all(offsets, values), pa.string(), mask=pc.is_null(lists).to_numpy(zero_copy_only=False))
                yield pa.record_batch([*b.columns, texts], names=[*b.schema.names, into])

    return whole_texts(rows).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its text encoded, and what its ids decode to."""
    encoded = encode_texts(docs.select("doc_id", "text"), vocabulary).drop("text")
    both = decode_ids(encoded, vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
