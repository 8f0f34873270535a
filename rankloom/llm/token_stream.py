"""Token-ID / binary output (operator 7): Arrow stream files of equal-length token sequences with masks.

A file is an Arrow IPC stream of record batches with two fixed-size-list columns, ``ids`` (uint16, or uint32 for a
vocabulary over 65,536) and ``mask`` (boolean, true for a token and false for filling), one row per sequence. As every row has the same width, sequence k of a file
lies at a fixed distance within its batch's buffer, so a reader that maps the file reaches it without copying (``TokenFile``).
Beside it a second stream, ``.docs``, lists the file's documents: doc_id, first token within the file, token count.

Documents are range-partitioned by doc_id, then by a hash of the text and the row's place, so one id of a third of the rows is many tasks' work; a task encodes its documents batch by batch and
writes one file, so nothing is gathered. A lost executor's task writes the same file again under a temporary
name and renames it. Global positions follow from the files' token totals, a few numbers a file.
"""

import os
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.lineage import checkpoint_root, cut
from rankloom.llm.common import Words, slices, text_bytes, whole_texts

END_ID = 1
SEQUENCE = 2048
BATCH_SEQUENCES = 256
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to token ids with a vocabulary of lower-case words that drops white space.

    No token crosses ASCII white space, so a text's ids are those of its words in order; the tests hold this against encoding
    whole texts. A worker encodes each distinct word once and finds it again by a 64-bit hash; the words held are bounded by ``keep``.
    a-z words skip the normaliser and splitter, which leave them as they are, and so do such words with an ASCII punctuation
    tail, which the splitter cuts off.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would each hold memory
        self.tok, self.words, self.keep = Tokenizer.from_file(path), Words(), keep
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.plain, self.tails = re.compile(r"([a-z]+)([!-&(-/:-@\[-`{-~]*)"), {}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin = self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.dtype)

    def _word_ids(self, words: list[str]) -> list[list[int]]:
        tokenize, out, rest = self.tok.model.tokenize, [], []
        for i, w in enumerate(words):
            m = self.plain.fullmatch(w.lower()) if w.isascii() else None
            if not m:
                rest.append(i)
                out.append(None)
                continue
            ids = [t.id for t in tokenize(m[1])]
            if m[2]:
                if m[2] not in self.tails:
                    if len(self.tails) > 100_000:
                        self.tails.clear()
                    self.tails[m[2]] = self.tok.encode(m[2], add_special_tokens=False).ids
                ids += self.tails[m[2]]
            out.append(ids)
        for i, e in zip(rest, self.tok.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, data: np.ndarray, spans: list[tuple[int, int]]) -> None:
        sizes, flats = [], []
        for a in range(0, len(spans), 2000):  # the library's results are large; few at a time stay small
            of_word = self._word_ids([data[s:e].tobytes().decode() for s, e in spans[a : a + 2000]])
            sizes += [len(x) for x in of_word]
            flats.append(np.array(list(chain.from_iterable(of_word)), dtype=self.dtype))
        size = np.array(sizes, dtype=np.int64)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, *flats))
        at = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = np.insert(self.known, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null has no tokens."""
        data, borders = text_bytes(texts)
        first, hashes, starts, ends = self.words.located(data, borders)
        distinct, where, word = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            spans = where[new]
            self._learn(distinct[new], data, list(zip(starts[spans].tolist(), ends[spans].tolist())))
            at = np.searchsorted(self.known, distinct)
        n = self.size[at][word] if len(word) else np.zeros(0, dtype=np.int64)
        stop = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat((self.begin[at][word] if len(word) else n) - stop[:-1], n) + np.arange(stop[-1])
        return stop[first], self.flat[take]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, made once and kept for its later tasks; what it keeps is bounded."""
    held = sys.modules.setdefault("rankloom_worker_state", types.ModuleType("rankloom_worker_state"))
    if getattr(held, "encoder_path", None) != path:
        held.encoder, held.encoder_path = Encoder(path), path
    return held.encoder


class _Sequences:
    """Fills fixed-length sequences from runs of ids and writes full batches."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.width, self.dtype = length, length * BATCH_SEQUENCES, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.width:
            run = np.concatenate(self.held)
            full = len(run) // self.width * self.width
            for a in range(0, full, self.width):
                self._write(run[a : a + self.width])
            self.held, self.n_held = [run[full:]], len(run) - full

    def _write(self, run: np.ndarray) -> None:
        fill = -len(run) % self.length
        ids = np.concatenate((run, np.zeros(fill, dtype=self.dtype)))
        mask = np.arange(len(ids)) < len(run)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        self.writer.close()


def write_token_files(docs: DataFrame, folder: str, encoder: Callable[[], Encoder], end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Writes every document of ``docs`` (doc_id, text) in ascending doc_id order and returns (file_no, path, n_docs, n_tokens), stored.

    A null text is empty and gives the end id alone; a null doc_id comes first; rows that repeat a doc_id follow each other by the hash
    of their text, then the text. An empty table writes no file. Other columns are not read.
    """
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    first = F.col("doc_id").asc_nulls_first()
    # equal rows encode alike, so their places only spread them over tasks; no text is a range key, as those are sampled to the driver
    ordered = rows.repartitionByRange(first, "hash", "place").sortWithinPartitions(first, "hash", F.col("text").asc_nulls_first())
    ordered = ordered.select(F.spark_partition_id().alias("file_no"), "doc_id", "text")
    run = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = None, None
        index = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        for b in slices(batches, "text", 1 << 20):
            if out is None:
                encode = encoder()
                file_no = b.column("file_no")[0].as_py()
                store, root = file_system(run)
                store.create_dir(root, recursive=True)
                path, part = f"{root}/{file_no:06d}.arrows", f".part-{uuid.uuid4().hex}"
                sink, docs_sink = store.open_output_stream(path + part), store.open_output_stream(path + ".docs" + part)
                out, listed = _Sequences(sink, length, encode.dtype), pa.ipc.new_stream(docs_sink, index)
            at, ids = encode(b.column("text"))
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            first = out.total + ends - n
            stream = np.full(ends[-1], end_id, dtype=encode.dtype)
            inner = np.ones(len(stream), dtype=bool)
            inner[ends - 1] = False
            stream[inner] = ids
            out.add(stream)
            listed.write_batch(pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(first), pa.array(n)], schema=index))
            n_docs += b.num_rows
        if out is not None:
            out.close()
            listed.close()
            sink.close()
            docs_sink.close()
            store.move(path + ".docs" + part, path + ".docs")
            store.move(path + part, path)
            yield pa.record_batch([pa.array([file_no], pa.int32()), pa.array([f"{run}/{file_no:06d}.arrows"]), pa.array([n_docs], pa.int64()), pa.array([out.total], pa.int64())], names=["file_no", "path", "n_docs", "n_tokens"])

    return cut(ordered.mapInArrow(write, "file_no int, path string, n_docs long, n_tokens long"))


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder that all executors share, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_tokens(path: str):
    """The record batches of a file; mapped without a copy where the store is a local or mounted folder."""
    store, at = file_system(path)
    source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
    return pa.ipc.open_stream(source)


class TokenFile:
    """Random access to the sequences of a token file. Where the store is a local or mounted folder the file is mapped and nothing is copied:
    opening it reads the batches' headers only, a sequence is a view of the mapped bytes."""

    def __init__(self, path: str):
        self.batches = list(open_tokens(path))
        self.ends = np.cumsum([b.num_rows for b in self.batches], dtype=np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``k``, counted from 0; IndexError beyond the last."""
        if not 0 <= k < len(self):
            raise IndexError(f"sequence {k} of {len(self)}")
        i = int(np.searchsorted(self.ends, k, side="right"))
        batch = self.batches[i]
        length = batch.schema.field("ids").type.list_size
        start = (k - int(self.ends[i]) + batch.num_rows) * length
        ids, mask = (batch.column(c).values.slice(start, length) for c in ("ids", "mask"))
        return ids.to_numpy(), mask


def read_documents(path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(document rows, their ids) read back from a file, batch by batch; holds one document batch and one sequence batch."""
    store, at = file_system(path)
    sequences = _valid_runs(path)
    held, start = np.zeros(0, dtype=np.uint16), 0
    with store.open_input_stream(at + ".docs") as source:
        for docs in pa.ipc.open_stream(source):
            ids = []
            for first, n in zip(docs.column("first").to_pylist(), docs.column("n_tokens").to_pylist()):
                got = [held[first - start :]]
                have = len(got[0])
                while have < n:
                    start += len(held)
                    held = next(sequences)
                    got.append(held)
                    have += len(held)
                run = got[0][:n] if len(got) == 1 else np.concatenate(got)[:n]
                ids.append(run)
            yield docs, ids


def _valid_runs(path: str) -> Iterator[np.ndarray]:
    for batch in open_tokens(path):
        ids = batch.column("ids").flatten().to_numpy()
        mask = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        yield ids if mask[-1] else ids[: int(mask.sum())]


def read_token_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files: one task a file."""
    w = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, files.count())
    based = files.select("path", "file_no", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("base")).repartition(n, "file_no").select("path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                for docs, ids in read_documents(path):
                    crc = [zlib.crc32(np.ascontiguousarray(x, dtype="<u4").tobytes()) for x in ids]
                    start = pc.add(docs.column("first"), base)
                    yield pa.record_batch([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_stream(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Encodes and writes ``docs``, reads the files back and returns (doc_id, start, n_tokens, ids_crc32).

    ``folder`` is a folder that driver and executors share; by default the session's checkpoint folder.
    """
    path = vocabulary or vocabulary_path()
    files = write_token_files(docs, folder or checkpoint_root(docs.sparkSession), lambda: worker_encoder(path), end_id, length)
    return read_token_digests(files)
