"""Operators 11 to 13: against brute force, the tokenizers library and SQL, and on odd inputs."""

import binascii
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import byte_pairs, periodic_runs, source_audit
from rankloom.llm.queries import QUERIES, SQL
from tests.llm.test_llm_edges import LONG, ROWS, SCHEMA

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def runs_of(words, least=6, powers=4):
    """All runs by looking at every period: stretches in which words a period apart are equal."""
    found, n = {}, len(words)
    for p in range(1, n // powers + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, powers * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            w = []
            while rng.random() < 0.9 and len(w) < 150:
                base = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 7))]
                w += (base * rng.randint(1, 9))[: rng.randint(1, 40)]
            texts.append(w)
        offsets = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.find_runs(offsets, np.array([x for w in texts for x in w], dtype=np.int64))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in runs_of(w)]


def test_extensions_of_the_grammar():
    rng = random.Random(5)
    for alphabet in (1, 2, 3, 40):
        s = np.array([rng.randrange(alphabet) for _ in range(300)])
        x = np.array(sorted(rng.sample(range(299), 100)))
        y = np.array([rng.randint(a + 1, 299) for a in x])
        g = periodic_runs.Grammar(s)
        forward = [next((k for k in range(300 - b) if s[a + k] != s[b + k]), 300 - b) for a, b in zip(x, y)]
        backward = [next((k for k in range(a) if s[a - 1 - k] != s[b - 1 - k]), a) for a, b in zip(x, y)]
        assert g.extend(x, y, True).tolist() == forward and g.extend(x, y, False).tolist() == backward


def test_long_periodic_texts_in_few_steps():
    n = 200_000
    for words, want in (([7] * n, [[0, 0, n, 1]]), ([1, 2, 3] * (n // 3), [[0, 0, n // 3 * 3, 3]]), (list(range(n)), [])):
        assert periodic_runs.find_runs(np.array([0, len(words)]), np.array(words)).tolist() == want


def test_run_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    some = 0
    for doc, text in docs:
        words = WORD.findall(text or "")
        h, n = binascii.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_of(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        some += len(runs)
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best), doc
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r["collapsed_sha256"] == sha(collapsed(words, runs))
    assert some


def test_runs_on_odd_rows(spark, odd, none):
    rows = odd.unionByName(spark.createDataFrame([(9, "x y\tx y\n x y x y z é é é é é é", "en", "b", 0, 0, 0, 0)], SCHEMA))
    rows = rows.withColumns({"runs": F.lit(1), "words": F.lit("w"), "start": F.lit(2)})
    out = periodic_runs.periodic_runs(rows)
    assert out.columns == [c for c in rows.columns if c != "runs"] + ["runs", "collapsed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) + 1
    assert [tuple(r) for r in got[9]["runs"]] == [(0, 8, 2), (9, 6, 1)] and got[9]["collapsed"] == "x y z é"
    assert got[3]["runs"] == [] and got[3]["collapsed"] == "" and got[5]["collapsed"] == "" and got[4]["collapsed"] == ""
    assert got[6]["collapsed"] == LONG and got[7]["collapsed"] == "short é"
    assert periodic_runs.periodic_runs(none).count() == 0 and periodic_runs.run_digests(none).count() == 0
    digests = periodic_runs.run_digests(odd).collect()
    assert len(digests) == len(ROWS) and all(r["runs_sha256"] and r["collapsed_sha256"] for r in digests)


def test_sorted_pointers():
    rng = random.Random(2)
    for _ in range(100):
        terms = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 24, 30]))) for _ in range(rng.randint(0, 60))]
        data = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
        starts, ends = source_audit.term_pointers(data, np.array([0, len(data)]))
        order, run = source_audit.sort_pointers(data, starts, ends)
        assert order.tolist() == sorted(range(len(terms)), key=lambda i: terms[i])
        sorted_terms = [terms[i] for i in order]
        assert run.tolist() == [len({*sorted_terms[: i + 1]}) - 1 for i in range(len(terms))]


def test_audit_of_random_tables(spark, tmp_path):
    rng, rows = random.Random(11), []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "a" if i % 3 else "c"])
        text = rng.choice([None, "", "12 34", " ".join(rng.choice(["Tree", "tree", "house", "wörter", "ÄRGER", "internationalisation", "x1y", "s" + "t" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 30)))])
        rows.append((i % 350, text, lang, source))
    rows += [(900, "12", "fr", s) for s in "ab"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit("t"), "count": F.lit(1), "rank": F.lit("r")})
    got = sorted(str(tuple(r)) for r in source_audit.divergence(df).collect())
    df.drop("term", "count", "rank").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    q = con.execute(SQL["op12_source_audit"])
    assert got == sorted(map(str, q.fetchall())) and got


def test_audit_on_odd_rows(odd, none):
    assert source_audit.divergence(none).count() == 0
    got = {(r["lang"], r["source"], r["part"], r["item"]): r["value"] for r in source_audit.divergence(odd).collect()}
    assert got == {("en", a, "pair", b): 0 for a in ("a", "b", "") for b in ("a", "b", "") if a != b}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_pairs.vocabulary_path())


def encode(pairs, text):
    return pairs.encode_all([text])[0].tolist()


def decode(pairs, ids):
    return pairs.decode_all(np.array([0, len(ids)]), np.array(ids, dtype=np.int64))[0]


def test_ids_of_every_character(library):
    pairs = byte_pairs.BytePairs(byte_pairs.vocabulary_path())
    texts = [f"a{c}b 1{c}{c}2 {c}!{c}?" for c in map(chr, range(1, 0x3200)) if not 0xD800 <= ord(c) < 0xE000]
    for text, ids, e in zip(texts, pairs.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids, text


def test_ids_of_random_texts(library):
    pairs, rng = byte_pairs.BytePairs(byte_pairs.vocabulary_path()), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'S", "<|endoftext|>", "<|endo", "é", "ß", "中", "😀", "1", "²", " ", " ", "\x00", "\r\n", "\t", "!", "the", "ing", "́"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(pairs, text) == ids and decode(pairs, ids) == library.decode(ids, skip_special_tokens=False)
    for _ in range(200):  # bytes that are no UTF-8
        ids = [rng.randrange(50257) for _ in range(20)]
        assert decode(pairs, ids) == library.decode(ids, skip_special_tokens=False)
    text = "".join(rng.choice("ab") for _ in range(100_000))
    assert encode(pairs, text) == library.encode(text, add_special_tokens=False).ids


def test_token_query_equals_library(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_pairs"](spark, FOLDER).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_tokens_on_odd_rows(spark, odd, none):
    rows = odd.withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    out = byte_pairs.decode_ids(byte_pairs.encode_texts(rows))
    assert out.columns == [*odd.columns, "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(ROWS) and all(r["decoded"] == (r["text"] or "") for r in got)
    assert byte_pairs.encode_texts(none).count() == 0 and byte_pairs.round_trip_digests(none).count() == 0
    some = spark.createDataFrame([(1, None), (2, []), (3, [72, None, 10**6, 50256])], "k int, ids array<int>")
    assert [r["decoded"] for r in byte_pairs.decode_ids(some).orderBy("k").collect()] == [None, "", "i<|endoftext|>"]


def test_pipeline_stages_with_clashing_names(spark, odd):
    from rankloom.llm import jaccard_join, mixing, tiling

    names = ["row_no", "times", "row_hash", "row_hash_again", "contaminated_hash", "text_hash", "row", "n", "component", "_row", "_bad"]
    rows = odd.withColumns({c: F.lit(c) for c in names})
    items = spark.createDataFrame([(5, "one two three four five six seven")], "item_id long, text string")
    for out in (jaccard_join.one_of_each(rows), tiling.without_contaminated(rows, items), mixing.mixed_documents(rows)):
        assert out.columns == rows.columns
        assert all(r[c] == c for r in out.collect() for c in names)
