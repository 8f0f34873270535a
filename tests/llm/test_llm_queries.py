"""The operators' queries against their SQL or a brute-force version, on the smallest tables."""

import binascii
import glob
import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm.queries import QUERIES, SQL
from rankloom.llm.token_stream import vocabulary_path
from tests.llm.brute import components, greedy_tiles, shingles, words

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = con.execute(SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(got.fetchall(), cols)


def test_tiling_equals_brute_force(spark, con):
    docs, items = con.execute("select doc_id, text from documents").fetchall(), con.execute("select item_id, text from benchmark").fetchall()
    want = set()
    for doc, text in docs:
        w = words(text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for item, passage in items:
            p = words(passage)
            if any(tuple(p[i : i + 5]) in grams for i in range(len(p) - 4)) and (n := sum(greedy_tiles(w, p, 5))) * 2 >= len(p):
                want.add((doc, item, n))
    got = {(r["doc_id"], r["item_id"], r["tiled_words"]) for r in QUERIES["op1_greedy_string_tiling"](spark, FOLDER).collect()}
    assert got == want and want


def test_main_text_of_every_page(spark, con):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op5_tag_path_ratios"](spark, FOLDER).collect()}
    pages = con.execute("select page_id, url, html from pages").fetchall()
    assert len(got) == len(pages)
    for page, url, source in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[a-zA-Z/]?[^<>]*$", "", inner))
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts]
        text = "\n".join(p for p in parts if p)
        assert got[page] == (url, text, len(text))


def test_classifier_on_held_out_rows(spark, con):
    got = {r["doc_id"]: r for r in QUERIES["op6_subword_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = con.execute("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    assert all(r["held_out"] == (binascii.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(q, got[d]["predicted"]) for d, q in labels if got[d]["held_out"]]
    good, bad = [p for q, p in held if q == 1], [p for q, p in held if q == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.5


def test_token_files_equal_whole_texts(spark, con):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    want, at = [], 0
    for doc, text in con.execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = QUERIES["op7_token_stream"](spark, FOLDER).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


def test_pipeline_stages(spark, con):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept.append(corpus_pipeline.cut(stage(spark, kept[-1], FOLDER)))
        assert kept[-1].columns == docs.columns
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept]
    good = {d for d, q in con.execute("select doc_id, quality from labels").fetchall() if q == 1}
    assert len(good & rows[1].keys()) >= 0.95 * len(good) and rows[1].keys() <= rows[0].keys()
    # one document of every group of near copies
    group = components({d: shingles(r["text"]) for d, r in rows[1].items()})
    assert rows[2].keys() == {d for d in rows[1] if group[d] == d}
    bench = [words(t) for (t,) in con.execute("select text from benchmark").fetchall()]
    leaks = {d for d, r in rows[2].items() if any(2 * sum(greedy_tiles(words(r["text"]), p, 5)) >= len(p) for p in bench)}
    assert rows[3].keys() == rows[2].keys() - leaks
    # sources near their targets; a document up to three times
    n = {d: len((r["text"] or "").split()) for d, r in rows[3].items()}
    times = {}
    for r in kept[4].collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    total, largest = sum(n.values()), max(n.values())
    assert total - largest <= sum(n[d] * k for d, k in times.items()) <= total
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d for d, k in times.items() for _ in range(k))
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
