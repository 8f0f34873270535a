"""Odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; random inputs against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import host_rules, jaccard_join, line_dedup, mixing, preferences, quality, sharding, tag_paths, tiling, token_stream
from tests.llm.brute import components, greedy_tiles, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size long, row_id long"
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven", "en", "a", 5, 1, 1, 1),
    (2, "one Two three four five six seven", "en", "a", 5, 1, 1, 1),
    (2, "one Two three four five six seven", "en", "a", 5, 1, 1, 1),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 0, 0, 0),
    (5, " \t\n ", "en", "b", 0, 0, 0, 0),
    (6, LONG, "en", "b", 0, 0, 0, 0),
    (None, "one two three four five six seven", "en", None, 0, 0, 0, 0),
    (7, "short é", "fr", "é", 0, 0, 0, 0),
    (8, "the very same long line of words here\nthe very same long line of words here\nx", "en", "b", 0, 0, 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tiling(spark, odd, none):
    items = spark.createDataFrame([(1, "four five six seven one two three four", "x"), (2, None, "x"), (3, "", "x"), (4, "a b", "x"), (5, "one two three four five six seven", "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["tiled_words"]) for r in tiling.contaminated(odd, items).collect())
    assert got == [(0, 5, 7), (1, 5, 7), (2, 5, 7)]
    assert tiling.contaminated(none, items).count() == 0 and tiling.contaminated(odd, items.limit(0)).count() == 0
    left = tiling.without_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6, 7, 8]


def test_tiles_of_moved_sentences():
    rng = random.Random(1)
    for _ in range(200):
        doc, item = [rng.choice("abc") for _ in range(rng.randint(0, 40))], [rng.choice("abc") for _ in range(rng.randint(0, 15))]
        pairs = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if doc[i : i + 3] == item[j : j + 3]]
        found = tiling.tiles(pairs, 3)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in found)
        assert sorted(t[2] for t in found)[::-1] == sorted(greedy_tiles(doc, item, 3))[::-1] or sum(t[2] for t in found) >= 0.7 * sum(greedy_tiles(doc, item, 3))
        assert len({k for i, _, n in found for k in range(i, i + n)}) == sum(t[2] for t in found)
    # halves swapped: two tiles cover the item
    assert sorted(t[2] for t in tiling.tiles([(i, j) for i in range(6) for j in range(16) if (i < 6 and j == i + 10)] + [(i, i - 10) for i in range(10, 16)])) == [10, 10]


def test_host_rules(odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in host_rules.host_quality_rules(odd).collect()}
    assert got[3, 0]["base_failed"] and got[3, 0]["host"] is None and got[7, 2]["word_chars"] == 6
    r = got[8, 17]
    assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (1, 16, True, False)
    assert host_rules.host_quality_rules(odd).count() == len(ROWS) and host_rules.host_quality_rules(none).count() == 0


def test_hosts_that_stand_out(spark):
    """Of 31 hosts one repeats lines in most documents, one has symbols; one of a single bad document is judged by the others."""
    good, signs = " ".join(f"word{i}" for i in range(40)), " ".join(f"#{i}" for i in range(10))
    rows = [(100 * h + i, f"{good} {h} {i}" + (f"\nmenu {i}" * 3 if i < 2 else ""), f"h{h}") for h in range(28) for i in range(40)]
    rows += [(5000 + i, f"{good} {i}" + (f"\nmenu {i}" * 3 if i < 24 else ""), "lines") for i in range(40)]
    rows += [(6000 + i, f"{good} {i} {signs}", "symbols") for i in range(40)] + [(7000, f"{good}" + "\nmenu" * 3, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in host_rules.host_quality_rules(docs).collect():
        assert not r["base_failed"]
        got.setdefault(r["host"], set()).add(r["kept"])
    assert got.pop("lines") == {False} and got.pop("symbols") == {False}
    assert set(map(frozenset, got.values())) == {frozenset({True})}


def test_components(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(odd).collect()), key=str)
    assert (None, 3, 1) in got and got.count((2, 3, 1)) == 2 and (1, 3, 1) in got and (3, 0, 3) in got and (5, 0, 5) in got and (7, 1, 7) in got
    assert jaccard_join.similar_components(none).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 3, 4, 5, 6, 7, 8]
    twice = jaccard_join.one_of_each(odd.filter("doc_id > 1"))
    assert sorted(r["doc_id"] for r in twice.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_components_of_random_texts(spark):
    rng, rows = random.Random(7), []
    for _ in range(60):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((1, 3, 5, 6, 8, 9, 12, 15, 20, 40, 80, 200)))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5)) * max(1, len(base) // 60)):
                at = rng.randrange(len(copy))
                kind = rng.randrange(3)
                copy[at : at + (kind < 2)] = [] if kind == 0 and len(copy) > 1 else [f"n{rng.randint(0, 99)}"]
            rows.append((len(rows), " ".join(copy)))
    shared = [f"p{i}" for i in range(30)]  # a passage that many texts hold, alone or nearly so
    rows += [(len(rows) + i, " ".join(shared + [f"q{i * 100 + k}" for k in range(rng.randint(0, 9))])) for i in range(60)]
    want = components({d: shingles(t) for d, t in rows})
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup(odd, none):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()}
    assert got[8] == (3, 1, "the very same long line of words here\nx") and got[3] == (0, 0, None) and got[4] == (1, 0, "")
    assert got[None][1] == 0 and got[1] == (1, 1, "") and got[5] == (2, 0, " \t\n ")
    assert line_dedup.dedup_lines(odd).columns == [*odd.columns, "n_lines", "n_removed"] and line_dedup.dedup_lines(none).count() == 0


def test_extraction(spark):
    rows = [
        (1, "u", None, 1), (2, None, "", 1), (3, "u", "no tags at all, just text.", 1), (4, "u", "<p>", 1), (4, "u", "<p>", 1),
        (5, "u", "<body><nav><a href=x>Menu</a></nav><article><header><h1>T &amp; U</h1></header><p>First   one.<p>Second<br>line &lt;x&gt;.</p><form>Name</form>"
                 "<section class='reader-comments'><p>Nice, really nice, thanks.</p></section><aside>See also</aside></article><div id=cookie-notice>We use cookies.</div></body>", 1),
        (6, "u", "<div class=content><p>Long text here, with commas, and more of it.</p><p>Another long text here, with marks, too.</p></div><div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></div>", 1),
        (7, "u", "<article><p>Cut off in the mid<b", 1), (8, "u", "<article>" + "<div>" * 3000 + "deep" + "<p>x." * 3000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r["page_id"]: r["text"] for r in tag_paths.extract(df).collect()}
    assert got[1] == got[2] == got[4] == "" and got[3] == "no tags at all, just text."
    assert got[5] == "T & U\nFirst one.\nSecond line <x>." and got[7] == "Cut off in the mid"
    assert got[6] == "Long text here, with commas, and more of it.\nAnother long text here, with marks, too."
    assert got[8].startswith("deep\nx.") and tag_paths.extract(df.limit(0)).count() == 0 and tag_paths.extract(df).count() == len(rows)


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "x"), (2, 0, 1, "x"), (6, 1, None, "x"), (None, 1, 1, "x"), (7, None, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(none, labels).count() == 0 and quality.classify(odd, labels.limit(0)).count() == len(ROWS)
    assert quality.accepted(odd, labels).columns == odd.columns


def test_token_stream(odd, none, tmp_path):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_stream.token_stream(odd, str(tmp_path)).collect())
    assert got[0][1] is None and [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert {n for _, d, n in got if d in (3, 4, 5)} == {1} and token_stream.token_stream(none, str(tmp_path)).count() == 0


def test_token_file_layout(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the and of " * (i % 50)) for i in range(300)], "doc_id long, text string")
    path = token_stream.vocabulary_path()
    files = token_stream.write_token_files(docs, str(tmp_path), lambda: token_stream.Encoder(path), length=16).orderBy("file_no").collect()
    assert sum(f["n_tokens"] for f in files) == sum(3 * (i % 50) + 1 for i in range(300))
    batch = next(iter(token_stream.open_tokens(files[0]["path"])))
    assert batch.schema.field("ids").type.list_size == 16 and batch.column("mask")[0].as_py() == [True] * 16
    again = token_stream.Encoder(path)
    import pyarrow as pa

    texts = ["The NAÏVE Ως café's 12ab, don't -- ½ ﬁ x　y <|endoftext|> ", None, "", "a,b", "İx ΣΑΣ é"]
    at, ids = again(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [again.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_sequences_without_copies(spark, tmp_path):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, "the and of " * (i % 50)) for i in range(900)], "doc_id long, text string").repartition(1)
    encode = token_stream.Encoder(token_stream.vocabulary_path())
    files = token_stream.write_token_files(docs, str(tmp_path), lambda: token_stream.worker_encoder(token_stream.vocabulary_path()), length=16).orderBy("file_no").collect()
    for f in files:
        held = pa.total_allocated_bytes()
        tokens = token_stream.TokenFile(f["path"])
        got = [tokens.sequence(k) for k in range(len(tokens))]
        assert pa.total_allocated_bytes() == held and all(not ids.flags.owndata for ids, _ in got)
        whole = np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in got])
        want = np.concatenate([ids for _, found in token_stream.read_documents(f["path"]) for ids in found])
        assert len(whole) == f["n_tokens"] and (whole == want).all() and len(tokens) == -(-f["n_tokens"] // 16)
        with pytest.raises(IndexError):
            tokens.sequence(len(tokens))
    assert encode.dtype == np.uint16


def test_one_id_of_a_third_of_the_rows(spark, tmp_path):
    """A null id, with equal and different texts, is cut into several files and slices; reruns over other layouts agree."""
    rows = [(None if i % 3 == 0 else i, f"a b c {i % 50 if i % 6 else 0} " * (1 + i % 4), f"s{i % 3}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    files = token_stream.write_token_files(docs, str(tmp_path), lambda: token_stream.worker_encoder(token_stream.vocabulary_path())).collect()
    assert sum(f["n_docs"] for f in files) == len(rows)
    assert len(files) == 1 or max(f["n_docs"] for f in files) <= 2 * len(rows) / len(files)
    takes = [sorted((str(r["doc_id"]), r["source"], r["size"], r["times"]) for r in mixing.mix(mixing.sized(t)).documents.collect()) for t in (docs, docs.repartition(3, "text"))]
    assert takes[0] == takes[1]


def test_mix(spark, odd, none):
    got = mixing.mix(mixing.sized(odd)).documents.collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) <= sum(r["size"] for r in got)
    assert mixing.mix(mixing.sized(none)).documents.count() == 0
    assert mixing.mix(mixing.sized(odd.filter("doc_id in (3, 4, 5)"))).documents.agg(F.sum("taken")).first()[0] == 0
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 4 if i % 7 else 9}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.sized(docs)
    per = mixing.mix(rows).documents.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 20 for r in per)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns


def test_shards(spark, odd, none):
    got = sharding.assign_shards(odd).collect()
    assert len(got) == len(ROWS) and sharding.assign_shards(none).count() == 0
    docs = spark.createDataFrame([(i % 900, "x" * (i % 5)) for i in range(1000)], "doc_id long, text string")
    rows = sharding.assign_shards(docs, 4, [1, 1, 2, 4]).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots[3]) > len(slots[2]) > len(slots[0])


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi", 1), (0, 1, "assistant", "yes <|im_end|>", 1), (1, 0, "user", "hi", 1), (1, 1, "assistant", "no", 1), (2, 0, "user", None, 1), (4, 1, None, "z", 1), (4, 0, "assistant", "a", 1),
        (5, 0, "assistant", "a", 1), (5, 0, "assistant", "a", 1), (None, 0, "assistant", "q", 1), (None, 0, "user", "q", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt long")
    out = preferences.format_preferences(preferences.sibling_pairs(df)).orderBy("pair_id", F.desc("n_prompt_turns")).collect()
    got = {r["pair_id"]: r for r in out}
    assert set(got) == {0, 1, 2, 4, 5, None} and [r["n_prompt_turns"] for r in out if r["pair_id"] is None] == [1, 0]
    r = got[0]
    assert r["n_prompt_turns"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and r["chosen"] == "<|im_start|>assistant\nyes < |im_end|><|im_end|>\n"
    assert r["rejected"] == "<|im_start|>assistant\nno<|im_end|>\n"
    (s,) = r["chosen_spans"]
    assert r["chosen"][s["start"] : s["end"]] == "yes < |im_end|><|im_end|>"
    assert got[2]["chosen"] == "" and got[2]["n_prompt_turns"] == 1 and got[4]["chosen"] == "" and got[None]["rejected"] == ""
    assert preferences.format_preferences(preferences.sibling_pairs(df.limit(0))).count() == 0
