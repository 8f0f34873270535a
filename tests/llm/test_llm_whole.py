"""Whole jobs: cases that earlier versions of the operators cut short."""

import glob
import math
import os
import random
import time

import duckdb
from pyspark.sql import functions as F

from rankloom.llm import jaccard_join, line_dedup, sql, tag_paths, tiling
from rankloom.llm.queries import QUERIES
from tests.llm.brute import components, shingles

FOLDER = "/root/testdata/sf0.001"


def test_short_lines_are_deduplicated(spark):
    rows = [
        (1, "Les.\none two three four\n\nLes."), (2, "Les.\none two three four five\n\nother words here"), (3, "four THREE two one\none two three five\na b c"),
        (4, "a b\nb a\na b c"), (None, "only here"), (5, " \n\n ")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (4, 1, "Les.\none two three four\n")
    # four of five words are 4/5: the later line goes, three of five do not link
    assert got[2] == (4, 2, "\nother words here")
    # the set of "one two three five" is linked with that of document 2, which comes first
    assert got[3] == (3, 2, "a b c")
    assert got[4] == (3, 2, "a b") and got[None] == (1, 0, "only here") and got[5] == (3, 0, " \n\n ")


def test_line_dedup_of_every_document(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/documents.parquet"):
        con.execute(f"create view documents as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    got = con.execute(sql.OP4)
    cols = [d[0] for d in got.description]
    assert sorted(got.fetchall()) == sorted(tuple(r[c] for c in cols) for r in QUERIES["op4_line_dedup"](spark, FOLDER).collect())


def test_line_dedup_of_similar_groups(spark):
    """Random lines of few words, groups of near-equal lines, clashing names: a line goes when an equal or similar one comes earlier."""
    rng = random.Random(4)
    docs = []
    for d in range(120):
        lines = [" ".join(f"w{rng.randint(0, 14)}" for _ in range(rng.randint(0, 12))) for _ in range(4)]
        near = [f"common{i}" for i in range(12)]
        near[rng.randint(0, 11)] = f"own{d}"
        docs.append((d, "\n".join([*lines, " ".join(near)]), d))
    docs.append((7, docs[7][1], 7))
    want, seen = {}, []
    for d, text, _ in docs[:120]:
        kept = []
        for line in text.split("\n"):
            s = frozenset(line.split())
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            seen.append(s)
        want[d] = "\n".join(kept)
    df = spark.createDataFrame(docs, "doc_id long, text string, _gone long").withColumns({c: F.col("_gone") for c in ("_place", "_hash", "d", "t", "l", "key")})
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == 121 and all(r["text"] == want[r["doc_id"]] and r["_gone"] == r["key"] == r["doc_id"] for r in rows)


PARAGRAPH = "A sentence of the article, with a comma and an end. " * 6


def test_names_do_not_put_the_article_out():
    body = f"<h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    text = "\n".join(["Title", PARAGRAPH.strip(), PARAGRAPH.strip()])
    aside = "<div class='sidebar'><p>Aside text, short.</p></div>"
    for page in (
        f"<article class='post category-notices tag-social'>{body}</article>{aside}", f"<article class='promotion'>{body}</article>{aside}",
        f"<div class='layout no-sidebar'>{body}</div>{aside}", f"<div class='widget'><div class='x sidebar'><article>{body}</article></div></div>{aside}",
        f"<div id=page class='with-sidebar has-comments'>{body}</div>{aside}", f"<div class='search-result'>{body}</div>{aside}", f"<div class='content related'>{body}</div>{aside}"):
        assert tag_paths.main_text(page) == text, page
    results = "".join(f"<div class='search'><p>{PARAGRAPH}{i}</p></div>" for i in range(9))
    assert tag_paths.main_text(results + aside).count("\n") == 8
    # names still put out what they name
    for junk in ("<div class='comments'><p>Nice, really.</p></div>", "<section class='reader-comments'><p>Nice, really.</p></section>", "<div class='comments'><article class='comment'><p>Nice, really.</p></article></div>", "<div class='share-buttons'><p><a href=x>Share it</a></p></div>"):
        assert tag_paths.main_text(f"<article>{body}{junk}</article>") == text, junk


def test_pages_without_article_keep_all_blocks():
    long = [f"Paragraph {i}: {PARAGRAPH}".strip() for i in range(8)]
    p = "".join(f"<p>{x}</p>" for x in long[:5])
    menu = "<div><ul>" + "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(9)) + "</ul></div>"
    items = [f"List item number {i:03d}" for i in range(8)]
    ul = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    end = "".join(f"<p>{x}</p>" for x in long[5:7])
    assert tag_paths.main_text(f"<body>{menu}<div><h1>A title</h1>{p}{ul}{end}</div></body>") == "\n".join(["A title", *long[:5], *items, *long[5:7]])
    cells = [f"c{i}" for i in range(12)]
    rows = "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(cells[::2], cells[1::2])) + "</table>"
    assert tag_paths.main_text(f"<body>{menu}<div>{p}{rows}</div>{menu}</body>") == "\n".join([*long[:5], *cells])
    assert tag_paths.main_text(f"<body><div>{p}<pre>x = 1</pre><pre>y</pre><pre>z</pre><pre>u</pre></div></body>") == "\n".join([*long[:5], "x = 1", "y", "z", "u"])
    # a lead beside the body, whose links make neither it nor the body a menu
    lead = "<div><p>A short lead of the text, before it.</p></div>"
    assert tag_paths.main_text(f"<body>{menu}{lead}<div>{p}</div></body>") == "\n".join(["A short lead of the text, before it.", *long[:5]])
    assert tag_paths.main_text(f"<body>{menu}<div>{p}{ul}</div></body>") == "\n".join([*long[:5], *items])
    # a page of links only keeps them
    assert tag_paths.main_text("<div><p><a href=x>All of it, in one link.</a></p></div>") == "All of it, in one link."


def test_sibling_articles_are_kept():
    one, two = f"First. {PARAGRAPH}{PARAGRAPH}".strip(), f"Second. {PARAGRAPH}".strip()
    teaser = "<div><article><p>A teaser elsewhere, with a mark.</p></article></div><article><p><a href=x>Only a link</a></p></article>"
    page = f"<body><main><article><p>{one}</p></article><article><p>{two}</p></article>{teaser}</main></body>"
    assert tag_paths.main_text(page) == f"{one}\n{two}"


DOCS = "doc_id long, text string, source string"


def test_contaminated_rows_go_by_their_text(spark):
    item = "one two three four five six seven eight"
    rows = [(None, f"x {item} y", "a"), (None, "a clean text of some words", "a"), (None, None, "a"), (7, item, "b"), (7, "another clean text of some words", "b"), (8, "", "b"), (9, item, "b")]
    left = tiling.without_contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "source"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_one_row_of_each_component(spark):
    def text(name, n=12):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        (3, text("a"), "x"), (5, text("a"), "x"), (5, text("b"), "x"),  # a copy of a smaller id, and a text of its own
        (6, text("c"), "x"), (6, text("d"), "x"), (6, text("d"), "x"),  # different texts of one id, one of them twice
        (7, text("e", 40) + " z", "x"), (7, text("e", 40), "x"),  # near copies of one id: the first by text
        (None, text("f"), "x"), (None, text("f"), "x"), (None, text("g"), "x"), (8, "", "x"), (8, "", "x"), (9, None, "x"), (None, None, "x")]
    out = jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "source"]
    want = [rows[i] for i in (0, 2, 3, 4, 7, 8, 10, 11, 12, 13, 14)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_one_row_of_each_component_of_random_rows(spark):
    rng, rows = random.Random(3), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(rng.choice((1, 4, 30, 60)))]
        for _ in range(rng.randint(1, 5)):
            copy = base + [f"n{rng.randint(0, 2)}"] * (len(base) > 20 and rng.random() < 0.6)
            rows += [(rng.randint(1, 25), " ".join(copy), "x")] * rng.choice((1, 1, 2))
    component = components({i: shingles(t) for i, (_, t, _) in enumerate(rows)})
    least = {}
    for i, r in enumerate(rows):
        c = component[i]
        least[c] = min(least.get(c, r), r)
    assert sorted(map(tuple, jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS)).collect())) == sorted(least.values())


def _article(inside="", outside=""):
    body = f"<h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    return f"<body><article>{body}{inside}</article>{outside}</body>", "\n".join(["Title", *[PARAGRAPH.strip()] * 3])


def test_a_teaser_article_does_not_win():
    body = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(5))
    want = "\n".join([PARAGRAPH.strip()] * 5)
    for teaser in ("<article><h2>Other</h2><p>Read on, please.</p></article>", "<article><p>A teaser, of one sentence.</p></article>"):
        assert tag_paths.main_text(f"<body><div>{body}</div>{teaser}</body>") == want
        assert tag_paths.main_text(f"<body>{teaser}<div>{body}</div></body>") == want
        assert tag_paths.main_text(f"<body><article>{body}</article>{teaser}</body>").startswith(want)


def test_boxes_in_and_beside_an_article():
    said = "<p>What a good text, thank you.</p><p>I do not agree, sorry.</p>"
    for junk in (
        "<div class='comments-area'>{}</div>", "<ol class='comment-list'><li>{}</li></ol>", "<div id=disqus_thread>{}</div>", "<section><h2>Comments</h2>{}</section>", "<section><h3>3 comments</h3>{}</section>",
        "<div><div><h2>Leave a reply</h2></div>{}</div>", "<div class='ad-slot'>{}</div>", "<div class='ad-container'>{}</div>", "<div class='cookie-bar'>{}</div>",
        "<div class='newsletter-box'>{}</div>", "<div class='sidebar-left'>{}</div>", "<div class='widget-area'>{}</div>", "<div class='footer-bottom'>{}</div>", "<div class=social><p>Follow us</p></div>"):
        for page, want in (_article(junk.format(said)), _article("", junk.format(said))):
            assert tag_paths.main_text(page) == want, junk
    page, want = _article("<article><p>A comment.</p></article><div><article><p>And another, longer one.</p></article></div>")
    assert tag_paths.main_text(page) == want


def test_sections_about_tools_stay():
    for part in ("<section id=search>{}</section>", "<section id=pagination>{}</section>", "<div class=social>{}</div>"):
        page, want = _article(part.format(f"<p>{PARAGRAPH}</p>"))
        assert tag_paths.main_text(page) == want + "\n" + PARAGRAPH.strip()


def test_deep_pages_in_linear_time():
    for page, lines in (("<div>word " * 100_000, 100_000), ("<li><ul>" + "<div><li>x</li>" * 40_000, 40_000), ("<h1>a " * 50_000, 50_000), ("<article>x <p>" * 50_000, None)):
        start = time.time()
        text = tag_paths.main_text(page)
        assert time.time() - start < 20 and (lines is None or text.count("\n") == lines - 1)


def test_block_values_by_hand():
    """The ratio rule path by path, block by block."""
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 30)
        paths, sizes = [rng.randint(0, 4) for _ in range(n)], [rng.randint(1, 300) for _ in range(n)]
        marks, linked = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, s) for s in sizes]
        own = []
        for p in paths:
            at = [i for i in range(n) if paths[i] == p]
            chars = sum(sizes[i] for i in at)
            own.append(chars / len(at) * (1 + sum(marks[i] for i in at) / len(at)) * (1 - sum(linked[i] for i in at) / chars))
        bell = [math.exp(-k * k / 2) for k in range(-2, 3)]
        for i, value in enumerate(tag_paths.block_values(paths, sizes, marks, linked)):
            near = sum(w * own[min(n - 1, max(0, i + k))] for w, k in zip(bell, range(-2, 3))) / sum(bell)
            assert abs(value - (own[i] + near) / 2) < 1e-6 * (1 + abs(value))
