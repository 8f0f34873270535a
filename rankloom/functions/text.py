"""Text expressions: folding, tokens, phrase counts, markup stripping. All columns stay in the JVM
except entity unescaping, which needs the HTML5 entity table, and what is done on every character or word
of a long text: folding a page and counting its grams."""

import html
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rankloom.functions.folding import fold, folded
from rankloom.functions.wordlists import SLUG_STOPWORDS, TERM_STOPWORDS, KEYWORD_STOPWORDS

TOKEN = r"[\p{L}\p{N}_]+"


def fold_accents(c) -> Column:
    """X10a. The compatibility decomposition without combining marks, in any script."""
    return fold(c)


def ascii_fold(c) -> Column:
    """X10b. As fold_accents, then whatever is still outside ASCII is dropped."""
    return F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")


def slugify(c) -> Column:
    """X07. Folded lower-case name with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_keyword(c) -> Column:
    """X11. Folded, lower, only letters, digits and single spaces."""
    kept = F.regexp_replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def _without(words: Column, stop) -> Column:
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(stop)]))


def content_tokens(norm) -> Column:
    """X11. Distinct words of a normalised keyword without stopwords."""
    return F.array_remove(_without(F.split(norm, " "), KEYWORD_STOPWORDS), "")


def query_terms(query) -> Column:
    """X24. Distinct lower-case words of 3+ letters without stopwords."""
    words = F.split(F.lower(F.trim(query)), r"\s+")
    return F.filter(_without(words, TERM_STOPWORDS), lambda w: F.length(w) >= 3)


def tokenize(text) -> Column:
    """X12. Lower-case Unicode word runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def phrase_count(text_lower, phrase) -> Column:
    """Non-overlapping occurrences of a phrase at word boundaries (Unicode aware), 0 if blank."""
    p = F.lower(F.trim(phrase))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(text_lower, quoted))


def phrase_words(phrase) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != "")))


def density(occurrences, words, total) -> Column:
    """X13. Share of the tokens covered by the phrase, in percent."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(occurrences * words / total * 100.0, 2))


def vocab_diversity(tokens) -> Column:
    """X14. Distinct tokens over tokens."""
    n = F.size(tokens)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_distinct(tokens)) / n, 3))


def let(value, body) -> Column:
    """``body(value)`` with the value computed once a row, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Pages that are Python objects at once.
SLICE_ROWS = 256
_GRAM = StructType([StructField(c, t) for c, t in (("cover", IntegerType()), ("n", IntegerType()), ("cnt", IntegerType()), ("phrase", StringType()))])


def _slices(column: pa.Array):
    for start in range(0, len(column), SLICE_ROWS):
        yield column.slice(start, SLICE_ROWS)


@arrow_udf(StringType())
def fold_text(texts: pa.Array) -> pa.Array:
    """As fold_accents, for whole texts: the characters of a page are folded at once in Python, a text within ASCII stays."""
    return pa.array([t if t is None or t.isascii() else folded(t) for part in _slices(texts) for t in part.to_pylist()], pa.string())


def _best_gram(tokens, min_count: int) -> dict | None:
    """The gram of 2 or 3 words with the greatest (cover, n, cnt, phrase) of those that occur ``min_count`` times and are not numbers only."""
    counts = Counter(tokens)
    edges = {w for w, c in counts.items() if c >= min_count and w is not None and w not in SLUG_STOPWORDS}
    if not edges:
        return None
    two = [f"{a} {b}" for a, b in zip(tokens, tokens[1:]) if a in edges and b in edges]
    three = [f"{a} {m} {b}" for a, m, b in zip(tokens, tokens[1:], tokens[2:]) if a in edges and b in edges and m is not None]
    found = [(c * n, n, c, g) for n, grams in ((2, two), (3, three)) for g, c in Counter(grams).items() if c >= min_count and not g.replace(" ", "").isdecimal()]
    return dict(zip(_GRAM.names, max(found))) if found else None


@lru_cache(maxsize=None)
def _dominant(min_count: int):
    @arrow_udf(_GRAM)
    def best(tokens: pa.Array) -> pa.Array:
        out = [None if t is None else _best_gram(list(t), min_count) for part in _slices(tokens) for t in part.to_pandas()]
        return pa.array(out, pa.struct([("cover", pa.int32()), ("n", pa.int32()), ("cnt", pa.int32()), ("phrase", pa.string())]))

    return best


def dominant_ngram(tokens, min_count: int = 4) -> Column:
    """W06. Most repeated 2- or 3-gram of a folded token array as struct(cover, n, cnt, phrase), or null.

    A page is handled inside its own row: only words that occur ``min_count`` times can begin or end such a gram, and only
    their grams are counted. No exploded gram ever reaches a shuffle.
    """
    return _dominant(min_count)(tokens)


def cut_element(markup, tag: str) -> Column:
    return F.regexp_replace(markup, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")


def without_code(markup) -> Column:
    """Server-side blocks, scripts and styles removed."""
    # fixed value: the pattern decides the result
    no_php = F.regexp_replace(markup, r"(?s)<\?.*?\?>", " ")
    return F.regexp_replace(no_php, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")


def squeeze(text) -> Column:
    # the no-break space of &nbsp; is white space too
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def extract_text(markup) -> Column:
    """X18. Readable text of a page."""
    return squeeze(unescape(F.regexp_replace(without_code(markup), "<[^>]+>", " ")))


def main_content(markup, noisy_sections=(), max_chars: int | None = None) -> Column:
    """X19. Text of the first <main>, else first <article>, else the page without its chrome."""

    def block(tag):
        found = F.regexp_extract(markup, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.when(markup.rlike(rf"(?is)<{tag}[^>]*>.*?</{tag}>"), found)

    bare = markup
    # fixed value: the pattern decides the result
    for tag in ("nav", "header", "footer", "aside"):
        bare = cut_element(bare, tag)
    body = F.coalesce(block("main"), block("article"), bare)
    for tag in ("aside", "nav"):
        body = cut_element(body, tag)
    for tag, css in noisy_sections:
        body = F.regexp_replace(
            body, rf'(?is)<{tag}\b[^>]*\bclass="[^"]*\Q{css}\E[^"]*"[^>]*>.*?</{tag}>', " "
        )
    # fixed value: the pattern decides the result
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = squeeze(unescape(F.regexp_replace(body, "<[^>]+>", " ")))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return F.when(text != "", text)


def model_json(reply) -> Column:
    """X21. The JSON object inside a reply: first { to last }; trailing commas go only if it fails to parse."""
    # fixed value: the pattern decides the result
    body = F.regexp_extract(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    # fixed value: the pattern decides the result
    fixed = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(fixed).isNotNull(), fixed)


def content_hash(model: str, backend: str, label, text) -> Column:
    """X26. Key of a page's stored vector."""
    return F.substring(F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(backend), label, text), 256), 1, 16)
