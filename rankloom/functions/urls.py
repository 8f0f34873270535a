"""URL expressions. Regexes rather than ``parse_url``, which rejects URLs with spaces.

Each expression mentions its input as few times as it can: a column expression is a tree, and nesting
expressions that repeat their input multiplies its size.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import ascii_fold, fold_accents
from rankloom.functions.wordlists import SLUG_STOPWORDS

_SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def host(url) -> Column:
    return F.regexp_extract(url, rf"^{_SCHEME}//([^/?#]*)", 1)


def bare_host(url) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def path(url) -> Column:
    raw = F.regexp_extract(url, rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query_string(url) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def marked_query(url) -> Column:
    """The query string with its question mark, blank without one."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)


def no_trailing_slash(c) -> Column:
    return F.rtrim(c, F.lit("/"))


def or_root(c) -> Column:
    return F.regexp_replace(c, "^$", "/")


def percent_decode(c, of) -> Column:
    """``c``, a part of the URL ``of``, without percent escapes; as it is when an escape is broken."""
    decoded = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return F.when(F.contains(of, F.lit("%")), decoded).otherwise(c)


def normalize_domain(site) -> Column:
    """X01."""
    return F.regexp_replace(F.regexp_replace(site, r"^(sc-domain:|https?://)", ""), "/+$", "")


def site_url(domain) -> Column:
    """X02."""
    return (
        F.when(domain.startswith("sc-domain:"), domain)
        .when(domain.rlike("^https?://"), F.concat(F.regexp_replace(domain, "/+$", ""), F.lit("/")))
        .otherwise(F.concat(F.lit("https://"), F.regexp_replace(domain, "/+$", ""), F.lit("/")))
    )


def match_key(url) -> Column:
    """X03. Key under which two spellings of one page meet; the query string stays."""
    u = F.trim(url)
    return F.concat(bare_host(u), or_root(no_trailing_slash(percent_decode(path(u), url))), marked_query(u))


def path_or_root(url) -> Column:
    return or_root(path(url))


def url_path_query(url) -> Column:
    """X04."""
    return F.concat(path_or_root(url), marked_query(url))


def is_home(url) -> Column:
    """X05."""
    return no_trailing_slash(path(url)) == ""


def root_of(url) -> Column:
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    h = host(url)
    return F.when((scheme != "") & (h != ""), F.concat(F.lower(scheme), F.lit("://"), h, F.lit("/")))


def brand_compact(url) -> Column:
    """X06. First host label with accents and punctuation removed."""
    return F.regexp_replace(fold_accents(F.element_at(F.split(bare_host(url), r"\."), 1)), "[^a-z0-9]", "")


def is_brand_query(query, brand) -> Column:
    """X06. Null-safe: a site without brand has no brand queries."""
    q = F.regexp_replace(fold_accents(F.lower(query)), "[^a-z0-9]", "")
    hit = (F.length(brand) >= 4) & (F.length(q) >= 4) & (F.contains(brand, q) | F.contains(q, brand))
    return F.coalesce(hit, F.lit(False))


def slug_words(url) -> Column:
    """X07. Words of the last path segment without stopwords and bare numbers."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    slug = F.regexp_replace(
        percent_decode(F.try_element_at(segments, F.lit(-1)), url), r"(?i)\.(x?html?|php|aspx?|jsp)$", ""
    )
    stop = F.array(*[F.lit(w) for w in sorted(SLUG_STOPWORDS)])
    return F.filter(
        F.split(F.lower(slug), "[-_]+"),
        lambda w: (w != "") & ~F.array_contains(stop, w) & ~w.rlike(r"^\p{Nd}+$"),
    )


def slug_phrase(url) -> Column:
    """X07. The slug as a phrase, null when nothing useful is left."""
    words = slug_words(url)
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def slug_from_url(url) -> Column:
    """X08. Folded last path segment; query and extension stay."""
    # fixed value: the pattern decides the result
    p = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://[^/]+", ""), "^/+|/+$", "")
    seg = F.when(p == "", F.lit("index")).otherwise(F.element_at(F.split(p, "/"), -1))
    return F.lower(ascii_fold(seg))


def href_slug(href) -> Column:
    """X09. Slug of the page a link points to; null for what is not a page."""
    h = F.trim(href)
    # fixed value: the pattern decides the result
    cut = F.regexp_replace(F.regexp_replace(h, "(?s)#.*$", ""), r"(?s)\?.*$", "")
    cut = F.regexp_replace(F.regexp_replace(cut, r"(?i)^[a-z][a-z0-9+.\-]*://[^/]+", ""), "^/+|/+$", "")
    seg = F.lower(F.regexp_replace(F.element_at(F.split(cut, "/"), -1), r"(?i)\.(php\d?|html?|aspx?|jsp|cgi)$", ""))
    not_a_page = F.coalesce(h, F.lit("")).rlike(r"(?i)^(mailto:|tel:|javascript:|data:|#|//|$)")
    return F.when(~not_a_page & (cut != "") & (seg != ""), seg)


def brand_from_domain(domain) -> Column:
    """X23."""
    label = F.element_at(F.split(F.regexp_replace(F.regexp_replace(domain, r"^www\.", ""), "^sc-domain:", ""), r"\."), 1)
    return F.initcap(F.translate(label, "-_", "  "))


def plausible_entity(brand, name, entity_url, domain) -> Column:
    """X23. Whether a looked-up entity can be the site's brand."""
    b = F.translate(F.lower(brand), " -", "")
    n = F.translate(F.lower(name), " -", "")
    ratio = F.least(F.length(b), F.length(n)) / F.greatest(F.length(b), F.length(n))
    close = (F.contains(n, b) | F.contains(b, n)) & (ratio >= F.when(F.length(b) <= 4, 0.9).otherwise(0.7))
    first_label = F.element_at(F.split(bare_host(entity_url), r"\."), 1)
    own_label = F.element_at(F.split(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\."), 1)
    same_host = (F.coalesce(entity_url, F.lit("")) != "") & (first_label == own_label)
    return F.coalesce((b == n) | close | same_host, F.lit(False))


def partition_name(site) -> Column:
    """K10. Folder-safe site name."""
    return F.regexp_replace(site, r"[^\p{L}\p{N}_\-.]", "_")
