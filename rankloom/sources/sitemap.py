"""Live URLs from sitemap documents (site, doc_url, seq, xml) and robots.txt texts (site, text)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import unescape


def read_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """S05. (site, doc_url, seq, xml) of landed sitemap files, plain or gzipped: one document a file, below site=<site>/seq=<n>/doc_url=<address>.

    The protocol bounds a document (50,000 entries, 50 MB), so it is one row; files are read in parallel. A broken one is sorted out by ``sitemap_urls``.
    """
    read = spark.read.schema("value string, site string, seq int, doc_url string").text(folder, wholetext=True)
    return read.select("site", "doc_url", "seq", F.col("value").alias("xml"))


def land_sitemaps(docs: DataFrame, folder: str) -> None:
    """Writes documents (site, doc_url, seq, xml) where ``read_sitemaps`` finds them; a site's documents that come again are replaced."""
    docs.select("site", "seq", "doc_url", F.col("xml").alias("value")).write.partitionBy("site", "seq", "doc_url").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").text(folder)


def _locs(docs: DataFrame, root: str, entry: str) -> DataFrame:
    """Addresses of a document's entries in order. Only elements of the root's namespace count, so those of extensions (image:loc) do not;
    a document that is not well-formed as a whole gives none."""
    parsed = F.from_xml("xml", "_broken string, _other string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    tag = rf"<([\w.-]+:)?{root}\b"
    whole = docs.filter(F.col("xml").rlike(tag)).withColumn("broken", parsed["_broken"].isNotNull()).filter("not broken")
    prefix = F.replace(F.regexp_extract("xml", tag, 1), F.lit("."), F.lit("\\."))

    def element(name: str) -> Column:
        return F.concat(F.lit("(?s)<"), prefix, F.lit(rf"{name}\b[^>]*>(.*?)</"), prefix, F.lit(rf"{name}\s*>"))

    inner = F.regexp_extract_all("xml", element(entry), F.lit(1))
    rows = whole.select("site", "doc_url", "seq", element("loc").alias("loc_element"), F.posexplode(inner).alias("n", "entry"))
    loc = F.regexp_replace(F.call_function("regexp_extract", F.col("entry"), F.col("loc_element"), F.lit(1)), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    return rows.select("site", "doc_url", "seq", "n", F.regexp_replace(unescape(loc), r"^\s+|\s+$", "").alias("loc")).filter(F.col("loc") != "")


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """S05. Page URLs of a site's own documents and of the documents its index names, first seen first.

    ``seq`` 0 marks the entry document of a site; others count only when the entry index lists them.
    """
    entry = docs.filter(F.col("seq") == 0)
    children = _locs(entry, "sitemapindex", "sitemap").select("site", F.col("loc").alias("doc_url"), F.col("n").alias("child"))
    direct = _locs(entry, "urlset", "url").select("site", F.lit(0).alias("d"), "n", F.col("loc").alias("url"))
    nested = _locs(docs.filter(F.col("seq") > 0), "urlset", "url").join(children, ["site", "doc_url"]).select(
        "site", F.col("child").alias("d"), "n", F.col("loc").alias("url")
    )
    return first_seen(direct, nested)


def first_seen(*parts: DataFrame) -> DataFrame:
    """U02. Union of (site, d, n, url) lists, each URL once at its first place."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("site", "url").agg(F.min(F.struct("d", "n")).alias("at")).select("site", "url", F.col("at.d").alias("doc"), F.col("at.n").alias("pos"))


def robots_sitemap(robots: DataFrame) -> DataFrame:
    """S06. The first sitemap line of each robots.txt."""
    line = r"(?im)^[ \t]*sitemap:[ \t]*(.*?)[ \t\r]*$"
    return robots.filter(F.col("text").rlike(line)).select("site", F.regexp_extract("text", line, 1).alias("sitemap_url"))


def ordered(urls: DataFrame) -> DataFrame:
    """URLs with one running position, for callers that need list order; positions are unique, not dense."""
    return urls.select("site", "url", (F.col("doc").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("pos"))

