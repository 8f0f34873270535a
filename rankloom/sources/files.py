"""Pages, lists and exports read as text files. Readers give (path, value) rows; the rest are plain DataFrame steps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import extract_text, slugify
from rankloom.functions.urls import bare_host, match_key, slug_from_url

PAGE_FILES = r"(?i)\.(php|html|htm)$"


def read_whole(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value): lines with their number inside each file. Files are small and edited by hand."""
    return read_whole(spark, path).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))


def read_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value): lines of exports of any size, whose files are split; ``n`` orders the lines of a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), at.alias("n"), "value")


def folder_sources(files: DataFrame, site: str, exclude: DataFrame | None = None) -> DataFrame:
    """S08. (site, page, markup) of page files; the page is the file's stem. Short pages stay: they still link."""
    name = F.element_at(F.split("path", "/"), -1)
    pages = files.filter(name.rlike(PAGE_FILES)).select(
        F.lit(site).alias("site"), F.regexp_replace(name, r"\.[^.]*$", "").alias("page"), F.col("value").alias("markup")
    )
    return pages if exclude is None else pages.join(exclude.select("page"), "page", "left_anti").select("site", "page", "markup")


def folder_pages(sources: DataFrame, min_chars: int = 300) -> DataFrame:
    """S07. (site, page, text) of the sources with enough text."""
    return sources.select("site", "page", extract_text(F.col("markup")).alias("text")).filter(F.length("text") >= min_chars)


def listed_names(settings: DataFrame, lists=("palavras_chave", "blog")) -> DataFrame:
    """S09. (site, list_no, pos, name): quoted names of the named arrays in a site settings text."""
    rows = []
    for i, name in enumerate(lists):
        body = F.regexp_extract("value", rf"(?s)\${name}\s*=\s*array\((.*?)\n\);", 1)
        rows.append(settings.select("site", F.lit(i).alias("list_no"), F.posexplode(F.regexp_extract_all(body, F.lit('"([^"]*)"'), F.lit(1))).alias("pos", "name")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def listed_pages(names: DataFrame, pages: DataFrame) -> DataFrame:
    """S09. Listed pages that exist, each at its first place in the lists."""
    slugs = names.select("site", slugify(F.col("name")).alias("page"), F.struct("list_no", "pos").alias("at"))
    first = slugs.groupBy("site", "page").agg(F.min("at").alias("at"))
    return first.join(pages, ["site", "page"]).select(*pages.columns, F.col("at.list_no").alias("list_no"), F.col("at.pos").alias("pos"))


def site_list(lines: DataFrame) -> DataFrame:
    """S10. One site per line, comments and blanks dropped. An empty list is for the caller to refuse."""
    return lines.select("n", F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("site")).filter(F.col("site") != "")


def require_sites(sites: DataFrame) -> DataFrame:
    if sites.isEmpty():
        raise ValueError("no site in the list")
    return sites


def export_urls(lines: DataFrame) -> DataFrame:
    """S11. URLs of a site's own host in exported text lines (site, n, value), once per match key."""
    # fixed value: the pattern decides the result
    found = lines.select("site", "n", F.posexplode(F.regexp_extract_all("value", F.lit(r"https?://[^\s\"'<>,;]+"), F.lit(0))).alias("k", "url"))
    own = F.regexp_replace(F.regexp_replace(F.lower("site"), r"^(sc-domain:)?(www\.)?", ""), "/+$", "")
    return found.filter(bare_host(F.col("url")) == own).groupBy("site", match_key(F.col("url")).alias("match_key")).agg(
        F.min(F.struct("n", "k", "url")).alias("f")
    ).select("site", F.col("f.url").alias("url"), F.struct("f.n", "f.k").alias("pos"))


def snapshot_metrics(reports: DataFrame) -> DataFrame:
    """S13. Newest report of each site (site, path, pos, url, ...metrics), one row per slug; its last row wins."""
    day = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})_posicao\.json$", 1)
    dated = reports.withColumn("day", day).filter(F.col("day") != "")
    newest = dated.groupBy("site").agg(F.max("day").alias("day"))
    rows = dated.join(newest, ["site", "day"]).withColumn("page", slug_from_url(F.col("url")))
    return rows.groupBy("site", "page").agg(
        F.max_by(F.struct("url", "clicks", "impressions", "position", "ctr", "has_data"), "pos").alias("m")
    ).select("site", "page", "m.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of position reports ``YYYY-MM-DD_posicao.json``, with their place in the file."""
    schema = "site string, urls array<struct<url:string,position:double,clicks:long,impressions:long,ctr:double,has_data:boolean>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return docs.select("site", F.col("_metadata.file_path").alias("path"), F.posexplode("urls").alias("pos", "u")).select("site", "path", "pos", "u.*")
