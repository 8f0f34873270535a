"""Search tables derived from star-schema tables, so that every operator runs on given data.

lineitem stands for the search log (a part is a query, a supplier a page), supplier for the sitemap,
events for daily counts, documents for page texts, pages for markup.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import slugify


class Derived:
    """Lazy derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder, {}

    def once(self, name: str, make):
        """A frame that several parts of one query share."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def site_of(k):
        return F.concat(F.lit("s"), F.pmod(k, F.lit(5)))

    @staticmethod
    def slug_of(k):
        return F.concat(F.lit("produto-a"), F.pmod(k, F.lit(7)), F.lit("-b"), F.pmod(k, F.lit(11)), F.lit("-"), k)

    @classmethod
    def url_of(cls, k):
        return F.concat(F.lit("https://www."), cls.site_of(k), F.lit(".example/"), cls.slug_of(k))

    def _metrics(self, *keys) -> DataFrame:
        q, line, part = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")
        place = 1 + (line - 1) * 5 + F.pmod(part, F.lit(4)) * 8
        clicks = F.sum(F.when((F.col("l_returnflag") == "R") & (line == 1), q))
        agg = self.table("lineitem").groupBy("l_suppkey", *keys).agg(
            F.coalesce(clicks, F.lit(0.0)).cast("long").alias("clicks"), F.sum(q).cast("long").alias("impressions"),
            F.round(F.sum(q * place) / F.sum(q), 1).alias("position"),
        )
        k = F.col("l_suppkey")
        return agg.withColumn("site", self.site_of(k)).withColumn("url", self.url_of(k))

    def query_page(self) -> DataFrame:
        t = self._metrics("l_partkey")
        return t.select(
            "site", F.concat(F.lit("kw "), F.col("l_partkey")).alias("query"), "url", "clicks", "impressions",
            F.round(100.0 * F.col("clicks") / F.col("impressions"), 2).alias("ctr"), "position",
        )

    def page_metrics(self) -> DataFrame:
        # a page is a supplier: the log is added up by its number, names are made for pages only
        tenths, k = F.round(F.col("position") * 10).cast("long") * F.col("impressions"), F.col("l_suppkey")
        return self._metrics("l_partkey").groupBy(k).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(tenths).alias("t")).select(
            self.site_of(k).alias("site"), self.url_of(k).alias("url"), "clicks", "impressions", F.round(100.0 * F.col("clicks") / F.col("impressions"), 2).alias("ctr"),
            F.round(F.col("t") / F.col("impressions") / 10.0, 1).alias("position"),
        )

    def landing_pages(self) -> DataFrame:
        """The log as the service delivers it: ctr as a fraction, unrounded position."""
        return self.page_metrics().select(
            "site", "url", F.col("clicks").cast("double").alias("clicks"), F.col("impressions").cast("double").alias("impressions"),
            (F.col("clicks") / F.col("impressions")).alias("ctr"), (F.col("position") + 0.03).alias("position"),
        )

    def landing_queries(self) -> DataFrame:
        return self.query_page().select(
            "site", "query", "url", F.col("clicks").cast("double").alias("clicks"), F.col("impressions").cast("double").alias("impressions"),
            (F.col("clicks") / F.col("impressions")).alias("ctr"), (F.col("position") + 0.03).alias("position"),
        )

    def sitemap(self) -> DataFrame:
        """Suppliers in credit are live pages, in four spellings; plus homes and pages nobody has searched."""
        k = F.col("s_suppkey")
        host = F.concat(self.site_of(k), F.lit(".example/"))
        slug = self.slug_of(k)
        spelled = (
            F.when(F.pmod(k, F.lit(4)) == 2, F.concat(F.lit("http://"), host, slug, F.lit("/")))
            .when(F.pmod(k, F.lit(4)) == 3, F.concat(F.lit("https://"), host, F.replace(slug, F.lit("-b"), F.lit("%2Db"))))
            .otherwise(self.url_of(k))
        )
        live = self.table("supplier").filter(F.col("s_acctbal") >= 0).select(self.site_of(k).alias("site"), spelled.alias("url"), (k + 1).alias("pos"))
        r, n = F.col("r_regionkey"), F.col("n_nationkey")
        homes = self.table("region").select(
            self.site_of(r).alias("site"), F.concat(F.lit("https://www."), self.site_of(r), F.lit(".example/")).alias("url"), F.lit(0).cast("long").alias("pos")
        )
        unseen = self.table("nation").select(
            self.site_of(n).alias("site"), F.concat(F.lit("https://www."), self.site_of(n), F.lit(".example/guia-"), F.lower("n_name")).alias("url"),
            (n + 1_000_000_000).cast("long").alias("pos"),
        )
        return live.unionByName(homes).unionByName(unseen)

    def position_rows(self) -> DataFrame:
        from rankloom.operators.ranking import position_rows

        return position_rows(self.sitemap(), self.page_metrics())

    def exports(self) -> DataFrame:
        """Export lines of the indexing report: two URLs a line, some of them other hosts' or known ones."""
        k = F.col("c_custkey")
        own = F.concat(F.lit("https://www."), self.site_of(k), F.lit(".example/antigo-"), F.pmod(k, F.lit(97)))
        return self.table("customer").select(
            self.site_of(k).alias("site_name"), k.alias("n"),
            F.concat(own, F.when(F.pmod(k, F.lit(3)) == 0, "/").otherwise(""), F.lit(", 2024-01-01; http://outro.example/x <"), self.url_of(k), F.lit(">")).alias("value"),
        ).select(F.concat("site_name", F.lit(".example")).alias("site"), "n", "value")

    def export_list(self) -> DataFrame:
        from rankloom.sources.files import export_urls

        return export_urls(self.exports()).select(F.regexp_replace("site", r"\.example$", "").alias("site"), "url", "pos")

    def inspections(self) -> DataFrame:
        k = F.col("o_orderkey")
        verdict = (
            F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL")
            .when(F.pmod(k, F.lit(3)) == 0, "NEUTRAL").when(F.pmod(k, F.lit(3)) == 1, "VERDICT_UNSPECIFIED").otherwise("PARTIAL")
        )
        from rankloom.functions.scoring import verdict_category

        return self.table("orders").select(
            self.site_of(F.col("o_custkey")).alias("site"), F.concat(self.url_of(F.col("o_custkey")), F.lit("/"), k).alias("url"),
            F.to_date("o_orderdate").alias("date"), verdict.alias("verdict"), F.col("o_orderpriority").alias("coverage_state"),
            F.col("o_orderdate").alias("last_crawl"),
        ).withColumn("category", verdict_category(F.col("verdict")))

    def stored_results(self) -> DataFrame:
        """Stored inspection results of pages: a page's own latest event is the time it was stored."""
        u = F.col("user_id")
        return self.table("events").select(
            self.site_of(u).alias("site"), self.url_of(u).alias("url"), F.col("ts").alias("cached_at"), (F.col("event_type") == "error").alias("failed")
        )

    def site_daily(self) -> DataFrame:
        return self._daily("site", "date")

    def query_daily(self) -> DataFrame:
        return self._daily("site", "date", "query")

    def _daily(self, *keys) -> DataFrame:
        e = self.table("events").filter(F.col("event_type").isin("view", "click")).select(
            self.site_of(F.col("user_id")).alias("site"), F.to_date("ts").alias("date"),
            F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("query"), "event_type",
        )
        return e.groupBy(*keys).agg(
            F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("impressions")
        )

    def history(self) -> DataFrame:
        """Monthly snapshots; well-seen pages carry a content result."""
        t = self._metrics(F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"))
        words = F.col("impressions") * 3
        density = F.round(F.col("clicks") * 20.0 / F.col("impressions"), 2)
        verdict = F.when(words < 180, "raso").when(density >= 5, "over_otimizado").when(density >= 3, "atencao").otherwise("ok")
        content = F.struct(
            verdict.alias("verdict"), density.alias("density"), words.alias("words"), F.lit(None).cast("double").alias("diversity"), F.lit(None).cast("long").alias("entities")
        )
        return t.select("site", "date", "url", "position", "clicks", "impressions", F.when(F.col("impressions") >= 40, content).alias("content"))

    def texts(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(self.site_of(d).alias("site"), self.url_of(d).alias("url"), self.slug_of(d).alias("page"), "text")

    def entities_raw(self) -> DataFrame:
        """Capitalised words stand for entities, their share of all such words for the salience."""
        words = self.texts().select("site", "url", F.regexp_extract_all("text", F.lit(r"\p{Lu}[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
        rows = words.select("site", "url", F.size("w").alias("total"), F.posexplode("w").alias("pos", "name")).groupBy("site", "url", "total", "name").agg(
            F.count("*").alias("n"), F.min("pos").alias("pos")
        )
        kind = F.element_at(
            F.array(*[F.lit(t) for t in ("PERSON", "LOCATION", "ORGANIZATION", "OTHER", "NUMBER", "CONSUMER_GOOD")]), F.pmod(F.length("name"), F.lit(6)) + 1
        )
        return rows.select("site", "url", "name", kind.alias("type"), (F.col("n") / F.col("total")).alias("salience"), "pos")

    def categories_raw(self) -> DataFrame:
        d = F.col("doc_id")
        names = F.array_compact(F.array(
            F.when(F.col("quality") == 1, F.struct(F.lit("/Boa").alias("name"), F.lit(0.9).alias("confidence"))),
            F.when(F.col("toxic") == 1, F.struct(F.lit("/Toxica").alias("name"), F.lit(0.6).alias("confidence"))),
        ))
        return self.table("labels").select(self.site_of(d).alias("site"), self.url_of(d).alias("url"), F.explode(names).alias("c")).select("site", "url", "c.*")

    def entities(self) -> DataFrame:
        from rankloom.operators.entities import entity_filter

        return entity_filter(self.entities_raw())

    def categories(self) -> DataFrame:
        from rankloom.operators.entities import category_filter

        return category_filter(self.categories_raw())

    def signals(self) -> DataFrame:
        from rankloom.operators.content import entity_signals

        return entity_signals(self.texts(), self.entities(), self.categories())

    def verdicts(self) -> DataFrame:
        from rankloom.operators.content import content_verdicts, target_keywords

        return content_verdicts(self.texts(), target_keywords(self.query_page()), self.signals())

    def markup(self) -> DataFrame:
        host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
        return self.table("pages").select(host.alias("site"), F.col("url").alias("page"), F.col("html").alias("markup"))

    def links(self) -> DataFrame:
        from rankloom.operators.links import extract_links

        return extract_links(self.markup().withColumn("site", F.lit("all")))

    def known_pages(self) -> DataFrame:
        """Link targets: every slug that some page links to."""
        from rankloom.functions.urls import href_slug

        return self.links().select("site", href_slug(F.col("href")).alias("page")).filter(F.col("page").isNotNull()).distinct()

    def edges(self) -> DataFrame:
        from rankloom.operators.links import link_edges

        return link_edges(self.links(), self.known_pages())

    def known_metrics(self) -> DataFrame:
        """Metrics of link targets: the word's own uses as an anchor stand for its searches."""
        n = F.count("*")
        return self.edges().groupBy("site", F.col("dst").alias("page")).agg(
            F.floor(n / 3).cast("long").alias("clicks"), (n * 2).alias("impressions"), F.round(1 + F.pmod(n, F.lit(30)) / 2, 1).alias("position")
        )

    def list_members(self) -> DataFrame:
        """Lists of link targets by first letter."""
        return self.known_pages().select("site", F.concat(F.lit("l-"), F.lower(F.substring("page", 1, 1))).alias("list"), F.col("page").alias("dst"))

    def list_emitters(self) -> DataFrame:
        """A target emits the list of its second letter; long names show all of it, short ones a part."""
        p = F.col("page")
        return self.known_pages().filter(F.length(p) >= 2).select(
            "site", p.alias("src"), F.concat(F.lit("l-"), F.lower(F.substring(p, 2, 1))).alias("list"), F.when(F.length(p) > 4, "index").otherwise("widget").alias("mode")
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.lit("all").alias("site"), self.slug_of(F.col("vec_id")).alias("page"), F.col("embedding").alias("vec"))

    def slug_metrics(self) -> DataFrame:
        from rankloom.functions.urls import slug_from_url

        return self.page_metrics().select(F.lit("all").alias("site"), slug_from_url(F.col("url")).alias("page"), "clicks", "impressions", "position")

    def keyword_plan(self) -> DataFrame:
        """Parts as planned pages: name, brand and, for some sizes, type make the target keyword."""
        size = F.col("p_size")
        kw = F.concat_ws(
            " ", "p_name", F.when(F.pmod(size, F.lit(3)) > 0, F.lower("p_type")), F.replace("p_brand", F.lit("#"), F.lit("")),
            F.when(F.pmod(size, F.lit(3)) == 2, F.concat(F.lit("de Tamanho "), size)),
        )
        return self.table("part").select(
            F.lit("all").alias("site"), F.col("p_size").cast("long").alias("cluster"), F.concat(slugify(F.col("p_name")), F.lit("-"), F.col("p_partkey")).alias("slug"),
            kw.alias("keyword"), (size.cast("long") * 10).alias("impressions"),
        )

    def plan_lines(self) -> DataFrame:
        """Reviewed plans as text, one file a site: a header, comments, and a decision per supplier."""
        k = F.col("s_suppkey")
        sep = F.when(F.pmod(k, F.lit(5)) == 2, ",").otherwise(";")
        actions = F.array(*[F.lit(a) for a in ("410", "301", "", "404", "Manter", "301", "revisar", "301", "apagar", "301")])
        action = F.element_at(actions, F.pmod(F.floor(k / 5), F.lit(10)).cast("int") + 1)
        targets = F.array(F.concat(F.lit("https://www."), self.site_of(k), F.lit(".example/")), F.lit("relativo/x"), F.concat(self.url_of(k), F.lit("/")), F.concat(F.lit('"https://www.'), self.site_of(k), F.lit('.example/novo;a,b"')))
        target = F.element_at(targets, F.pmod(F.floor(k / 50), F.lit(4)).cast("int") + 1)
        url = F.when(F.pmod(k, F.lit(13)) == 12, F.lit("")).otherwise(self.url_of(k))
        t = self.table("supplier")
        body = t.select(self.site_of(k).alias("site"), (k + 10).alias("n"), F.concat(url, sep, action, sep, target, sep, F.lit("busca")).alias("value"))
        heads = self.table("region").select(
            self.site_of(F.col("r_regionkey")).alias("site"),
            F.explode(F.array(
                F.struct(F.lit(0).cast("long").alias("n"), F.lit("# Edite; depois, compile").alias("value")),
                F.struct(F.lit(1).cast("long").alias("n"), F.lit("").alias("value")),
                F.struct(F.lit(2).cast("long").alias("n"), F.when(F.col("r_regionkey") == 2, "url,acao_final,destino_final,origem").otherwise("url;acao_final;destino_final;origem").alias("value")),
            )).alias("h"),
        ).select("site", "h.n", "h.value")
        return body.unionByName(heads).withColumn("path", F.concat("site", F.lit("_poda.csv")))

    def sitemap_docs(self) -> DataFrame:
        """The sitemap as XML documents of at most a thousand URLs, named by an index document a site.

        Some entries name an image before their page, every other document has prefixed elements, and one document a site is broken.
        """
        s = self.sitemap().withColumn("seq", (F.floor(F.col("pos") / 1000) + 1).cast("int"))
        image = F.when(F.col("pos") % 3 == 0, "<image:image><image:loc>https://cdn.example/i.png</image:loc></image:image>").otherwise("")
        ns_prefix = F.when(F.col("seq") % 2 == 0, "sm:").otherwise("")
        entry = F.concat(F.lit("<"), ns_prefix, F.lit("url>"), image, F.lit("<"), ns_prefix, F.lit("loc> "), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("-"), F.lit("&#45;")),
                         F.lit("\n</"), ns_prefix, F.lit("loc></"), ns_prefix, F.lit("url>"))
        name = F.concat(F.lit("https://www."), F.col("site"), F.lit(".example/sitemap-"), F.col("seq"), F.lit(".xml"))
        ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
        docs = s.groupBy("site", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es")).select(
            "site", name.alias("doc_url"), "seq",
            F.concat(
                F.lit('<?xml version="1.0"?><'), ns_prefix, F.lit("urlset "), F.when(F.col("seq") % 2 == 0, ns.replace("xmlns", "xmlns:sm")).otherwise(ns),
                F.lit(' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'), F.array_join(F.transform("es", lambda x: x["e"]), ""), F.lit("</"), ns_prefix, F.lit("urlset>")).alias("xml"),
        )
        broken = docs.groupBy("site").agg(F.max("seq").alias("m")).select(
            "site", F.concat(F.lit("https://www."), F.col("site"), F.lit(".example/sitemap-broken.xml")).alias("doc_url"), (F.col("m") + 1).alias("seq"),
            F.lit(f"<urlset {ns}><url><loc>https://broken.example/a</loc></url><url><loc>https://broken.example/b</url></urlset>").alias("xml"))
        docs = docs.unionByName(broken)
        index = docs.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("seq", "doc_url"))).alias("ds")).select(
            "site", F.concat(F.lit("https://www."), "site", F.lit(".example/sitemap.xml")).alias("doc_url"), F.lit(0).alias("seq"),
            F.concat(
                F.lit(f"<sitemapindex {ns}>"),
                F.array_join(F.transform("ds", lambda x: F.concat(F.lit("<sitemap><loc>"), x["doc_url"], F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"),
            ).alias("xml"),
        )
        return docs.unionByName(index)
