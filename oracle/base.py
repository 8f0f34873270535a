"""Derived tables as SQL, and small SQL snippets that fix rounding and folding the same way on both sides."""

from rankloom.functions.wordlists import CTR_BENCHMARK, SLUG_STOPWORDS


def rnd(x, n):
    """Half-up on the decimal form, back to double."""
    return f"cast(round(cast({x} as decimal(30,12)), {n}) as double)"


def site(k):
    return f"'s' || ({k} % 5)"


def slug(k):
    return f"'produto-a' || ({k} % 7) || '-b' || ({k} % 11) || '-' || {k}"


def url(k):
    return f"'https://www.s' || ({k} % 5) || '.example/' || {slug(k)}"


def folded(x):
    return f"strip_accents({x})"


def ascii_fold(x):
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def norm_kw(x):
    return f"trim(regexp_replace(regexp_replace(lower({ascii_fold(x)}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_list(words):
    return "(" + ", ".join("'" + w + "'" for w in sorted(words)) + ")"


SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def host(u):
    return f"regexp_extract({u}, '{SCHEME}//([^/?#]*)', 1)"


def bare_host(u):
    return f"regexp_replace(lower({host(u)}), '^www\\.', '')"


def path(u):
    return f"regexp_replace(regexp_extract({u}, '{SCHEME}(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def query(u):
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def decode(x):
    return f"case when {x} like '%\\%zz%' escape '\\' then {x} else url_decode({x}) end"


def match_key(u):
    p = f"regexp_replace({decode(path(f'trim({u})'))}, '/+$', '')"
    q = query(f"trim({u})")
    return f"({bare_host(f'trim({u})')} || case when {p} = '' then '/' else {p} end || case when {q} <> '' then '?' || {q} else '' end)"


def is_home(u):
    return f"(regexp_replace({path(u)}, '/+$', '') = '')"


def slug_words(u):
    """Kept words of the last path segment as a list."""
    seg = f"list_filter(string_split({path(u)}, '/'), lambda x: x <> '')[-1]"
    bare = f"regexp_replace({decode(seg)}, '(?i)\\.(x?html?|php|aspx?|jsp)$', '')"
    return (
        f"list_filter(regexp_split_to_array(lower({bare}), '[-_]+'), lambda w: w <> '' and w not in {sql_list(SLUG_STOPWORDS)} "
        "and not regexp_full_match(w, '\\p{Nd}+'))"
    )


def expected_ctr(p):
    table = "[" + ", ".join(f"{v}::double" for v in CTR_BENCHMARK.values()) + "]"
    low = f"greatest(1, least(floor({p})::int, 10))"
    return f"case when {p} <= 10 then {table}[{low}] + ({p} - floor({p})) * ({table}[least({low} + 1, 10)] - {table}[{low}]) end"


def band(p, col):
    rows = [("Top 3", "Proteger posição", 1), ("1ª Página", "Otimizar title e meta description", 2), ("2ª Página", "Fortalecer conteúdo e links internos", 3),
            ("3ª Página", "Revisar e ampliar conteúdo", 4), ("4ª+ Página", "Reestruturar ou consolidar página", 5)]
    nodata = ("Sem Dados", "Sem impressões no período analisado", 6)
    q = (lambda r: str(r[2])) if col == "rank" else (lambda r: f"'{r[0]}'") if col == "band" else (lambda r: f"'{r[1]}'")
    bounds = (3, 10, 20, 50)
    whens = " ".join(f"when {p} <= {b} then {q(r)}" for b, r in zip(bounds, rows))
    return f"case when {p} is null then {q(nodata)} {whens} else {q(rows[4])} end"


def place():
    return "(1 + (l_linenumber - 1) * 5 + (l_partkey % 4) * 8)"


def _metrics(keys, names):
    return f"""select {site('l_suppkey')} site, {url('l_suppkey')} url, {names}
  cast(coalesce(sum(l_quantity) filter (l_returnflag = 'R' and l_linenumber = 1), 0) as bigint) clicks, cast(sum(l_quantity) as bigint) impressions,
  {rnd(f"sum(l_quantity * {place()}) / sum(l_quantity)", 1)} position
  from lineitem group by l_suppkey{keys}"""


HREF = r"""(?i)href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))"""


def unescape(x):
    return f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def squeeze(x):
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def no_code(x):
    return f"regexp_replace(regexp_replace({x}, '(?s)<\\?.*?\\?>', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"


def href_slug(h):
    cut = f"regexp_replace(regexp_replace(trim({h}), '(?s)#.*$', ''), '(?s)\\?.*$', '')"
    cut = f"trim(regexp_replace({cut}, '(?i)^[a-z][a-z0-9+.\\-]*://[^/]+', ''), '/')"
    seg = f"lower(regexp_replace(string_split({cut}, '/')[-1], '(?i)\\.(php\\d?|html?|aspx?|jsp|cgi)$', ''))"
    return f"case when not regexp_matches(trim({h}), '(?i)^(mailto:|tel:|javascript:|data:|#|//|$)') and {cut} <> '' and {seg} <> '' then {seg} end"


CTES = {
    "query_page": f"select site, query, url, clicks, impressions, {rnd('100.0 * clicks / impressions', 2)} ctr, position from ({_metrics(', l_partkey', chr(39) + 'kw ' + chr(39) + ' || l_partkey as query,')})",
    "page_metrics": f"""select site, url, sum(clicks)::bigint clicks, sum(impressions)::bigint impressions, {rnd('100.0 * sum(clicks) / sum(impressions)', 2)} ctr,
  {rnd('sum(cast(round(position * 10) as bigint) * impressions) / sum(impressions) / 10.0', 1)} position from query_page group by site, url""",
    "sitemap": f"""select {site('s_suppkey')} site, case s_suppkey % 4 when 2 then 'http://s' || (s_suppkey % 5) || '.example/' || {slug('s_suppkey')} || '/'
  when 3 then 'https://s' || (s_suppkey % 5) || '.example/' || replace({slug('s_suppkey')}, '-b', '%2Db') else {url('s_suppkey')} end url, s_suppkey + 1 pos from supplier where s_acctbal >= 0
  union all select {site('r_regionkey')}, 'https://www.s' || (r_regionkey % 5) || '.example/', 0 from region
  union all select {site('n_nationkey')}, 'https://www.s' || (n_nationkey % 5) || '.example/guia-' || lower(n_name), n_nationkey + 1000000000 from nation""",
    "position_rows": """select s.site, s.url, m.position, coalesce(m.clicks, 0) clicks, coalesce(m.impressions, 0) impressions, coalesce(m.ctr, 0.0)::double ctr, m.url is not null has_data
  from sitemap s left join page_metrics m on m.site = s.site and m.url = s.url""",
    "sitemap_keys": f"select site, {match_key('url')} match_key, arg_max(url, pos) sitemap_url from sitemap group by all",
    "ghosts": f"""select m.site, m.url, m.k match_key, clicks, impressions, ctr, position from (select *, {match_key('url')} k from page_metrics) m
  where not exists (select 1 from sitemap_keys k where k.site = m.site and k.match_key = m.k)""",
    "export_lines": f"""select {site('c_custkey')} || '.example' site, c_custkey n, 'https://www.s' || (c_custkey % 5) || '.example/antigo-' || (c_custkey % 97) || case when c_custkey % 3 = 0 then '/' else '' end
  || ', 2024-01-01; http://outro.example/x <' || {url('c_custkey')} || '>' as value from customer""",
    "export_list": f"""select regexp_replace(site, '\\.example$', '') site, arg_min(u, (n, k)) url, min((n, k)) pos, {match_key('u')} match_key from (
  select site, n, unnest(us) u, generate_subscripts(us, 1) k from (select site, n, regexp_extract_all(value, 'https?://[^\\s"''<>,;]+') us from export_lines)) where {bare_host('u')} = site group by site, {match_key('u')}""",
    "olds": """select *, 'busca' origin from ghosts union all
  select e.site, e.url, e.match_key, 0, 0, 0.0, null, 'export-gsc' from export_list e where not exists (select 1 from sitemap_keys k where k.site = e.site and k.match_key = e.match_key)
  and not exists (select 1 from ghosts g where g.site = e.site and g.match_key = e.match_key)""",
    "inspections": f"""select *, case verdict when 'PASS' then 'indexed' when 'FAIL' then 'not_indexed' when 'NEUTRAL' then 'warning' else 'unknown' end category from (
  select {site('o_custkey')} site, {url('o_custkey')} || '/' || o_orderkey url, o_orderdate::date date,
  case when o_orderstatus = 'F' then 'PASS' when o_orderstatus = 'O' then 'FAIL' when o_orderkey % 3 = 0 then 'NEUTRAL' when o_orderkey % 3 = 1 then 'VERDICT_UNSPECIFIED' else 'PARTIAL' end verdict,
  o_orderpriority coverage_state, o_orderdate last_crawl from orders)""",
    "stored_results": f"select {site('user_id')} site, {url('user_id')} url, ts cached_at, event_type = 'error' failed from events",
    "ev": f"select {site('user_id')} site, ts::date date, 'k' || json_extract_string(props, '$.k') query, event_type from events where event_type in ('view', 'click')",
    "site_daily": "select site, date, count(*) filter (event_type = 'click') clicks, count(*) filter (event_type = 'view') impressions from ev group by all",
    "query_daily": "select site, date, query, count(*) filter (event_type = 'click') clicks, count(*) filter (event_type = 'view') impressions from ev group by all",
    "history0": _metrics(", date_trunc('month', l_shipdate)::date", "date_trunc('month', l_shipdate)::date as date,"),
    "history": f"""select *, impressions >= 40 has_content, impressions * 3 words, {rnd('clicks * 20.0 / impressions', 2)} density,
  case when impressions * 3 < 180 then 'raso' when {rnd('clicks * 20.0 / impressions', 2)} >= 5 then 'over_otimizado' when {rnd('clicks * 20.0 / impressions', 2)} >= 3 then 'atencao' else 'ok' end verdict from history0""",
    "texts": f"select doc_id, {site('doc_id')} site, {url('doc_id')} url, {slug('doc_id')} page, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') tok from documents",
    "entities_raw": """select site, url, name, ['PERSON', 'LOCATION', 'ORGANIZATION', 'OTHER', 'NUMBER', 'CONSUMER_GOOD'][length(name) % 6 + 1] as type, count(*) / any_value(total) salience, min(pos) pos from (
  select site, url, len(w) total, unnest(w) as name, generate_subscripts(w, 1) pos from (select site, url, regexp_extract_all(text, '\\p{Lu}[\\p{L}\\p{N}]+') w from texts)) group by site, url, name""",
    "entities": f"""select site, url, name, type, salience, rank from (select site, url, name, type, {rnd('salience', 3)} salience, row_number() over (partition by site, url order by {rnd('salience', 3)} desc, pos)::int as rank
  from entities_raw where type not in ('NUMBER', 'PRICE', 'DATE', 'ADDRESS', 'PHONE_NUMBER') and trim(name) <> '') where rank <= 8""",
    "categories": f"""select site, url, name, confidence, row_number() over (partition by site, url order by confidence desc, name)::int as rank from (
  select {site('doc_id')} site, {url('doc_id')} url, '/Boa' as name, 0.9::double confidence from labels where quality = 1 union all select {site('doc_id')}, {url('doc_id')}, '/Toxica', 0.6 from labels where toxic = 1)""",
    "markup": "select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) site, url page, html markup from pages",
    "links": f"""select 'all' site, page, pos, coalesce(regexp_extract(a, '{HREF}', 1), '') || coalesce(regexp_extract(a, '{HREF}', 2), '') || coalesce(regexp_extract(a, '{HREF}', 3), '') href,
  {squeeze(unescape("regexp_replace(i, '<[^>]+>', ' ', 'g')"))} anchor from (
  select page, unnest(regexp_extract_all(m, '(?is)<a\\b([^>]*?)>(.*?)</a>', 1)) a, unnest(regexp_extract_all(m, '(?is)<a\\b([^>]*?)>(.*?)</a>', 2)) i,
  unnest(range(len(regexp_extract_all(m, '(?is)<a\\b([^>]*?)>(.*?)</a>', 1)))) pos from (select page, {no_code('markup')} m from markup)) where regexp_matches(a, '{HREF}')""",
    "known": f"select distinct site, {href_slug('href')} page from links where {href_slug('href')} is not null",
    "edges": f"""select l.site, l.page src, k.dst, l.anchor from links l join (select site, coalesce({href_slug('page')}, page) slug, min(page) dst from known group by all) k
  on k.site = l.site and k.slug = {href_slug('l.href')} where l.page <> k.dst""",
    "known_metrics": f"select site, dst page, (count(*) // 3)::bigint clicks, count(*) * 2 impressions, {rnd('1 + (count(*) % 30) / 2', 1)} as position from edges group by all",
    "members_l": "select site, 'l-' || lower(page[1]) list, page dst from known",
    "emitters_l": "select site, page src, 'l-' || lower(page[2]) list, case when length(page) > 4 then 'index' else 'widget' end mode from known where length(page) >= 2",
    "page_edges": f"""with s as (select site, page, pos, {href_slug('href')} slug from links) select a.site, a.slug src, b.slug dst from s a join s b on b.site = a.site and b.page = a.page and b.pos = a.pos + 1
  where a.slug <> b.slug and a.slug is not null and b.slug is not null""",
    "vectors": f"select 'all' site, {slug('vec_id')} page, embedding vec from embeddings",
    "reps": "select site, min(page) page, vec::double[] v, count(*) copies from vectors group by site, vec",
    "pairs": """select site, least(a, b) a, greatest(a, b) b, sim from (select x.site, x.page a, y.page b, list_cosine_similarity(x.v, y.v) sim from reps x join reps y on x.site = y.site and x.page < y.page) where sim >= 0.40""",
    "reach": """with recursive e as (select a, b from pairs union select b, a from pairs), r(n, m) as (select page, page from reps union select r.n, e.b from r join e on e.a = r.m) select n as node, min(m) component from r group by n""",
    "clusters": """select v.site, v.page, r.component as cluster from vectors v join reps p on p.site = v.site and p.v = v.vec::double[] join reach r on r.node = p.page""",
    "csize": "select site, cluster, count(*) size from clusters group by all",
    "cpairs": """select c.site, c.cluster, c.page a, d.page b, list_cosine_similarity(x.vec::double[], y.vec::double[]) sim from clusters c join clusters d on c.site = d.site and c.cluster = d.cluster
  join vectors x on x.site = c.site and x.page = c.page join vectors y on y.site = d.site and y.page = d.page""",
    "cohesion": f"select s.site, s.cluster, s.size, case when s.size < 2 then 1.0::double else {rnd('(sum(sim) filter (a <> b)) / (s.size * (s.size - 1))', 3)} end cohesion from csize s join cpairs p using (site, cluster) group by s.site, s.cluster, s.size",
    "repr": "select site, cluster, arg_min(a, (-round(t, 9), a)) representative from (select site, cluster, a, sum(sim) t from cpairs group by all) group by all",
    "slug_metrics": f"select 'all' site, lower({ascii_fold(chr(39) + chr(39) + ' || ' + 'string_split(url, ' + chr(39) + '/' + chr(39) + ')[-1]')}) page, clicks, impressions, position from page_metrics",
    "enriched": "select c.site, c.cluster, c.page, coalesce(m.clicks, 0) clicks, coalesce(m.impressions, 0) impressions, m.position from clusters c left join slug_metrics m on m.site = c.site and m.page = c.page",
    "perf": """select e.site, e.cluster, h.size, h.cohesion, r.representative, arg_min(e.page, (-clicks, -impressions, coalesce(position, 9999), e.page)) canonical, sum(clicks)::bigint group_clicks, sum(impressions)::bigint group_impressions,
  arg_min(e.page, (-clicks, -impressions, coalesce(position, 9999), e.page)) <> any_value(r.representative) canonical_differs from enriched e join cohesion h using (site, cluster) join repr r using (site, cluster)
  group by e.site, e.cluster, h.size, h.cohesion, r.representative""",
    "priority": "select * from (select *, row_number() over (partition by site order by group_impressions desc, size desc, cluster)::int as rank from perf where size >= 2) where rank <= 8",
    "keyword_plan": """select 'all' site, p_size::bigint as cluster, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || p_partkey slug, concat_ws(' ', p_name, case when p_size % 3 > 0 then lower(p_type) end,
  replace(p_brand, '#', ''), case when p_size % 3 = 2 then 'de Tamanho ' || p_size end) keyword, p_size::bigint * 10 impressions from part""",
    "items": f"""select *, list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '' and w not in ('de','do','da','dos','das','o','a','os','as','um','uma','uns','umas','e','ou','com','sem','para','pra','por','no','na','nos','nas','em','que','se','ao','aos','the')))) tokens
  from (select *, {norm_kw('keyword')} norm from keyword_plan) where norm <> ''""",
    "competing": "select * from query_page where impressions >= 10 and position <> 0 and position <= 30",
    "cann": """select site, query, url_count, case when p2 <= 10 then 'alta' when p2 <= 20 then 'média' else 'baixa' end severity, severity_score, best_url, best_position from (
  select site, query, count(*) url_count, min(position) filter (rn = 2) p2, (sum(impressions) filter (rn > 1))::bigint severity_score, min(url) filter (rn = 1) best_url, min(position) filter (rn = 1) best_position
  from (select *, row_number() over (partition by site, query order by position, url) rn from competing) group by all) where url_count >= 2""",
    "cann_members": "select c.site, c.query, c.url, c.position, c.clicks, c.impressions, c.ctr, g.url_count, g.severity, g.severity_score, g.best_url from competing c join cann g using (site, query)",
}



def with_ctes(final: str) -> str:
    """The final select with exactly the CTEs it needs, in order."""
    import re

    def used(text):
        return [n for n in CTES if re.search(rf"\b{n}\b(?!\s*\()", text) and n]

    need, todo = set(), used(final)
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.add(n)
        todo += [u for u in used(re.sub(r"'[^']*'", "", CTES[n])) if u != n]
    names = [n for n in CTES if n in need]
    if not names:
        return final
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in names) + "\n" + final
