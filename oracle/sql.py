"""One DuckDB statement per registered query, where SQL can say it at whole-table cost."""

from oracle.base import (
    ascii_fold, band, bare_host, decode, expected_ctr, folded, host, href_slug, is_home, match_key, no_code, path, query, rnd, slug,
    slug_words, squeeze, sql_list, unescape, url, with_ctes, site, HREF,
)
from rankloom.functions.wordlists import GENERIC_ANCHORS, SITE_SERIES, SLUG_STOPWORDS, TERM_STOPWORDS, TTL_HOURS
from rankloom.operators.prompts import DIFF_TASK, JUDGE_TASK

Q = {}

# ---- sources ----
Q["S01_page_metrics"] = f"select site, url, clicks, impressions, {rnd('clicks / impressions * 100', 2)} ctr, {rnd('position + 0.03', 1)} as position from page_metrics"
Q["S02_query_page_metrics"] = f"select site, query, url, clicks, impressions, {rnd('clicks / impressions * 100', 2)} ctr, {rnd('position + 0.03', 1)} as position from query_page"
Q["S03_daily_metrics"] = "select site, date, query, clicks, impressions from query_daily"
Q["S04_report_window"] = "select * from site_daily where date between date '2024-01-28' - 17 and date '2024-01-28' - 3"
Q["S05_sitemap_urls"] = """select site, url, (doc - 1)::int doc, (n - 1)::int pos from (select site, url, dense_rank() over (partition by site order by pos // 1000) doc, row_number() over (partition by site, pos // 1000 order by pos) n from sitemap)"""
Q["S06_robots_sitemap"] = "select distinct site, 'https://' || site || '/sitemap.xml' sitemap_url from markup"
TEXT = squeeze(unescape(f"regexp_replace({no_code('html')}, '<[^>]+>', ' ', 'g')"))
Q["S07_folder_pages"] = f"""select 'all' site, page_id::varchar page, t as text from (select page_id, url, {TEXT} t from pages) where length(url) % 3 < 2 and length(t) >= 300
  and page_id not in (select item_id from benchmark)"""
Q["S08_folder_sources"] = "select 'all' site, page_id::varchar page, length(html)::int chars from pages where length(url) % 3 < 2"
Q["S09_listed_pages"] = """select 's' || n_regionkey site, 'guia-nacao-' || n_nationkey page,
  case when n_nationkey in (3, 12) then 0 else 1 end list_no, (case when n_nationkey = 3 then 0 when n_nationkey = 12 then 2 else row_number() over (partition by n_regionkey order by n_nationkey) - 1 end)::int pos from nation"""
Q["S10_site_list"] = "select c_custkey n, lower(replace(c_name, '#', '-')) || '.example' site from customer where c_acctbal >= 0 and c_mktsegment <> 'BUILDING'"
Q["S11_export_urls"] = "select site, url from export_list"
PLAN = f"""select site, n, url, action, target from (select {site('s_suppkey')} site, s_suppkey + 10 n, case when s_suppkey % 13 = 12 then '' else {url('s_suppkey')} end url,
  ['410', '301', 'revisar', '404', 'manter', '301', 'revisar', '301', 'apagar', '301'][(s_suppkey // 5) % 10 + 1] as action,
  ['https://www.s' || (s_suppkey % 5) || '.example/', 'relativo/x', {url('s_suppkey')} || '/', 'https://www.s' || (s_suppkey % 5) || '.example/novo;a,b'][(s_suppkey // 50) % 4 + 1] target from supplier)"""
REVIEWED = f"""select site, n, url, action, case when action = '301' then target end target, case when reason is not null then 'error' when action = 'revisar' then 'pending' when action = 'manter' then 'kept' else 'entry' end status, reason from (
  select *, case when url = '' then 'url vazia' when action = 'apagar' then 'acao_final invalida' when action = '301' and target like 'relativo%' then '301 sem destino_final absoluto valido'
  when action = '301' and target = url || '/' then '301 com destino igual a origem' end reason from ({PLAN}))"""
Q["S12_reviewed_plan"] = REVIEWED
Q["S13_snapshot_metrics"] = f"""select site, lower(string_split(url, '/')[-1]) page, url, clicks, impressions, position, {rnd('100.0 * clicks / impressions', 2)} ctr, true has_data from history0 h
  where date = (select max(date) from history0 x where x.site = h.site)"""
Q["S14_latest_artifact"] = f"""select site, date, path, is_legacy from (select {site('o_custkey')} site, o_orderdate::date date, '/p/' || o_orderkey || '_poda.csv' path, o_orderstatus = 'F' is_legacy,
  row_number() over (partition by o_custkey % 5 order by o_orderstatus = 'F', o_orderdate::date desc, '/p/' || o_orderkey || '_poda.csv') rn from orders) where rn = 1"""
Q["S15_history_scan"] = "select site, date, (date - 27)::date period_start, date period_end, url, position, clicks, impressions, case when has_content then verdict end verdict, case when has_content then words end words from history"

# ---- sinks ----
Q["K01_indexing_report"] = "select site, date, url, category, verdict, coverage_state, strftime(last_crawl, '%Y-%m-%dT%H:%M:%S') last_crawl from inspections"
Q["K02_position_report"] = """select site, url as "URL", case when has_data then position end "Posicao", clicks "Cliques", impressions "Impressoes", case when has_data then ctr end "CTR", case when has_data then 'Sim' else 'Nao' end "Com_Dados" from position_rows"""
Q["K04_indexing_history_append"] = """select site, date, count(*) total_urls, count(*) filter (category = 'indexed') indexed, count(*) filter (category = 'not_indexed') not_indexed,
  count(*) filter (category = 'warning') warning, count(*) filter (category = 'unknown') as unknown from inspections group by site, date"""
ESC = lambda x: f"regexp_replace({x}, '([\\\\.^$|?*+()\\[\\]{{}}\\-#&~\\s])', '\\\\\\1', 'g')"
RULE_PATH = f"case when {path('url')} = '' then '/' else {path('url')} end"
Q["K08_removal_rules"] = f"""with e as (select site, url, action, target, {RULE_PATH} p from ({REVIEWED}) where status = 'entry')
  select site, url, action, 'htaccess' format, 'RedirectMatch ' || action || ' ^' || {ESC('p')} || '/?$' || case when action = '301' then ' ' || target else '' end rule from e
  union all select site, url, action, 'nginx', 'location = ' || p || ' {{ return ' || action || case when action = '301' then ' ' || target else '' end || '; }}' from e
  union all select site, url, action, 'redirect', 'Redirect ' || action || ' ' || p || case when action = '301' then ' ' || target else '' end from e"""
Q["K10_site_partition_name"] = "select 'www.loja ' || c_custkey || '/é?' || lower(c_mktsegment) site, 'www.loja_' || c_custkey || '_é_' || lower(c_mktsegment) folder from customer"

# ---- scalar functions ----
DOMAIN = """(select s_suppkey k, ['sc-domain:', 'https://', 'http://www.', ''][s_suppkey % 4 + 1] || 'loja-' || s_suppkey || '.example' || case when s_suppkey % 3 = 0 then '/' else '' end as domain from supplier)"""
Q["X01_normalize_domain"] = f"select domain, case when k % 4 = 2 then 'www.' else '' end || 'loja-' || k || '.example' bare from {DOMAIN}"
Q["X02_site_url"] = f"""select domain, case when k % 4 = 0 then domain else ['', 'https://', 'http://www.', 'https://'][k % 4 + 1] || 'loja-' || k || '.example/' end site_url from {DOMAIN}"""
ODD = f"""(select unnest([{url('s_suppkey')}, 'HTTP://WWW.S' || s_suppkey || '.Example/A%20b/', 'https://s.example/a+b/' || s_suppkey || '//', 'https://s.example/p' || s_suppkey || ';x=1?q=A%20b#top',
  ' https://www.s.example/um dois/' || s_suppkey || ' ', 'https://s.example?id=' || s_suppkey, 'https://s.example/', 'https://s.example/%zz' || s_suppkey, '/so/caminho-' || s_suppkey || '.php']) url from supplier)"""
Q["X03_match_key"] = f"select url, {match_key('url')} match_key from {ODD}"
Q["X04_url_path_query"] = f"select url, case when {path('url')} = '' then '/' else {path('url')} end || case when {query('url')} <> '' then '?' || {query('url')} else '' end as path from {ODD}"
Q["X05_homepage"] = f"""select site, coalesce(arg_min(url, pos) filter ({is_home('url')}), regexp_extract(arg_min(url, pos), '^[a-z]+://[^/]+') || '/') home_url from sitemap group by site"""
Q["X06_brand_query"] = """select distinct query, brand, length(brand) >= 4 and length(c) >= 4 and (contains(brand, c) or contains(c, brand)) is_brand from (
  select query, brand, regexp_replace(strip_accents(lower(query)), '[^a-z0-9]', '', 'g') c from (select case when length(p_name) % 2 = 0 then p_name else 'Loja' || p_size || ' preço' end query, 'loja' || p_size brand from part))"""
PHRASE = f"case when len({slug_words('url')}) > 0 then array_to_string({slug_words('url')}, ' ') end"
Q["X07_slug_phrase"] = f"select site, url, {PHRASE} phrase from sitemap"
Q["X07_slugify"] = f"select doc_id, trim(regexp_replace(lower({ascii_fold('text')}), '[^a-z0-9]+', '-', 'g'), '-') slug from documents"
SEG = "trim(regexp_replace(url, '^https?://[^/]+', ''), '/')"
Q["X08_slug_from_url"] = f"select site, url, lower(case when {SEG} = '' then 'index' else string_split({SEG}, '/')[-1] end) slug from sitemap"
Q["X09_href_slug"] = f"select page, pos::int pos, href, {href_slug('href')} slug from links"
Q["X10_fold_accents"] = f"select doc_id, {folded('text')} folded, {ascii_fold('text')} plain from documents"
# written out: DuckDB has no compatibility decomposition
ODD = [("preco...barato", "preco...barato", "preco barato"), ("1⁄2 fim No", "12 fim No", "12 fim no"), ("Full width", "Full width", "full width"), ("Иод елка", " ", ""), ("αλφα", "", ""),
       ("l·uz ijs dzip", "luz ijs dzip", "luz ijs dzip"), ("123 kg", "123 kg", "123 kg"), ("straße ørn", "strae rn", "strae rn"), ("ete", "ete", "ete")]
Q["X10_fold_other_letters"] = f"""select n_nationkey, f || ' ' || lower(n_name) folded, p || ' ' || lower(n_name) plain, trim(k || ' ' || replace(lower(n_name), '_', ' ')) keyword from nation
  join (values {", ".join(f"({i}, '{f}', '{p}', '{k}')" for i, (f, p, k) in enumerate(ODD))}) v(i, f, p, k) on i = n_nationkey % {len(ODD)}"""
Q["X11_normalize_keyword"] = "select slug, norm, array_to_string(tokens, ' ') tokens from items"
Q["X12_word_count"] = "select url, len(tok)::int words from texts"
Q["X13_keyword_density"] = f"""select url, phrase, occ::int occurrences, {rnd('occ * greatest(1, len(list_filter(tok[1:2], lambda w: true))) / len(tok) * 100.0', 2)} density from (
  select url, tok, array_to_string(tok[1:2], ' ') phrase, len(regexp_extract_all(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?s)(?:^|[^\\p{{L}}\\p{{N}}_])' || array_to_string(tok[1:2], '  ') || '(?:[^\\p{{L}}\\p{{N}}_]|$)')) occ from texts)"""
Q["X14_vocab_diversity"] = f"select url, {rnd('len(list_distinct(tok)) / len(tok)', 3)} diversity from texts"
Q["X15_expected_ctr"] = f"select site, query, url, {rnd(expected_ctr('position'), 6)} expected from query_page"
SCORE = f"coalesce({rnd(f'impressions * greatest(0.0, {expected_ctr(chr(112) + chr(111) + chr(115) + chr(105) + chr(116) + chr(105) + chr(111) + chr(110))} - ctr) / 100', 1)}, 0.0)"
LEVEL = "case when score >= 50 then 'high' when score >= 10 then 'medium' else 'low' end"
SCORED = f"(select *, case when position <= 10 then {SCORE} else 0.0::double end score from query_page)"
Q["X16_opportunity_score"] = f"select site, query, url, score, {LEVEL} band from {SCORED}"
Q["X17_position_band"] = f"select site, query, url, {band('position', 'band')} band, {band('position', 'action')} as action from query_page"
Q["X18_extract_text"] = f"select url page, {TEXT} as text from pages"
CUT = lambda x, t: f"regexp_replace({x}, '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')"
BLOCK = lambda t: f"case when regexp_matches(html, '(?is)<{t}[^>]*>.*?</{t}>') then regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1) end"
BODY = f"coalesce({BLOCK('main')}, {BLOCK('article')}, {CUT(CUT(CUT(CUT('html', 'nav'), 'header'), 'footer'), 'aside')})"
AD = f"""regexp_replace(b, '(?is)<div\\b[^>]*\\bclass="[^"]*ad[^"]*"[^>]*>.*?</div>', ' ', 'g')"""
Q["X19_main_content"] = f"""select url page, nullif({squeeze(unescape(f"regexp_replace(regexp_replace({AD}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"))}, '') as text from (
  select url, {CUT(CUT(BODY, 'aside'), 'nav')} b from pages)"""
Q["X20_extract_links"] = "select site, page, pos::int pos, href, anchor from links"
Q["X21_parse_model_json"] = """select doc_id::varchar as cluster, case when n_chars % 4 < 2 then case when n_chars < 1000 then 'raso' else 'ok' end end verdict, case when n_chars % 4 < 2 then 'a,}' end first_gap, n_chars % 4 < 2 parsed from documents"""
Q["X21_parse_model_json"] = """select doc_id::varchar as cluster, case when n_chars % 4 < 2 then case when n_chars < 1000 then 'raso' else 'ok' end end verdict,
  case n_chars % 4 when 0 then 'a,}' when 1 then 'a}' end first_gap, n_chars % 4 < 2 parsed from documents"""
Q["X22_verdict_category"] = "select site, url, category from inspections"
CAND = """(select n_name site, 'www.' || lower(replace(n_name, '_', '-')) || '.example' as domain, case c_mktsegment when 'BUILDING' then replace(n_name, '_', ' ') when 'MACHINERY' then n_name || ' Incorporated' else c_name end as name,
  case when c_mktsegment = 'AUTOMOBILE' then 'https://www.' || lower(replace(n_name, '_', '-')) || '.org/x' else '' end url, c_acctbal score, 'Nation ' || n_nationkey brand,
  lower(replace(n_name, '_', '')) b, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey)"""
# the folded brand of NATION_7 is nation7; only the shop itself and its namesake host are plausible, a long legal form is not
PLAUSIBLE = "(c_mktsegment in ('BUILDING', 'AUTOMOBILE'))"
Q["X23_brand_match"] = f"select site, name, score, brand, {PLAUSIBLE} plausible from {CAND}"
WORDS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim(Q)), '\\s+'), lambda w: length(w) >= 3 and w not in {sql_list(TERM_STOPWORDS)})))"
Q["X24_query_terms"] = f"select slug, array_to_string({WORDS.replace('Q', 'keyword', 1)}, ' ') terms from keyword_plan"
Q["X25_freshness"] = "select source, count(*) filter (cached_at >= timestamp '2024-01-28' - to_hours(ttl)) fresh, count(*) stored from stored_results, (values " + ", ".join(f"('{k}', {v})" for k, v in TTL_HOURS.items()) + ") t(source, ttl) group by source"
HASH = "substr(sha256('m' || chr(0) || 'b' || chr(0) || page || chr(0) || text), 1, 16)"
Q["X26_content_hash"] = f"select page, {HASH} hash from texts"

# ---- filters ----
Q["F01_pages_without_impressions"] = "select site, url, 'Revisar conteúdo ou consolidar' suggestion from position_rows where not has_data"
Q["F02_opportunity_urls"] = """select * from (select site, url, position, impressions, row_number() over (partition by site order by impressions desc, url)::int as rank from position_rows where has_data and position between 4 and 10) where rank <= 8"""
POS = f"greatest(0.0, {rnd('100.0 - (coalesce(sum(position * impressions) filter (has_data) / nullif(sum(impressions) filter (has_data), 0), avg(position) filter (has_data)) - 1.0) * 2.0', 1)})"
CTRC = lambda f: f"coalesce({rnd(f'avg(least(1.0, ctr / ({expected_ctr(chr(112) + chr(111) + chr(115) + chr(105) + chr(116) + chr(105) + chr(111) + chr(110))}))) filter ({f}) * 100.0', 1)}, 50.0)"
HEALTH = f"""(select *, score, case when score >= 80 then 'Excelente' when score >= 60 then 'Bom' when score >= 40 then 'Regular' else 'Crítico' end grade, indexation_score is not null has_indexation_data from (
  select *, {rnd('coalesce(indexation_score * 0.4 + position_score * 0.4 + ctr_score * 0.2, position_score * (0.4 / 0.6) + ctr_score * (0.2 / 0.6))', 1)} score from (
  select site, {POS} position_score, {CTRC('has_data and position <= 10')} ctr_score from position_rows group by site) left join (
  select site, {rnd("count(*) filter (category = 'indexed') / count(*) * 100", 1)} indexation_score from inspections i where date = (select max(date) from inspections j where j.site = i.site) group by site) using (site)))"""
HEALTH = HEALTH.replace("select *, score, case", "select *, case", 1)
Q["F03_component_alerts"] = f"""select site, component, label, value, case when value < 50 then 'critico' else 'alto' end severity, component || ': ' || printf('%.1f', value) || '/100' message from (
  select site, 'indexation' component, 'Indexação' as label, indexation_score as value from {HEALTH} union all select site, 'position', 'Posicionamento', position_score from {HEALTH} union all select site, 'ctr', 'CTR vs benchmark', ctr_score from {HEALTH}) where value < 60"""
INLINK = """(select k.site, k.page, coalesce(i.n, 0) inlinks, coalesce(o.n, 0) outlinks, coalesce(m.clicks, 0) clicks, coalesce(m.impressions, 0) impressions, m.position from known k
  left join (select site, dst, count(distinct src) n from edges group by all) i on i.site = k.site and i.dst = k.page left join (select site, src, count(distinct dst) n from edges group by all) o on o.site = k.site and o.src = k.page
  left join known_metrics m on m.site = k.site and m.page = k.page)"""
Q["F04_underlinked_pages"] = f"select * from {INLINK} where inlinks <= 4 and impressions >= 1"
Q["F05_entity_filter"] = "select * from entities"
Q["F05_category_filter"] = "select * from categories"

# ---- joins ----
Q["J01_sitemap_x_metrics"] = "select site, url, position, clicks, impressions, ctr, has_data from position_rows"
Q["J02_ghost_urls"] = "select site, url, match_key, clicks, impressions, ctr, position from ghosts"
LIVE = f"""(select q.site, q.query, q.url, q.clicks from (select *, {match_key('url')} k from query_page where not {is_home('url')}) q join sitemap_keys s on s.site = q.site and s.match_key = q.k)"""
BY_QUERY = f"""(select site, match_key, target, score from (select g.site, g.match_key, a.url target, sum(q.impressions + 1)::bigint score, row_number() over (partition by g.site, g.match_key order by sum(q.impressions + 1) desc, sum(a.clicks) desc, a.url) rn
  from ghosts g join (select *, {match_key('url')} k from query_page) q on q.site = g.site and q.k = g.match_key join {LIVE} a on a.site = q.site and a.query = q.query group by g.site, g.match_key, a.url) where rn = 1)"""
Q["J03_target_by_shared_query"] = f"select * from {BY_QUERY}"
TOK = f"(select site, url, pos, list_sort(list_distinct({slug_words('url')})) t from sitemap)"
BY_SLUG = f"""(select site, url, target, {rnd('j', 4)} score from (select o.site, o.url, s.url target, len(list_intersect(o.t, s.t)) / len(list_distinct(list_concat(o.t, s.t))) j,
  row_number() over (partition by o.site, o.url order by len(list_intersect(o.t, s.t)) / len(list_distinct(list_concat(o.t, s.t))) desc, s.pos) rn
  from (select site, url, list_sort(list_distinct({slug_words('url')})) t from olds) o join {TOK} s on s.site = o.site where len(o.t) > 0 and len(s.t) > 0) where rn = 1 and j >= 0.5)"""
Q["J04_target_by_slug"] = f"select * from {BY_SLUG}"
Q["J05_canonical_sitemap_form"] = "select * from sitemap_keys"
TOPQ = lambda t: f"""(select site, match_key, string_agg(query, '|' order by rn) top_queries from (select g.site, g.match_key, q.query, row_number() over (partition by g.site, g.match_key order by q.impressions desc, q.query, q.url) rn
  from {t} g join (select *, {match_key('url')} k from query_page) q on q.site = g.site and q.k = g.match_key) where rn <= 3 group by site, match_key)"""  # noqa: E731
Q["J06_ghost_x_queries"] = f"select * from {TOPQ('ghosts')}"
KW = "(select site, url, list(query order by rn) kws from (select site, url, query, row_number() over (partition by site, url order by impressions desc, query) rn from query_page where impressions >= 1) where rn <= 3 group by site, url)"
Q["J07_target_keywords"] = f"select site, url, array_to_string(kws, '|') keywords from {KW}"
Q["J08_cluster_x_metrics"] = "select * from perf"
Q["J09_link_resolution"] = "select site, src, dst, anchor from edges"
Q["J10_link_orphans"] = "select site, page from known k where not exists (select 1 from page_edges e where e.site = k.site and e.dst = k.page)"
SPOKES = """(with h as (select m.site, m.list as cluster, m.dst, row_number() over (partition by m.site, m.list order by coalesce(k.impressions, 0) desc, m.dst) rn from members_l m left join known_metrics k on k.site = m.site and k.page = m.dst)
  select s.site, s.cluster, b.dst hub, s.dst spoke from h s join h b on b.site = s.site and b.cluster = s.cluster and b.rn = 1 where s.rn > 1)"""
HUB = f"""(select s.*, exists (select 1 from page_edges e where e.site = s.site and e.src = s.spoke and e.dst = s.hub) links_hub, exists (select 1 from page_edges e where e.site = s.site and e.src = s.hub and e.dst = s.spoke) linked_by_hub from {SPOKES} s)"""
Q["J11_hub_spoke_links"] = f"select site, cluster, hub, spoke, links_hub, linked_by_hub from {HUB}"
Q["J11_hub_spoke_gaps"] = f"""select site, cluster, hub, count(*) spokes_total, count(*) filter (not links_hub) missing_to_hub, count(*) filter (links_hub) have_to_hub, count(*) filter (not linked_by_hub) missing_from_hub,
  bool_and(links_hub and linked_by_hub) complete from {HUB} group by site, cluster, hub"""
INBOUND = "(select distinct e.site, m.dst, e.mode from emitters_l e join members_l m on m.site = e.site and m.list = e.list and m.dst <> e.src)"
Q["J12_template_inbound"] = f"select * from {INBOUND}"
NEAR = """(select distinct x.site, x.tokens l, y.tokens r from (select distinct site, tokens from items where len(tokens) >= 2) x join (select distinct site, tokens from items where len(tokens) >= 2) y on x.site = y.site and x.tokens <> y.tokens
  where list_has_all(x.tokens, y.tokens) or list_has_all(y.tokens, x.tokens) or len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens))) >= 0.7)"""
Q["J13_near_sets"] = f"""select site, array_to_string(l, ' ') "left", array_to_string(r, ' ') "right" from {NEAR}"""
GAP = f"""(select t.site, t.url, term, sum(impressions)::bigint impressions from texts t join (select *, lower(regexp_replace(url, '/+$', '')) k, row_number() over (partition by site, lower(regexp_replace(url, '/+$', '')) order by impressions desc, query, url) rn from query_page) q
  on q.site = t.site and q.k = lower(regexp_replace(t.url, '/+$', '')) and q.rn <= 8, lateral (select unnest({WORDS.replace('Q', 'q.query', 1)}) term) group by all)"""
ENT = f"""(select distinct site, url, term from (select site, url, unnest(w) term from (select site, url, regexp_split_to_array(lower(trim(name)), '\\s+') w from entities) where len(w) <= 5) where length(term) >= 3 and term not in {sql_list(TERM_STOPWORDS)})"""
Q["J14_content_gaps"] = f"select site, url, term, impressions, exists (select 1 from {ENT} e where e.site = g.site and e.url = g.url and e.term = g.term) covered from {GAP} g"
Q["U03_term_intersect_except"] = f"""select site, url, coalesce(string_agg(term, ' ' order by term) filter (covered), '') covered, coalesce(string_agg(term, ' ' order by term) filter (not covered), '') gaps from (
  {Q['J14_content_gaps']}) group by site, url"""
SERIES_ROWS = lambda m: f"""(select a.site, a.date, '{SITE_SERIES}' series, 0 as rank, a.{m}::double v from site_daily a union all
  select a.site, a.date, t.query, t.rank, coalesce(q.{m}, 0) from site_daily a join (select * from (select site, query, row_number() over (partition by site order by sum(impressions) desc, query)::int as rank from query_daily group by site, query) where rank <= 10) t on t.site = a.site
  left join query_daily q on q.site = a.site and q.query = t.query and q.date = a.date)"""  # noqa: E731
SERIES = lambda m: f"(select site, series, rank, list(v order by date) v, list(date order by date) d from {SERIES_ROWS(m)} group by site, series, rank)"
THIRDS = lambda m: f"""(select *, case when len(v) < 6 then list_avg(v) else list_avg(v[1:len(v) // 3]) end fm, case when len(v) < 6 then list_avg(v) else list_avg(v[len(v) - len(v) // 3 + 1:len(v)]) end lm from {SERIES(m)})"""
DIR = lambda a, b, short: f"case when {short} then 'stable' when {a} = 0 then case when {b} > 0 then 'rising' else 'stable' end when {b} / {a} >= 1.15 then 'rising' when {b} / {a} <= 0.85 then 'declining' else 'stable' end"
Q["W01_trend_thirds"] = f"select site, series, {DIR('fm', 'lm', 'len(v) < 6')} trend, {rnd('fm', 6)} first_mean, {rnd('lm', 6)} last_mean from {THIRDS('clicks')}"
W02 = f"""(select site, series, rank, {DIR('fm', 'lm', 'len(v) < 6')} trend, list_max(v)::bigint peak, {rnd('lm', 0)}::bigint latest, len(list_filter(v, lambda x: x > 0)) < 14 sparse, {rnd('fm', 1)} first_avg, {rnd('lm', 1)} last_avg from {THIRDS('impressions')})"""
Q["W02_date_trends"] = f"select * from {W02}"
Q["W03_short_trend"] = f"""select site, series, {DIR('list_avg(u[1:3])', 'list_avg(u[len(u) - 2:len(u)])', 'len(u) < 6')} trend, list_max(v)::bigint peak, coalesce(list_filter(v, lambda x: x > 0)[-1], 0)::bigint latest, len(list_filter(v, lambda x: x > 0)) < 8 sparse from (
  select *, v[1:coalesce(list_max(list_transform(v, lambda x, i: case when x <> 0 then i else 0 end)), 0)] u from {SERIES('impressions')})"""
Q["W08_trend_latest"] = f"""select site, rank, series, series[1:35] as label, trend, latest from {W02} where rank < 6"""
Q["W08_trend_chart_series"] = f"""select site, rank, series, series[1:35] as label, date, v as value from {SERIES_ROWS('impressions')} where rank < 6"""
Q["J15_trend_x_best_position"] = f"""select t.site, t.series, t.rank, t.trend, t.peak, t.latest, b.position best_position, b.impressions best_impressions from {W02} t left join (
  select site, replace(query, 'kw ', 'k') series, position, impressions, row_number() over (partition by site, query order by position, impressions desc) rn from query_page) b on b.site = t.site and b.series = t.series and b.rn = 1"""
Q["J17_brand_entity"] = f"""select site, domain, brand, name, url, score from (select *, row_number() over (partition by site order by score desc, name, url) rn from {CAND}) where rn = 1 and {PLAUSIBLE}"""
Q["J18_refresh_worklist"] = "select site, url from page_metrics p where not exists (select 1 from stored_results r where r.site = p.site and r.url = p.url and not failed and cached_at >= timestamp '2024-01-30')"
LAST = lambda odd: f"(select site, cached_at::date as date, url, arg_max(cached_at, (cached_at, failed)) cached_at, arg_max(failed, (cached_at, failed)) failed from stored_results where minute(cached_at) % 2 = {odd} group by all)"
Q["J18_upsert_results"] = f"""select * from {LAST(1)} where not failed union all select * from {LAST(0)} s where not exists (select 1 from {LAST(1)} n where not n.failed and n.site = s.site and n.date = s.date and n.url = s.url)"""
Q["J19_cosine_pairs"] = f"select site, a, b, {rnd('sim', 6)} sim from pairs"

# ---- aggregations ----
SUMMARY = f"""(select site, count(*) total_urls, count(*) filter (has_data) urls_with_data, count(*) filter (not has_data) urls_no_impressions, {rnd('avg(position) filter (has_data)', 1)} avg_position, sum(clicks)::bigint total_clicks, sum(impressions)::bigint total_impressions,
  coalesce({rnd('avg(ctr) filter (has_data)', 2)}, 0.0) avg_ctr from position_rows group by site)"""
Q["A01_position_summary"] = f"select * from {SUMMARY}"
Q["A02_indexing_summary"] = f"""select s.site, s.n total_urls, c.category, count(i.url) total, {rnd('count(i.url) / s.n * 100', 1)} as percent from (select site, count(*) n from inspections group by site) s
  cross join (values ('indexed'), ('not_indexed'), ('warning'), ('unknown')) c(category) left join inspections i on i.site = s.site and i.category = c.category group by s.site, s.n, c.category"""
Q["A03_position_component"] = f"select site, {POS} position_score from position_rows group by site"
Q["A04_ctr_component"] = f"select site, {CTRC('has_data and position <= 10')} ctr_score from position_rows group by site"
Q["A05_health_score"] = f"select site, position_score, ctr_score, indexation_score, score, grade, has_indexation_data from {HEALTH}"
Q["A06_cannibalization"] = "select * from cann"
Q["A06_cannibalization_members"] = "select * from cann_members"
Q["A07_band_distribution"] = f"""select s.site, b.r band_rank, b.band, count(p.url) urls, {rnd('count(p.url) / s.n * 100', 1)} as percent from (select site, count(*) n from position_rows group by site) s
  cross join (values (1, 'Top 3'), (2, '1ª Página'), (3, '2ª Página'), (4, '3ª Página'), (5, '4ª+ Página'), (6, 'Sem Dados')) b(r, band) left join position_rows p on p.site = s.site and {band('p.position', 'rank')} = b.r group by s.site, s.n, b.r, b.band"""
Q["A08_cluster_cohesion"] = "select site, cluster, cohesion from cohesion"
Q["A09_cluster_representative"] = "select site, cluster, representative from repr"
Q["A10_inlink_report"] = f"select * from {INLINK}"
from oracle.base import norm_kw  # noqa: E402

ANCHOR = f"(select site, {norm_kw('anchor')} anchor, dst from edges)"
Q["A11_anchor_collisions"] = f"""select site, anchor, targets, dst, uses from (select site, anchor, dst, count(*) uses, count(*) over (partition by site, anchor) targets from {ANCHOR} where anchor <> '' and anchor not in {sql_list(GENERIC_ANCHORS)} group by site, anchor, dst) where targets >= 2"""
TIER = f"""(select k.site, k.page, coalesce(c.n, 0) contextual, coalesce(t.m, '') as template, case when c.n > 0 then 'contextual' when t.m is not null then 'template_only' else 'orphan' end tier from known k
  left join (select site, dst, count(distinct src) n from page_edges group by all) c on c.site = k.site and c.dst = k.page left join (select site, dst, string_agg(mode, ',' order by mode) m from {INBOUND} group by all) t on t.site = k.site and t.dst = k.page)"""
Q["A12_link_tier"] = f"select * from {TIER}"
Q["A12_tier_counts"] = f"select site, tier, count(*) pages from {TIER} group by all"
Q["A13_exact_keyword_collisions"] = """select site, norm, 'exata' kind, arg_min(keyword, o) keyword, arg_min(cluster, o) owner_cluster, arg_min(slug, o) owner_slug, count(*) n, sum(impressions)::bigint impr_total, count(distinct cluster) >= 2 cross_cluster from (
  select *, (-impressions, cluster, slug, keyword) o from items) group by site, norm having count(*) >= 2 and count(distinct slug) >= 2"""
Q["A14_topical_pillars"] = f"""with f as (select site, url, trim(name) as name, arg_min(salience, rank) salience, arg_min(type, rank) as type from entities group by site, url, trim(name)),
  t as (select site, name, type, row_number() over (partition by site, name order by count(*) desc, min(url)) rn from f group by site, name, type)
  select f.site, f.name, t.type, count(*)::bigint pages, {rnd('avg(salience)', 3)} avg_salience from f join t on t.site = f.site and t.name = f.name and t.rn = 1 group by f.site, f.name, t.type having count(*) >= 2"""
Q["A15_entity_type_distribution"] = "select site, url, type, count(*) entities from entities group by grouping sets ((site, url, type), (site, type))"
Q["A15_entity_type_matrix"] = "select site, url, " + ", ".join(f"count(*) filter (type = '{t}') as \"{t}\"" for t in ("PERSON", "LOCATION", "ORGANIZATION", "OTHER", "CONSUMER_GOOD")) + " from entities group by site, url"
DEPTH = f"""(select *, case when score >= 70 then 'Rico' when score >= 50 then 'Moderado' when score >= 30 then 'Raso' else 'Muito raso' end grade from (
  select *, (case when n_categories > 0 then 40 else 0 end + least(35, floor(round(mean_salience * 350, 6))) + least(25, n_entities * 3))::int score from (
  select t.site, t.url, coalesce(e.n, 0) n_entities, coalesce(e.p, 0) n_person, coalesce(e.m, 0.0) mean_salience, coalesce(c.n, 0) n_categories from texts t
  left join (select site, url, count(*) n, avg(salience) m, count(*) filter (type = 'PERSON') p from entities group by all) e using (site, url) left join (select site, url, count(*) n from categories group by all) c using (site, url))))"""
Q["A16_depth_score"] = f"select site, url, n_entities, n_categories, score, grade from {DEPTH}"
Q["A17_entity_recommendations"] = f"""select site, url, score, grade, case when a = '' then 'bem_estruturado' else a end advice from (select *, concat_ws(',', case when n_categories = 0 then 'sem_categoria' end, case when n_entities > 0 and n_person / n_entities > 0.35 then 'muitas_pessoas' end,
  case when n_entities > 0 and mean_salience < 0.04 then 'saliencia_baixa' end, case when n_entities > 0 and n_entities < 4 then 'poucas_entidades' end, case when n_entities = 0 then 'nenhuma_entidade' end, case when score < 50 and n_categories > 0 then 'aumentar_profundidade' end) a from {DEPTH})"""
Q["A18_entity_site_summary"] = f"""select d.*, t.type top_type, floor(t.c * 100 / t.n)::int top_type_percent from (select site, count(*) pages, count(*) filter (n_categories > 0) categorised, sum(n_entities)::bigint entities, {rnd('avg(score)', 1)} mean_depth,
  floor(count(*) filter (score >= 50) * 100 / count(*))::int rich_percent from {DEPTH} group by site) d left join (select site, type, count(*) c, sum(count(*)) over (partition by site) n, row_number() over (partition by site order by count(*) desc, type) rn from entities group by site, type) t on t.site = d.site and t.rn = 1"""
SIGNALS = f"""(select distinct t.site, t.url, coalesce(e.k, 0) entity_count, e.conc salience_concentration, coalesce(e.names, []) names, coalesce(e.n, 0) n_entities, coalesce(c.n, 0) > 0 classified from texts t
  left join (select site, url, count(distinct lower(name)) k, case when sum(salience) > 0 then {rnd('max(salience) / sum(salience)', 3)} end conc, list(lower(name) order by rank) filter (rank <= 5) names, count(*) n from entities group by site, url) e using (site, url)
  left join (select site, url, count(*) n from categories group by all) c using (site, url))"""
Q["A20_entity_signals"] = f"select site, url, entity_count, salience_concentration, array_to_string(names, ',') top_names, n_entities, classified from {SIGNALS}"
Q["A21_top_keywords"] = "select * from (select site, query, sum(impressions)::bigint impressions, row_number() over (partition by site order by sum(impressions) desc, query)::int as rank from query_page where position <= 10 group by site, query) where rank <= 10"
Q["A22_home_redirect_warning"] = f"""select site, count(*) filter (status = 'entry' and action = '301' and target like '%.example/') home_redirects, count(*) filter (status = 'entry' and action = '301' and target like '%.example/') > 3 warning from ({REVIEWED}) group by site"""
Q["A24_group_totals"] = """select site, count(*) groups, count(*) filter (size >= 2) multi_groups, count(*) filter (size < 2) single_groups, sum(size)::bigint pages, coalesce(sum(group_clicks) filter (size >= 2), 0)::bigint clicks, coalesce(sum(group_impressions) filter (size >= 2), 0)::bigint impressions from perf group by site"""
HOME = f"(select site, coalesce(arg_min(url, pos) filter ({is_home('url')}), regexp_extract(arg_min(url, pos), '^[a-z]+://[^/]+') || '/') home_url from sitemap group by site)"
PRUNE = f"""(select o.site, o.url, o.clicks, o.impressions, o.ctr, o.position, o.origin, case when clicks > 0 or impressions >= 10 then 'revisar' else '410' end as action, coalesce(t.top_queries, '') top_queries,
  coalesce(kq.sitemap_url, q.target, s.target, case when clicks > 0 or impressions >= 10 then home_url end) suggested_target,
  case when q.target is not null then 'query compartilhada' when s.target is not null then 'slug semelhante' when (clicks > 0 or impressions >= 10) and home_url is not null then 'home (fallback)' end target_source
  from olds o left join {BY_QUERY} q on q.site = o.site and q.match_key = o.match_key left join sitemap_keys kq on kq.site = q.site and kq.match_key = {match_key('q.target')}
  left join {BY_SLUG} s on s.site = o.site and s.url = o.url left join {TOPQ('olds')} t on t.site = o.site and t.match_key = o.match_key left join {HOME} h on h.site = o.site)"""
Q["G05_pruning_plan"] = f"select * from {PRUNE}"
Q["K06_pruning_csv"] = f"""select site, url, action acao_final, coalesce(suggested_target, '') destino_final, origin origem, impressions impressoes, clicks cliques, coalesce(replace(printf('%.1f', position), '.', ','), '') posicao, coalesce(target_source, '') fonte_sugestao,
  replace(top_queries, '|', ' | ') top_queries from {PRUNE}"""
Q["A25_pruning_totals"] = f"select site, count(*) total, count(*) filter (action = 'revisar') total_review, count(*) filter (action = '410') total_410 from {PRUNE} group by site"

# ---- content verdicts ----
STOP = sql_list(SLUG_STOPWORDS)
GRAMS = f"""(with ft as (select url, regexp_extract_all({folded('lower(text)')}, '[\\p{{L}}\\p{{N}}_]+') w from texts), p as (select url, w, unnest(range(1, len(w))) i from ft),
  g as (select url, 2 n, w[i:i+1] g from p union all select url, 3, w[i:i+2] from p where i + 2 <= len(w)),
  c as (select url, n, array_to_string(g, ' ') phrase, count(*) cnt from g where g[1] not in {STOP} and g[-1] not in {STOP} and len(list_filter(g, lambda x: not regexp_full_match(x, '\\p{{Nd}}+'))) > 0 group by url, n, g having count(*) >= 4)
  select url, phrase, cnt, n from (select *, row_number() over (partition by url order by cnt * n desc, n desc, cnt desc, phrase collate "binary" desc) rn from c) where rn = 1)"""
GRAMS = GRAMS.replace(' collate "binary"', "")
Q["W06_dominant_ngram"] = f"select url, phrase, cnt::int occurrences from {GRAMS}"
NW = "[^\\p{L}\\p{N}_]"
OCC = lambda text, ph: f"len(regexp_extract_all(regexp_replace({text}, '({NW})', '\\1\\1', 'g'), '(?s)(?:^|{NW})' || replace({ph}, ' ', '  ') || '(?:{NW}|$)'))"
VERDICT = f"""(with base as (select t.site, t.url, text, tok, len(tok) wc, coalesce(k.kws, []) kws, t.sp, g.phrase gp, g.cnt gc, g.n gn, s.entity_count, s.salience_concentration, s.names, s.n_entities, s.classified
    from (select *, {PHRASE} sp from texts) t left join {KW} k on k.site = t.site and k.url = t.url left join {GRAMS} g on g.url = t.url join {SIGNALS} s on s.site = t.site and s.url = t.url),
  cand as (select url, i as pri, kw, 'query' src, {OCC('lower(text)', 'kw')} occ, len(string_split(kw, ' ')) n, wc from (select url, text, wc, unnest(kws) kw, generate_subscripts(kws, 1) i from base)
    union all select url, 100, sp, 'slug', {OCC(folded('lower(text)'), folded('sp'))}, len(string_split(sp, ' ')), len(regexp_extract_all({folded('lower(text)')}, '[\\p{{L}}\\p{{N}}_]+')) from base where sp is not null
    union all select url, 200, gp, 'ngram', gc, gn, wc from base where gp is not null),
  best as (select * from (select url, kw, src, occ, {rnd('occ * n / wc * 100.0', 2)} d, row_number() over (partition by url order by {rnd('occ * n / wc * 100.0', 2)} desc, pri) rn from cand where wc > 0) where rn = 1 and d > 0),
  m as (select b.*, coalesce(x.d, 0.0) d, x.kw dk, x.src ds, coalesce(x.occ, 0) docc, case when len(kws) > 0 then {OCC('lower(text)', 'kws[1]')} else 0 end er, case when wc = 0 then 0.0 else {rnd('len(list_distinct(tok)) / wc', 3)} end div,
    case when n_entities > 0 and len(kws) > 0 then len(list_filter(kws, lambda k: len(list_filter(names, lambda e: contains(e, lower(k)) or contains(lower(k), e))) > 0)) > 0 end sal from base b left join best x on x.url = b.url),
  f as (select *, list_filter([case when wc < 300 then 'conteudo_curto' end, case when d >= 5 then 'densidade_muito_alta' when d >= 3 then 'densidade_alta' end, case when er >= 8 then 'repeticao_exata_alta' end, case when wc > 0 and div < 0.35 then 'vocabulario_repetitivo' end,
    case when salience_concentration >= 0.55 then 'saliencia_concentrada' end, case when entity_count < 4 and n_entities > 0 then 'amplitude_pobre' end, case when not classified then 'nao_classificavel' end, case when not sal then 'keyword_nao_saliente' end], lambda x: x is not null) flags from m),
  o as (select *, len(list_filter(flags, lambda x: x in ('conteudo_curto', 'amplitude_pobre', 'nao_classificavel'))) thin, len(list_filter(flags, lambda x: x not in ('conteudo_curto', 'amplitude_pobre', 'nao_classificavel'))) ov from f)
  select site, url, wc::int word_count, d keyword_density, dk densest_keyword, ds density_source, docc::int keyword_occurrences, er::int exact_repetitions, div vocab_diversity, entity_count, salience_concentration, sal target_in_salient, classified, array_to_string(flags, ',') flags,
  case when wc < 180 or thin >= 2 then 'raso' when ov >= 2 then 'over_otimizado' when ov >= 1 or thin >= 1 then 'atencao' else 'ok' end verdict from o)"""
Q["A23_content_verdict"] = f"select * from {VERDICT}"
Q["L06_verdict_listing"] = f"""select site, url, verdict, list_position(['raso', 'over_otimizado', 'atencao', 'ok'], verdict)::bigint verdict_rank, word_count, keyword_density, densest_keyword, density_source, vocab_diversity from {VERDICT}"""
J16 = f"select p.site, date '2024-01-28' date, p.url, p.position, p.clicks, p.impressions, v.verdict, v.word_count::bigint words, v.keyword_density density from position_rows p left join {VERDICT} v on v.site = p.site and v.url = p.url where has_data"
Q["J16_content_x_history"] = J16
K03 = f"""(select site, date, (date - 27)::date period_start, date period_end, url, position, clicks, impressions, case when has_content then verdict end verdict from history h where not (date = date '2001-03-01' and site in (select site from position_rows where has_data))
  union all select site, date '2001-03-01', date '2001-02-02', date '2001-03-01', url, position, clicks, impressions, verdict from ({J16}))"""
Q["K03_history_upsert"] = f"select * from {K03} k where date in (select date from (select site, date, row_number() over (partition by site order by date desc) rn from (select distinct site, date from {K03})) d where d.rn <= 30 and d.site = k.site)"
RUN = f"""(select s.site, case when p.site is not null then 'OK' else 'ERRO' end status, case when p.site is null then 'sem URLs no sitemap' end error, total_urls, urls_with_data, h.score health_score, h.grade health_grade, avg_position, avg_ctr ctr,
  case when p.site is not null then coalesce(n.n, 0) end snapshots, case when p.site is not null then coalesce(c.n, 0) end cannibalization_groups, case when p.site is not null then coalesce(raso, 0) end raso, case when p.site is not null then coalesce(over_otimizado, 0) end over_otimizado,
  case when p.site is not null then coalesce(atencao, 0) end atencao, case when p.site is not null then coalesce(ok, 0) end ok from (select distinct site from position_rows union all select 'fora-' || lower(r_name) from region) s
  left join {SUMMARY} p on p.site = s.site left join {HEALTH} h on h.site = s.site left join (select site, count(*) n from cann group by site) c on c.site = s.site left join (select site, count(distinct date) n from history group by site) n on n.site = s.site
  left join (select site, count(*) filter (verdict = 'raso') raso, count(*) filter (verdict = 'over_otimizado') over_otimizado, count(*) filter (verdict = 'atencao') atencao, count(*) filter (verdict = 'ok') ok from {VERDICT} group by site) v on v.site = s.site)"""
Q["A19_site_run_summary"] = f"select * from {RUN}"
Q["K09_portfolio_csv"] = f"""select site "Site", status "Status", health_score "Health", health_grade "Grade", avg_position "Posicao_Media", ctr "CTR", cannibalization_groups "Grupos_Canibalizacao", ok "Conteudo_OK", atencao "Conteudo_Atencao", over_otimizado "Conteudo_Over", raso "Conteudo_Raso", snapshots "Snapshots", coalesce(error, '') "Erro" from {RUN}"""

# ---- history ----
Q["W04_content_tracking"] = f"""select site, url, snapshots, f.d first_date, l.d last_date, f.p first_position, l.p last_position, case when snapshots >= 2 then {rnd('f.p - l.p', 1)} end position_delta, f.v first_verdict, l.v last_verdict, l.n last_density, l.w last_words from (
  select site, url, count(*) snapshots, arg_min({{'d': date, 'p': position, 'v': verdict}}, date) f, arg_max({{'d': date, 'p': position, 'v': verdict, 'n': density, 'w': words}}, date) l from history where has_content group by site, url)"""
Q["W04_content_snapshots"] = "select site, count(distinct date) content_snapshots from history where has_content group by site"
LAST8 = "(select site, date, row_number() over (partition by site order by date) slot from (select *, row_number() over (partition by site order by date desc) age from (select distinct site, date from history)) where age <= 8)"
Q["W05_history_pivot"] = "select *, case when first_position is null then 's/d' when abs(delta) < 2 then '→' when delta > 0 then '↑' else '↓' end trend from (select site, url, " + ", ".join(f"max(position) filter (slot = {k}) d{k}" for k in range(1, 9)) + f""",
  arg_min(position, slot) filter (position is not null) first_position, arg_max(position, slot) filter (position is not null) last_position, {rnd('(arg_min(position, slot) filter (position is not null)) - (arg_max(position, slot) filter (position is not null))', 1)} delta
  from history join {LAST8} using (site, date) group by site, url)"""
Q["W07_history_top_series"] = f"""with t as (select * from (select site, url, row_number() over (partition by site order by sum(impressions) desc, url)::int as rank from history join {LAST8} using (site, date) group by site, url) where rank <= 8)
  select t.site, t.rank, t.url, d.date, h.position from t join {LAST8} d on d.site = t.site left join history h on h.site = t.site and h.url = t.url and h.date = d.date"""

# ---- ordering and sets ----
Q["L01_nearest_pairs"] = f"""select * from (select x.site, least(x.page, y.page) a, greatest(x.page, y.page) b, {rnd('list_cosine_similarity(x.vec::double[], y.vec::double[])', 3)} sim,
  row_number() over (partition by x.site order by {rnd('list_cosine_similarity(x.vec::double[], y.vec::double[])', 3)} desc, least(x.page, y.page), greatest(x.page, y.page))::int as rank from vectors x join vectors y on x.site = y.site and x.page < y.page) where rank <= 15"""
Q["L02_group_priority"] = "select * from priority"
Q["L03_opportunity_ranking"] = f"select site, url, position, clicks, impressions, ctr, {band('position', 'band')} band, {rnd(expected_ctr('position'), 4)} expected_ctr, score, {LEVEL} as level from {SCORED.replace('query_page', 'position_rows')} where has_data and position <= 10"
Q["L04_band_listing"] = f"select site, url, position, clicks, impressions, ctr, {band('position', 'rank')} band_rank, {band('position', 'band')} band, {band('position', 'action')} as action from position_rows"
Q["L05_group_listing"] = "select site, case when url = best_url then query end keyword, query, url, position, clicks, impressions, severity, severity_score, url_count from cann_members"
Q["U01_ghosts_union_exports"] = "select site, url, match_key, clicks, impressions, ctr, position, origin from olds"
Q["U02_sitemap_union_distinct"] = "select site, url, (min((d, n)))[1]::int doc, (min((d, n)))[2]::bigint pos from (select site, url, 0 d, pos n from sitemap union all select site, url, 1, impressions from page_metrics) group by site, url"
Q["U02_sitemap_union_distinct"] = "select site, url, d::int doc, n::bigint pos from (select *, row_number() over (partition by site, url order by d, n) rn from (select site, url, 0 d, pos n from sitemap union all select site, url, 1, impressions from page_metrics)) where rn = 1"

# ---- graph ----
Q["G01_threshold_components"] = "select site, page, cluster from clusters"
def linkage(score):
    """Merging one pair of clusters at a time, the most similar first, as lists of pages within each threshold component; copies start merged."""
    return f"""with recursive g as (select site, cluster, map(list(a || '|' || b), list(sim)) sims from cpairs group by all),
  s as (select c.site, c.cluster, list(v.page order by v.page) pages from clusters c join vectors v on v.site = c.site and v.page = c.page group by c.site, c.cluster, v.vec),
  m(site, cluster, sims, parts, n) as (
    select g.site, g.cluster, sims, p, 0 from g join (select site, cluster, list(pages order by pages[1]) p from s group by all) using (site, cluster)
    union all select site, cluster, sims, list_append(list_filter(parts, lambda x: x[1] <> best.lo and x[1] <> best.hi), list_sort(list_concat(list_filter(parts, lambda x: x[1] = best.lo)[1], list_filter(parts, lambda x: x[1] = best.hi)[1]))), n + 1
    from (select *, list_sort(list_filter(flatten(list_transform(parts, lambda x: list_transform(list_filter(parts, lambda y: y[1] > x[1]), lambda y: {{'s': -{score}, 'lo': x[1], 'hi': y[1]}}))), lambda c: c.s < -0.40))[1] best from m) where best is not null)
  select site, unnest(part) page, part[1] as cluster from (select site, unnest(parts) part from (select *, row_number() over (partition by site, cluster order by n desc) r from m) where r = 1)"""


ACROSS = "flatten(list_transform(x, lambda p: list_transform(y, lambda q: sims[p || '|' || q])))"
Q["G02_linkage_clusters"] = linkage(f"list_min({ACROSS})")
Q["G02_average_linkage"] = linkage(f"list_avg({ACROSS})")
Q["G03_build_clusters"] = "select c.site, c.cluster, c.size, c.cohesion, r.representative from cohesion c join repr r using (site, cluster)"

# ---- text features ----
Q["M01_tfidf_vectors"] = f"""with w as (select site, page, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') w from texts), p as (select site, page, w, unnest(range(1, len(w) + 1)) i from w),
  tf as (select site, page, term, count(*) tf from (select site, page, w[i] term from p union all select site, page, w[i] || ' ' || w[i+1] from p where i < len(w)) group by all),
  n as (select site, count(*) docs from texts group by site), v as (select * from (select site, term, count(*) df, row_number() over (partition by site order by sum(tf) desc, term) rn from tf group by site, term) where rn <= 8192),
  x as (select tf.site, page, tf.term, tf * (ln((1 + docs) / (1 + df)) + 1) x from tf join v on v.site = tf.site and v.term = tf.term join n on n.site = tf.site)
  select site, page, term, {rnd('x / sqrt(sum(x * x) over (partition by site, page))', 6)} weight from x"""
# word vectors with their exact weights; of equal ones (to six decimals) the smallest page stands for all
TEXT_VECTORS = Q["M01_tfidf_vectors"].replace(rnd("x / sqrt(sum(x * x) over (partition by site, page))", 6), "x / sqrt(sum(x * x) over (partition by site, page))")
TEXT_PAIRS = f"""same as (select site, page, min(page) over (partition by site, v) same_as from (select site, page, list((term, round(weight, 6)) order by term) v from wv group by all)),
  rv as (select wv.* from wv join same s on s.site = wv.site and s.page = wv.page and s.page = same_as),
  tp as (select x.site, x.page a, y.page b, sum(x.weight * y.weight) sim from rv x join rv y on x.site = y.site and x.term = y.term and x.page < y.page group by all having sim >= 0.55)"""
Q["J19_sparse_pairs"] = f"with wv as ({TEXT_VECTORS}), {TEXT_PAIRS} select site, a, b, {rnd('sim', 6)} sim from tp"
Q["G01_text_components"] = f"""with recursive wv as ({TEXT_VECTORS}), {TEXT_PAIRS}, e as (select site, a, b from tp union select site, same_as, page from same where page <> same_as), be as (from e union select site, b, a from e),
  r as (select site, page, page c from texts union select r.site, be.b, r.c from r join be on be.site = r.site and be.a = r.page)
  select site, page, min(c) as cluster from r group by site, page"""
Q["M02_incremental_embeddings"] = f"""select site, page, {HASH} hash, l.doc_id is not null reused, case when l.doc_id is not null then 0.0 else 1.0 end::double v1, length(text)::double v2 from texts t left join (select distinct doc_id from labels) l on l.doc_id = t.doc_id"""
PARTS = lambda n: f"""(select site, cluster, string_agg('--- PÁGINA ' || i || ' (slug: ' || page || ') [posição ' || coalesce(printf('%.1f', position), 's/d') || ', ' || clicks || ' cliques, ' || impressions || ' impressões] ---' || chr(10) || coalesce(text, '')[1:{n}], chr(10) || chr(10) order by i) blocks,
  min(page) filter (i = 1) best, count(*) shown from (select e.*, t.text, row_number() over (partition by e.site, e.cluster order by clicks desc, impressions desc, coalesce(position, 9999), e.page) i from enriched e left join texts t on t.page = e.page) where i <= 6 group by site, cluster)"""  # noqa: E731
TAIL = "case when size > shown then chr(10) || chr(10) || '(+' || (size - shown) || ' páginas omitidas)' else '' end"
Q["M03_judgement_prompts"] = f"select p.site, p.cluster, rank, size, size - shown omitted, '{JUDGE_TASK}' as system, size || ' páginas similares' || chr(10) || chr(10) || blocks || {TAIL} prompt from priority p join {PARTS(1500)} b using (site, cluster)"
Q["M05_differentiation_prompts"] = f"select p.site, p.cluster, rank, size, size - shown omitted, best, '{DIFF_TASK}' as system, size || ' páginas competem' || chr(10) || 'Melhor desempenho: ' || best || chr(10) || chr(10) || blocks || {TAIL} prompt from priority p join {PARTS(1200)} b using (site, cluster)"
Q["M04_judgements"] = """select 'all' site, doc_id::varchar as cluster, case when k < 2 then case when n_chars < 1000 then 'raso' else 'ok' end else '?' end verdict, case when k < 2 then 'p' || doc_id else '' end base_page,
  case k when 0 then 'a,}|' || source when 1 then 'a}|' || source else '' end gaps, case k when 2 then 'sem objeto ' || lang when 3 then (obj || ' e depois } nada')[1:200] else 'r ' || lang end summary, k < 2 raw_ok from (
  select *, n_chars % 4 k, '{"verdict": "' || case when n_chars < 1000 then 'raso' else 'ok' end || '", "base_recomendada": "p' || doc_id || '", "lacunas": ["a,}", "' || source || '"], "resumo": "r ' || lang || '"' obj from documents)"""
RANKED = "(select e.*, row_number() over (partition by e.site, e.cluster order by clicks desc, impressions desc, coalesce(position, 9999), e.page) i from enriched e join priority p using (site, cluster))"
Q["M06_omitted_pages"] = f"select site, cluster, page from {RANKED} where i > 3"
Q["M06_differentiation_plan"] = f"""select site, cluster, (max(page) filter (i = 1) over (partition by site, cluster)) head, (i - 1)::int pos, page slug, 'spoke' as role, '' intent, replace(page, '-', ' ') keyword, '' title, '' focus from {RANKED} where i <= 6"""
PLAN = f"({Q['M06_differentiation_plan']})"
Q["M06_keyword_items"] = f"select p.site, p.cluster, slug, keyword, f.group_impressions impressions, {norm_kw('keyword')} norm from {PLAN} p join perf f on f.site = p.site and f.cluster = p.cluster where {norm_kw('keyword')} <> ''"
Q["J11_hub_choice"] = f"""with p as {PLAN} select site, cluster, head hub, (select replace(head, '-', ' ')) hub_keyword, slug spoke, keyword from p where slug <> head
  union all select c.site, c.cluster, f.canonical, '', c.page, '' from clusters c join perf f on f.site = c.site and f.cluster = c.cluster where f.size >= 2 and c.page <> f.canonical and not exists (select 1 from p where p.site = c.site and p.cluster = c.cluster)"""
Q["J12_list_emitters"] = """select 'all' site, page_id::varchar src, list, mode from pages join (values (0, 'blog', 'index'), (1, 'artigos', 'widget'), (2, 'artigos', 'widget'), (3, 'blog', 'widget'), (3, 'artigos', 'widget'),
  (5, 'blog', 'index'), (5, 'artigos', 'widget')) t(k, list, mode) on k = page_id % 6"""
Q["D01_per_site_function"] = f"select site, case when site = 's3' then 'ERRO' else 'OK' end status, case when site = 's3' then 'site unavailable' end error, case when site <> 's3' then {rnd('total_clicks / total_urls', 3)} end clicks_per_url from {SUMMARY}"
Q["D02_scorer_plugin"] = """select site, cluster, case when least(size, 6) > 5 then '' else '{"verdict": "' || case when size > 2 then 'spun' else 'ok' end || '", "base_recomendada": "", "lacunas": ["' || size || '"], "resumo": "x"}' end reply, case when least(size, 6) > 5 then 'too many pages' end error from priority"""

# ---- plans that walk groups in order: a fold over the ordered groups of a site ----
HEAD = "list_filter(x.urls, lambda u: not list_contains(a.red, u))[1]"
LEAVE = f"list_filter(x.urls, lambda u: {HEAD} is not null and u <> {HEAD} and not list_contains(a.red, u) and not list_contains(a.canon, u))"
CLASH = f"""case when {HEAD} is null then [{{'u': null::varchar, 'h': null::varchar, 'q': x.q, 'kind': 'grupo_ignorado'}}] else list_transform(list_filter(x.urls, lambda u: u <> {HEAD} and (list_contains(a.canon, u) or
  (list_contains(a.red, u) and a.dest[list_position(a.red, u)] <> {HEAD}))), lambda u: {{'u': u, 'h': case when list_contains(a.canon, u) then null else a.dest[list_position(a.red, u)] end, 'q': x.q,
  'kind': case when list_contains(a.canon, u) then 'canonica_de_outro_grupo' else 'destino_mantido' end}}) end"""
EMPTY = "'red': []::varchar[], 'dest': []::varchar[], 'by': []::varchar[], 'canon': []::varchar[], 'clash': []::struct(u varchar, h varchar, q varchar, kind varchar)[]"
WALK = f"""(select site, list_reduce(list_prepend({{'q': '', 'urls': []::varchar[], {EMPTY}}}, gs), lambda a, x: {{'q': x.q, 'urls': x.urls, 'red': list_concat(a.red, {LEAVE}), 'dest': list_concat(a.dest, list_transform({LEAVE}, lambda u: {HEAD})),
  'by': list_concat(a.by, list_transform({LEAVE}, lambda u: x.q)), 'canon': case when len({LEAVE}) > 0 and not list_contains(a.canon, {HEAD}) then list_append(a.canon, {HEAD}) else a.canon end, 'clash': list_concat(a.clash, {CLASH})}}) w from (
  select site, list({{'q': query, 'urls': urls, {EMPTY}}} order by severity_score desc, url_count desc, query) gs from (
  select site, query, severity_score, url_count, list(url order by clicks desc, position, impressions desc, url) urls from cann_members group by site, query, severity_score, url_count) group by site))"""
MOVES = f"""(select m.site, m.u from_url, m.h to_url, m.q keyword, f.severity, f.clicks clicks_from, t.clicks clicks_to from (select site, unnest(w.red) u, unnest(w.dest) h, unnest(w.by) q from {WALK}) m
  join cann_members f on f.site = m.site and f.query = m.q and f.url = m.u join cann_members t on t.site = m.site and t.query = m.q and t.url = m.h)"""
Q["G04_consolidation_plan"] = f"select * from {MOVES}"
Q["G04_consolidation_conflicts"] = f"select site, c.q keyword, c.u url, c.kind as conflict, c.h kept_target from (select site, unnest(w.clash) c from {WALK})"
Q["G04_consolidation_totals"] = f"select site, count(distinct keyword) total_groups, count(*) total_redirects from {MOVES} group by site"
Q["K05_redirect_csv"] = f"select * from {MOVES}"
FROM_PATH = f"case when {path('from_url')} = '' then '/' else {path('from_url')} end"
Q["K07_redirect_rules"] = f"""select site, from_url, '# keyword: ' || keyword || '  (severidade ' || strip_accents(severity) || ')' as comment, format, case when format = 'nginx' then 'location = ' || {FROM_PATH} || ' {{ return 301 ' || to_url || '; }}'
  else 'Redirect 301 ' || {FROM_PATH} || ' ' || to_url end rule from {MOVES}, (values ('htaccess'), ('nginx')) f(format)"""
NEARWALK = f"""(with x as (select * from items where (site, norm) not in (select (site, norm) from items group by site, norm having count(*) >= 2 and count(distinct slug) >= 2)),
  s as (select site, tokens, min((cluster, slug, keyword)) o from x where len(tokens) >= 2 group by site, tokens),
  n as (select a.site, a.tokens, a.o, list(array_to_string(b.tokens, ' ')) filter (b.tokens is not null) later from s a left join s b on b.site = a.site and b.o > a.o
    and (list_has_all(a.tokens, b.tokens) or list_has_all(b.tokens, a.tokens) or len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) >= 0.7) group by a.site, a.tokens, a.o),
  w as (select site, list_reduce(list_prepend({{'t': '', 'later': []::varchar[], 'taken': []::varchar[], 'seed': []::varchar[]}}, list({{'t': array_to_string(tokens, ' '), 'later': coalesce(later, []::varchar[]), 'taken': []::varchar[], 'seed': []::varchar[]}} order by o)),
    lambda a, x: case when list_contains(a.taken, x.t) then {{'t': x.t, 'later': x.later, 'taken': a.taken, 'seed': a.seed}} else {{'t': x.t, 'later': x.later, 'taken': list_concat(a.taken, list_filter(x.later, lambda l: not list_contains(a.taken, l))),
    'seed': list_concat(a.seed, list_transform(list_filter(x.later, lambda l: not list_contains(a.taken, l)), lambda l: x.t))}} end) r from n group by site),
  m as (select site, unnest(r.taken) t, unnest(r.seed) seed from w), g as (select x.*, coalesce(m.seed, array_to_string(x.tokens, ' ')) seed, (-impressions, cluster, slug, keyword) o from x left join m on m.site = x.site and m.t = array_to_string(x.tokens, ' ') where len(x.tokens) >= 2)
  select site, 'parecida' kind, arg_min(keyword, o) keyword, arg_min(cluster, o) owner_cluster, arg_min(slug, o) owner_slug, count(*) n, sum(impressions)::bigint impr_total, count(distinct cluster) >= 2 cross_cluster from g group by site, seed having count(*) >= 2 and count(distinct slug) >= 2)"""
Q["J13_keyword_near_match"] = f"select * from {NEARWALK}"

Q["S05_sitemap_files"] = Q["S05_sitemap_urls"]
NOTICE = "# SUGESTAO: exige revisao humana antes de aplicar"
CONFLICTS = f"({Q['G04_consolidation_conflicts']})"
Q["K05_redirect_csv_lines"] = f"""with l as (select site, 2 part, concat_ws(',', from_url, to_url, keyword, severity, clicks_from, clicks_to) line from {MOVES} union all
  select site, 3, '# conflito: grupo "' || keyword || '": ' || case conflict when 'grupo_ignorado' then 'todas as URLs ja possuem redirect em grupos de maior severidade'
    when 'canonica_de_outro_grupo' then url || ' e canonica de outro grupo' else url || ' ja redireciona para ' || kept_target end from {CONFLICTS}), s as (select distinct site from l)
  select site, part::int part, line from l union all select site, 0, '{NOTICE}' from s union all select site, 1, 'from_url,to_url,keyword,severity,clicks_from,clicks_to' from s"""
Q["K07_rule_files"] = f"""with r as (select k.*, m.keyword, c.severity_score, c.url_count, c.clicks, c.position, c.impressions from ({Q["K07_redirect_rules"]}) k join {MOVES} m on m.site = k.site and m.from_url = k.from_url
  join cann_members c on c.site = m.site and c.query = m.keyword and c.url = m.from_url),
  l as (select site, format, unnest([{{'k': 0, 'line': comment}}, {{'k': 1, 'line': rule}}], recursive := true), row_number() over (partition by site, format order by severity_score desc, url_count desc, keyword, clicks desc, position, impressions desc, from_url) i from r)
  select site, format, (2 * i - 1 + k)::int n, line from l union all select distinct site, format, 0, '{NOTICE}' from r"""
Q["D01_site_tables"] = """with t as (select site, count(*) urls, sum(clicks)::bigint clicks, arg_min(url, (-clicks, url)) best_url from page_metrics group by site union all select 'novo-1', 0, 0, null)
  select site, case when site = 's3' then 'ERRO' else 'OK' end status, case when site = 's3' then 'site unavailable' end error, case when site <> 's3' then urls end urls,
  case when site <> 's3' then clicks end clicks, case when site <> 's3' then best_url end best_url from t"""

SQL = {name: with_ctes(f"select * from ({q})" if q.startswith("with") else q) for name, q in Q.items()}
