"""Fixed values that results depend on: stopwords, generic anchors, tables and labels."""

# Words without meaning in a URL slug or at the edge of an n-gram (Portuguese).
SLUG_STOPWORDS = frozenset(
    "a o as os um uma uns umas de da do das dos em no na nos nas e ou para pra por com sem sob sobre "
    "ao aos que se seu sua seus suas mais menos muito como qual onde quando".split()
)

# Words ignored when two target keywords are compared (Portuguese).
KEYWORD_STOPWORDS = frozenset(
    "de do da dos das o a os as um uma uns umas e ou com sem para pra por no na nos nas em que se ao aos the".split()
)

# Words ignored in search queries and entity names (Portuguese).
TERM_STOPWORDS = frozenset(
    "de do da dos das e em um uma uns umas para o a os as com no na nos nas que ou como por se mais muito mas "
    "qual quanto quanta quais quando onde quem pelo pela pelos pelas ao aos num numa dum duma este esta estes "
    "estas esse essa esses essas seu sua seus suas meu minha me eu tu ele ela eles elas foi ser ter tem vai vou "
    "ver são".split()
)

# Anchor texts that may point anywhere.
GENERIC_ANCHORS = (
    "clique aqui", "clique", "aqui", "saiba mais", "saiba", "leia mais", "leia", "veja mais", "veja", "ver mais",
    "ver", "mais", "continue lendo", "confira", "link", "este link", "acesse", "acesse aqui", "voltar", "home",
    "pagina inicial",
)

# Expected click-through rate in percent at positions 1 to 10.
CTR_BENCHMARK = {1: 28.5, 2: 15.7, 3: 11.0, 4: 8.0, 5: 7.2, 6: 5.1, 7: 4.0, 8: 3.2, 9: 2.8, 10: 2.5}

# Position bands (upper bound, rank, label, suggested action).
POSITION_BANDS = (
    (3, 1, "Top 3", "Proteger posição"),
    (10, 2, "1ª Página", "Otimizar title e meta description"),
    (20, 3, "2ª Página", "Fortalecer conteúdo e links internos"),
    (50, 4, "3ª Página", "Revisar e ampliar conteúdo"),
    (None, 5, "4ª+ Página", "Reestruturar ou consolidar página"),
)
NO_DATA_BAND = (6, "Sem Dados", "Sem impressões no período analisado")

# Health weights and grades.
HEALTH_WEIGHTS = {"indexation": 0.4, "position": 0.4, "ctr": 0.2}
HEALTH_GRADES = ((80, "Excelente"), (60, "Bom"), (40, "Regular"), (None, "Crítico"))

# Inspection verdict to category.
VERDICT_CATEGORY = {"PASS": "indexed", "FAIL": "not_indexed", "NEUTRAL": "warning", "VERDICT_UNSPECIFIED": "unknown"}
CATEGORIES = ("indexed", "not_indexed", "warning", "unknown")

# Content verdicts from worst to best.
VERDICT_ORDER = ("raso", "over_otimizado", "atencao", "ok")

# Entity types that say nothing about a topic.
SKIPPED_ENTITY_TYPES = ("NUMBER", "PRICE", "DATE", "ADDRESS", "PHONE_NUMBER")

# Fixed value: name of the whole-domain series.
SITE_SERIES = "Site (todo o domínio)"

# Hours a stored result stays fresh, by source.
TTL_HOURS = {"metrics": 72, "queries": 72, "text": 72, "inspection": 24, "trends": 24, "entity": 168}

# Where a dead URL became known.
ORIGIN_SEARCH, ORIGIN_EXPORT = "busca", "export-gsc"
