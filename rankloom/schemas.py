"""Table schemas shared by sources and operators. Every table is keyed by ``site``."""

from pyspark.sql import types as T


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, LONG, DBL, DATE, TS = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.DateType(),
    T.TimestampType(),
)

LANDING_PAGE = _s(
    ("site", STR), ("end_date", DATE), ("url", STR), ("clicks", DBL), ("impressions", DBL), ("ctr", DBL), ("position", DBL)
)
LANDING_QUERY = _s(
    ("site", STR), ("end_date", DATE), ("query", STR), ("url", STR),
    ("clicks", DBL), ("impressions", DBL), ("ctr", DBL), ("position", DBL),
)
CONTENT = _s(("verdict", STR), ("density", DBL), ("words", LONG), ("diversity", DBL), ("entities", LONG))
HISTORY = _s(
    ("site", STR), ("date", DATE), ("period_start", DATE), ("period_end", DATE), ("url", STR), ("position", DBL), ("clicks", LONG), ("impressions", LONG), ("content", CONTENT)
)
#: A landed snapshot row: ``run`` grows with every run of a site and date, and a later run replaces an earlier one whole.
LANDED = T.StructType([*HISTORY.fields, T.StructField("run", LONG, True)])
JUDGEMENT = _s(
    ("verdict", STR), ("base_recomendada", STR), ("lacunas", T.ArrayType(STR)), ("resumo", STR)
)
PLAN_PAGE = _s(
    ("slug", STR), ("papel", STR), ("intencao", STR), ("keyword_alvo", STR), ("titulo", STR), ("foco", STR)
)
DIFF_PLAN = _s(("cabeca", STR), ("paginas", T.ArrayType(PLAN_PAGE)))
