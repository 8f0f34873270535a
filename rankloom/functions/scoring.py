"""Scoring expressions over position, ctr and impressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.wordlists import CTR_BENCHMARK, NO_DATA_BAND, POSITION_BANDS, VERDICT_CATEGORY


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def expected_ctr(position) -> Column:
    """X15. Benchmark ctr in percent, linear between whole positions, null beyond ten."""
    whole = F.floor(position).cast("int")
    low = F.greatest(F.lit(1), F.least(whole, F.lit(10)))
    high = F.least(low + 1, F.lit(10))
    low_ctr, high_ctr = _lookup(CTR_BENCHMARK, low), _lookup(CTR_BENCHMARK, high)
    return F.when(position <= 10, low_ctr + (position - whole) * (high_ctr - low_ctr))


def opportunity_score(impressions, ctr, position) -> Column:
    """X16. Clicks lost against the benchmark."""
    gap = F.greatest(F.lit(0.0), expected_ctr(position) - ctr)
    return F.coalesce(F.round(impressions * gap / 100, 1), F.lit(0.0))


def opportunity_band(score) -> Column:
    return F.when(score >= 50, "high").when(score >= 10, "medium").otherwise("low")


def _band(position, pick) -> Column:
    out = F.when(position.isNull(), F.lit(pick(NO_DATA_BAND)))
    for bound, *band in POSITION_BANDS:
        out = out.otherwise(F.lit(pick(band))) if bound is None else out.when(position <= bound, F.lit(pick(band)))
    return out


def band_rank(position) -> Column:
    return _band(position, lambda b: b[0])


def band_label(position) -> Column:
    """X17."""
    return _band(position, lambda b: b[1])


def band_action(position) -> Column:
    return _band(position, lambda b: b[2])


def verdict_category(verdict) -> Column:
    """X22."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VERDICT_CATEGORY.items() for x in kv]), verdict), F.lit("unknown"))


def is_fresh(cached_at, as_of, ttl_hours) -> Column:
    """X25."""
    return F.coalesce(cached_at >= as_of - F.make_dt_interval(F.lit(0), ttl_hours), F.lit(False))
