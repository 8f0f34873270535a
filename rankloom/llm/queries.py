"""The registered queries of the operators: name to a function of (spark, folder of tables); SQL where it can say the same."""

from pyspark.sql import functions as F

from rankloom.llm import byte_pairs, host_rules, jaccard_join, line_dedup, mixing, periodic_runs, preferences, quality, sharding, source_audit, sql, tag_paths, tiling
from rankloom.llm import token_stream as ts


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1(spark, folder):
    return tiling.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2(spark, folder):
    return host_rules.host_quality_rules(_table(spark, folder, "documents"))


def op3(spark, folder):
    return jaccard_join.similar_components(_table(spark, folder, "documents"))


def op4(spark, folder):
    out = line_dedup.dedup_lines(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op5(spark, folder):
    return tag_paths.extract(_table(spark, folder, "pages"))


def op6(spark, folder):
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7(spark, folder):
    return ts.token_stream(_table(spark, folder, "documents"))


def op8(spark, folder):
    mix = mixing.mix(mixing.sized(_table(spark, folder, "documents")))
    return mix.documents.select("doc_id", "source", "size", "source_size", "target", "taken", "times")


def op9(spark, folder):
    placed = sharding.assign_shards(_table(spark, folder, "documents"))
    return placed.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10(spark, folder):
    out = preferences.format_preferences(preferences.sibling_pairs(_table(spark, folder, "conversations")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",") for c in ("chosen_spans", "rejected_spans")}
    return out.withColumns(spans)


def op11(spark, folder):
    return periodic_runs.run_digests(_table(spark, folder, "documents"))


def op12(spark, folder):
    return source_audit.divergence(_table(spark, folder, "documents"))


def op13(spark, folder):
    return byte_pairs.round_trip_digests(_table(spark, folder, "documents"))


QUERIES = {
    "op1_greedy_string_tiling": op1,
    "op2_host_quality_rules": op2,
    "op3_ngram_jaccard_join": op3,
    "op4_line_dedup": op4,
    "op5_tag_path_ratios": op5,
    "op6_subword_quality": op6,
    "op7_token_stream": op7,
    "op8_fair_mix": op8,
    "op9_rendezvous_shards": op9,
    "op10_preference_pairs": op10,
    "op11_periodic_runs": op11,
    "op12_source_audit": op12,
    "op13_byte_pairs": op13,
}

SQL = {
    "op2_host_quality_rules": sql.OP2,
    "op3_ngram_jaccard_join": sql.OP3,
    "op4_line_dedup": sql.OP4,
    "op8_fair_mix": sql.OP8,
    "op9_rendezvous_shards": sql.OP9,
    "op10_preference_pairs": sql.OP10,
    "op12_source_audit": sql.OP12,
}
