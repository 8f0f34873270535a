"""Quality rules (operator 2): rules of single documents, and verdicts on hosts from shrunken failure rates.

The document rules need no shuffle: windows are hashed and compared within a row. Hosts then get a failure rate for every rule, drawn
towards a beta prior that the hosts themselves give for that rule (empirical Bayes, by moments weighted by documents), so a host with few documents is
judged by the others. A host fails when one of its rates stands out against that rule's mean, two posterior deviations taken off; the verdict is joined back to the documents' small rows, never to their texts. ``documents`` has no URL, so its
``source`` is the host.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut
from rankloom.llm.common import SPACES, WORD

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document has too many symbols above this many for 100 words, too many repeated lines above this percentage of its lines.
MAX_SYMBOL_PERCENT = 10
MAX_LINE_PERCENT = 30
#: A host fails by a rule when its shrunken rate, less this many deviations, is over this multiple of the mean and over this share of its documents.
HOST_DEVIATIONS = 2.0
HOST_MULTIPLE = 3.0
HOST_FLOOR = 0.2
#: The prior weighs as much as this many documents at least.
MIN_STRENGTH = 2.0
RULES = ("short", "repeats", "symbols", "lines")


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of every row; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), text.alias("text"))
    core = F.btrim(F.col("text"), F.lit(BLANKS))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.select(
        "doc_id", "host", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACES)).alias("words"), lines.alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))))
    d = d.select(
        "doc_id", "host", "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    in_order = F.when(repeated, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", in_order.alias("o"))
    twice = F.filter("o", lambda x, k: (x["h"] == F.get("o", k + 1)["h"]) | ((k > 0) & (x["h"] == F.get("o", k - 1)["h"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1)))))
    d = d.withColumn("n_repeat_words", F.when(F.col("o").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("o")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def failures() -> dict[str, Column]:
    """Whether a document fails each rule; the first two make ``base_failed``."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > MAX_LINE_PERCENT * F.col("n_lines"),
    }


def shrunken_hosts(rules: DataFrame, multiple: float = HOST_MULTIPLE, floor: float = HOST_FLOOR) -> DataFrame:
    """(host, n_docs, rate_<rule> for every rule, host_failed): failure rates after shrinking towards each rule's beta prior.

    The prior's mean is the share of all documents; its variance that of the hosts' rates, less what chance gives hosts of their sizes. Where
    nothing is left, every host gets the mean. A rate is rounded to nine places before it is judged.
    """
    counts = [F.count_if(failed).alias(f"n_{name}") for name, failed in failures().items()]
    hosts = cut(rules.groupBy("host").agg(F.count("*").alias("n_docs"), *counts))
    sums = [F.sum(f"n_{r}").alias(f"n_{r}") for r in RULES] + [F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"sq_{r}") for r in RULES]
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), *sums).first()  # two numbers a rule
    rates, failed = {}, F.lit(False)
    for name in RULES:
        mean = total[f"n_{name}"] / total["docs"] if total["docs"] else 0.0
        spread = total[f"sq_{name}"] / total["docs"] - mean * mean - mean * (1 - mean) * (total["hosts"] - 1) / total["docs"] if total["docs"] else 0.0
        rate, deviation = F.lit(mean), F.lit(0.0)
        if spread > 1e-12:
            strength = max(mean * (1 - mean) / spread - 1, MIN_STRENGTH)
            rate = (F.col(f"n_{name}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
            deviation = F.sqrt(F.col(f"rate_{name}") * (1 - F.col(f"rate_{name}")) / (F.col("n_docs") + F.lit(strength + 1)))
        rates[f"rate_{name}"] = F.round(rate.cast("double"), 9)
        failed = failed | (F.col(f"rate_{name}") - HOST_DEVIATIONS * deviation > F.lit(max(floor, multiple * mean)))
    return hosts.select("host", "n_docs", *[c.alias(n) for n, c in rates.items()]).withColumn("host_failed", failed)


def host_quality_rules(docs: DataFrame, host: str = "source", multiple: float = HOST_MULTIPLE, floor: float = HOST_FLOOR) -> DataFrame:
    """Every row's rules with its host's verdict: kept when neither the document nor its host fails. A null host is a host; repeated
    rows count each; an empty table gives no rows. One host alone never stands out against the others, as there are none."""
    rules = cut(document_rules(docs, host))
    hosts = shrunken_hosts(rules, multiple, floor).withColumnRenamed("host", "h")
    joined = rules.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *[f"rate_{r}" for r in RULES], "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
