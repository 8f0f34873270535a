"""Line dedup (operator 4): exact set-similarity join over lines, as column work.

A line's set is its distinct words in lower case, as hashes. Words are ordered by rarity: a sketch of 2^SKETCH_BITS counters over all lines
gives each word a count that is never too low, and count and hash together are one total order for all lines, which is all
that the prefix filter needs. With Jaccard >= 4/5 the first n - ceil(4n/5) + 1 words of two linked sets share one, one more share two: sets meet
on a rare word, or on a common word and another one after it. Pairs that pass the length, positional and parity filters are verified on the whole sets.

Texts are split and hashed once; the whole words are stored only until prefixes and parities are made, and looked up again for sets in a pair.
A key's earliest set is compared first: what it links is decided, so a group of k similar lines costs k pairs, and only sets
that are still open meet the others, at keys of more than two sets. Keys are taken in TURNS, and a stored table goes when nothing reads it any more.

Equal sets meet as one. Of linked sets the one that occurs first stays, and every occurrence of the others is removed, as are
later occurrences of a set. Occurrences are ordered by (doc_id, hash of the text, line number).
"""

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.lineage import cut, drop
from rankloom.llm.common import SPACES, free_name

#: Lines of fewer distinct words are never removed: only those without a word, which say nothing.
MIN_WORDS = 1
NUM, DEN = 4, 5
#: Smaller sets are linked with no different one: n of n + 1 words are too few.
LEAST_LINKED = -(-NUM // (DEN - NUM))
SKETCH_BITS = 18
#: A word whose class occurs more often is common: sets meet on it and another word, not on it alone.
RARE = 4096
#: Sets of more words have a parity of 128 classes of words, others of 64.
FEW_WORDS = 64
#: Keys meet in so many turns by the hash of their first word, so this share of their rows is on disk at a time.
TURNS = 3
MAP_BITS = 24
#: The place of a null doc_id.
NO_ID = -(1 << 63)


def _lines(docs: DataFrame) -> DataFrame:
    """(d, t, l, line) of every line: the place of doc_id, the hash of the text, the line number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(_place("doc_id").alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("l", "line"))


def _place(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID).cast("long"))


def _parts(line: str) -> Column:
    """The words of a line, with empty ones between two blanks."""
    low = F.lower(line)
    # a line of single blanks only is split without a pattern
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.when(other, F.split(low, SPACES)).otherwise(F.split(low, " "))


def _array(values: list, kind: str) -> Column:
    """A constant of bounded size for lookups by position."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def rarity(sets: DataFrame) -> list[int]:
    """2^SKETCH_BITS counters: how many words of the lines are of each hash class."""
    counts = sets.select(F.explode("words").alias("w")).select(F.col("w").bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int").alias("slot")).groupBy("slot").count()
    out = [0] * (1 << SKETCH_BITS)
    for r in counts.toLocalIterator():
        out[r["slot"]] = r["count"]
    return out


def _steps(counts: list[int]) -> list[int]:
    """A logarithmic step of each count, 0 to 32767."""
    top = max(1, max(counts))
    return [min(32767, int(32767 * (c.bit_length() - 1 + c / (1 << (c.bit_length() - 1)) - 1) / top.bit_length())) if c else 0 for c in counts]


def _order(counts: list[int]) -> Column:
    """A constant: for each hash class a logarithmic count, at the place above 48 bits of a hash."""
    return _array([s << 48 for s in _steps(counts)], "array<bigint>")


def _common(counts: list[int]) -> int:
    """Words as numbers from this one on are common: their step is that of more than RARE occurrences."""
    return min((s for s, c in zip(_steps(counts), counts) if c > RARE), default=1 << 15) << 48 if max(counts) > RARE else (1 << 63) - 1


def _words(line: str) -> Column:
    """A line's distinct words as hashes, in order."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(_parts(line), ""), lambda w: F.xxhash64(w))))


def _ranked(words: str, order: Column) -> Column:
    """The words with their rarity above 48 bits of their hash, rarest first."""
    return F.sort_array(F.transform(words, lambda h: F.get(order, h.bitwiseAND(F.lit((1 << SKETCH_BITS) - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 16))))


def _prefix(n: Column) -> Column:
    """How many of a set's first words hold one that it shares with any linked set; one more hold two."""
    return n - F.ceil(n * NUM / DEN).cast("int") + 1


def _parities(words: str) -> list[Column]:
    """Parities of 64 classes of words, and for sets of many words, of which 64 bits say little, those of each class's second half: sets that differ in
    k words differ in at most k classes."""
    def bits(first: Callable[[Column], Column]) -> Column:
        return F.aggregate(words, F.lit(0).cast("long"), lambda found, w: found.bitwiseXOR(F.call_function("shiftleft", first(w), w.bitwiseAND(F.lit(63)).cast("int"))))

    second = bits(lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1)))
    return [bits(lambda w: F.lit(1).cast("long")).alias("parity"), F.when(F.size(words) > FEW_WORDS, second).otherwise(0).alias("second")]


def _differ() -> Column:
    """In how many words the sets a and b differ at least."""
    whole, second = (F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in ("parity", "second"))
    halves = F.bit_count(whole.bitwiseXOR(second)) + F.bit_count(second)
    return F.when(F.least("n_a", "n_b") > FEW_WORDS, halves).otherwise(F.bit_count(whole))


def _keyed(firsts: DataFrame, common: int, turn: int) -> DataFrame:
    """(word, key, n, at, d, parity, second): the keys that linked sets share one of: a rare word of the prefix, or a common one with another word after it.

    Of the words that two sets which meet at a key share, at most one may lie before the places ``at``.
    """
    each = firsts.select("key", "n", F.col("first.d").alias("d"), "parity", "second", "prefix", F.posexplode("prefix").alias("at", "word"))
    each = each.filter(F.pmod(F.xxhash64("word"), F.lit(TURNS)) == turn)
    is_common = F.col("word") >= common
    after, one, none = F.slice("prefix", F.col("at") + 2, F.size("prefix")), F.slice("prefix", 1, 1), F.slice("prefix", 1, 0)
    other = F.when(is_common, after).when(F.col("at") < _prefix(F.col("n")), one).otherwise(none)
    met = each.select("key", "n", "d", "parity", "second", "at", "word", F.posexplode(other).alias("skip", "other"))
    word = F.when(is_common, F.xxhash64("word", "other")).otherwise(F.col("word"))
    return met.select(word.alias("word"), "key", "n", (F.col("at") + F.col("skip")).alias("at"), "d", "parity", "second")


def _candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key_a, key_b) of sets that may be linked, from rows (word, key_x, n_x, at_x, d_x, parity_x, second_x); a occurs in b's document or an earlier one."""
    small, large, both = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), F.col("n_a") + F.col("n_b")
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    met = a.join(b, "word").filter((F.col("key_a") != F.col("key_b")) & (F.col("d_a") <= F.col("d_b")) & (DEN * small >= NUM * large))
    pairs = met.filter(((NUM + DEN) * room >= NUM * both) & ((NUM + DEN) * _differ() <= (DEN - NUM) * both))
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("word", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "at", "d", "parity", "second")])


def _linked(candidates: list[DataFrame], firsts: DataFrame, lines: DataFrame) -> DataFrame:
    """(key): of every pair that the whole sets verify, the set that occurs later; the stored candidates go."""
    pairs = cut(reduce(DataFrame.union, candidates).distinct())
    drop(*candidates)
    wanted = cut(firsts.join(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct(), "key", "left_semi").select("key", "first.*"))
    found = lines.filter(_among(wanted)).join(wanted, ["d", "t", "l"]).select("key", F.struct("d", "t", "l").alias("first"), _words("line").alias("words"))
    words = cut(found.dropDuplicates(["key"]))  # rows that repeat a document repeat its lines
    both = pairs
    for side in "ab":
        both = both.join(words.select(*[F.col(c).alias(f"{c}_{side}") for c in words.columns]), f"key_{side}")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    both = both.filter(DEN * shared >= NUM * (F.size("words_a") + F.size("words_b") - shared))
    later = cut(both.select(F.when(F.col("first_a") < F.col("first_b"), F.col("key_b")).otherwise(F.col("key_a")).alias("key")).distinct())
    drop(pairs, wanted, words)
    return later


def _marked(firsts: DataFrame, late: DataFrame) -> DataFrame:
    """``firsts`` with its column ``late`` true for the sets of ``late`` too; both go."""
    marked = cut(firsts.join(late.withColumn("again", F.lit(True)), "key", "left").withColumn("late", F.col("late") | F.col("again").isNotNull()).drop("again"))
    drop(firsts, late)
    return marked


def later_sets(firsts: DataFrame, lines: DataFrame, common: int) -> DataFrame:
    """(key, first, late): whether the set has a Jaccard of at least NUM / DEN to one that occurs earlier; stored.

    ``firsts`` (key, first, n, prefix, parity, second, late: false) is a stored table of every set, which goes.
    """
    hubs, met = [], []
    for turn in range(TURNS):
        keyed = _keyed(firsts, common, turn)
        hub = keyed.groupBy("word").agg(F.min(F.struct("d", "key", "n", "at", "parity", "second")).alias("hub"), F.count("*").alias("many"))
        hubs.append(cut(hub.filter(F.col("many") > 1).select("word", "hub.*", "many")))
        met.append(cut(_candidates(_side(hubs[turn], "a"), _side(keyed, "b"))))
    firsts = _marked(firsts, _linked(met, firsts, lines))
    # an open set looks for an earlier one among all, where more than two meet; sets that first occur in one document meet in both directions
    met = []
    for turn in range(TURNS):
        among = _keyed(firsts, common, turn).join(hubs[turn].filter(F.col("many") > 2).select("word"), "word", "left_semi")
        met.append(cut(_candidates(_side(among, "a"), _side(_keyed(firsts.filter(~F.col("late")), common, turn), "b"))))
    drop(*hubs)
    found = _linked(met, firsts, lines)
    return _marked(firsts, found)


def _among(wanted: DataFrame) -> Column:
    """A filter of fixed size by a bit map of the wanted places, ahead of the exact join: it keeps other lines from the shuffle."""
    slot = F.xxhash64("d", "t", "l").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    found = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("bits"))
    bits = [0] * (1 << (MAP_BITS - 6))
    for r in found.toLocalIterator():
        bits[r["word"]] = r["bits"]
    return F.call_function("shiftrightunsigned", F.get(_array(bits, "array<bigint>"), F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, more) with ``text`` without removed lines, n_lines and n_removed.

    Lines are what line feeds separate. A null text stays null with no lines. Rows that repeat doc_id and text are one document to the order, so both
    keep or lose the same lines; a null doc_id comes first. Columns named like the new ones are replaced. No rows, no result rows.
    """
    n, lines = F.size("words"), _lines(docs)
    sets = cut(lines.select("d", "t", "l", _words("line").alias("words")).filter(n >= min_words))
    counts = rarity(sets)
    prefix = F.slice(_ranked("words", _order(counts)), F.lit(1), F.when(n >= LEAST_LINKED, _prefix(n) + 1).otherwise(0))
    rows = cut(sets.select("d", "t", "l", F.xxhash64("words", n).alias("key"), n.alias("n"), prefix.alias("prefix"), *_parities("words")))
    drop(sets)
    firsts = rows.groupBy("key").agg(F.min(F.struct("d", "t", "l")).alias("first"), *[F.first(c).alias(c) for c in ("n", "prefix", "parity", "second")])
    verdict = later_sets(cut(firsts.withColumn("late", F.lit(False))), lines, _common(counts))
    gone = rows.select("d", "t", "l", "key").join(verdict.select("key", "first", "late"), "key").filter(F.col("late") | (F.struct("d", "t", "l") != F.col("first")))
    base = docs.drop("n_lines", "n_removed")
    k, h, g = free_name(base, "_place"), free_name(base, "_hash"), free_name(base, "_gone")
    gone = cut(gone.groupBy(F.col("d").alias(k), F.col("t").alias(h)).agg(F.collect_set("l").alias(g)))
    drop(rows, verdict)
    p = free_name(base, "_parts")
    joined = base.withColumns({k: _place("doc_id"), h: F.xxhash64(F.coalesce("text", F.lit("")))}).join(gone, [k, h], "left").withColumn(p, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(g))
    kept = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in base.columns], F.when(
        F.col("text").isNull(), 0).otherwise(F.size(p)).cast("long").alias("n_lines"), F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long").alias("n_removed"))
