"""The compatibility decomposition without combining marks, as column expressions.

A character folds alone: the decomposition of a text is that of its characters up to the order of combining marks, which all go. Most
characters that change become one letter or nothing, which ``translate`` does. Those that become several (ligatures, fractions, Hangul) are looked up
by code point, only in texts that hold one.
"""

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No character beyond this code point changes.
LAST = 0x2FA1F
PAGE = 256
HANGUL, HANGUL_END = 0xAC00, 0xD7A3
VOWELS, TAILS = 21, 28


def folded(text: str) -> str:
    out = unicodedata.normalize("NFKD", text)
    # a text has few different characters, so it is searched once a mark and not looked at one by one
    for char in set(out):
        if unicodedata.combining(char):
            out = out.replace(char, "")
    return out


@lru_cache(maxsize=1)
def changes() -> dict[str, str]:
    """What each changing character becomes; Hangul syllables, which follow a rule, left out."""
    out = {}
    for code in range(0x80, LAST + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL <= code <= HANGUL_END:
            continue
        char = chr(code)
        new = folded(char)
        if new != char:
            out[char] = new
    return out


@lru_cache(maxsize=1)
def _alphabet() -> tuple[str, str]:
    """Characters that become one, then those that go, and what the first become."""
    one = [(c, n) for c, n in changes().items() if len(n) == 1]
    gone = [c for c, n in changes().items() if not n]
    return "".join(c for c, _ in one) + "".join(gone), "".join(n for _, n in one)


@lru_cache(maxsize=1)
def _several() -> tuple[str, str, str]:
    """(class of the characters that become several, number of each page's slot as JSON, the slots' texts as JSON)."""
    many = {ord(c): n for c, n in changes().items() if len(n) > 1}
    pages = sorted({code // PAGE for code in many})
    slots = [None] * (pages[-1] + 1)
    texts = []
    for slot, page in enumerate(pages):
        slots[page] = slot * PAGE
        texts += [many.get(page * PAGE + k) for k in range(PAGE)]
    spans, last = [], -2
    for code in sorted(many):
        if code == last + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
        last = code
    spans.append([HANGUL, HANGUL_END])
    cls = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"
    return cls, json.dumps(slots), json.dumps(texts)


def _letters(first: int, n: int) -> Column:
    return F.from_json(F.lit(json.dumps([folded(chr(first + k)) for k in range(n)])), "array<string>")


def _one_character(char: Column) -> Column:
    _, slots, texts = _several()
    code = F.ascii(char)
    at = F.get(F.from_json(F.lit(slots), "array<int>"), F.shiftright(code, 8)) + code.bitwiseAND(F.lit(PAGE - 1))
    syllable = code - HANGUL
    tail = syllable % TAILS
    hangul = F.concat(
        F.get(_letters(0x1100, 19), F.floor(syllable / (VOWELS * TAILS)).cast("int")), F.get(_letters(0x1161, VOWELS), F.floor(syllable / TAILS).cast("int") % VOWELS),
        F.when(tail > 0, F.get(_letters(0x11A8, TAILS - 1), tail - 1)).otherwise(""))
    return F.when(code.between(HANGUL, HANGUL_END), hangul).otherwise(F.coalesce(F.get(F.from_json(F.lit(texts), "array<string>"), at), char))


def fold(text: Column) -> Column:
    """``text`` with every character folded; a text within ASCII is left as it is."""
    src, dst = _alphabet()
    single = F.translate(text, src, dst)
    several = F.array_join(F.transform(F.split(single, ""), _one_character), "")
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).when(single.rlike(_several()[0]), several).otherwise(single)
