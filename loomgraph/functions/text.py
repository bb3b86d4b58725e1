"""Text functions: tokens, stems, markup, sizes, matches. Columns where Spark has the parts, Arrow otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Words that are neither indexed nor queried.
STOP_WORDS = """
a an the and or but is are was were be been being have has had do does did will would could should might must
shall can need dare ought used get to of in for on with at by from as into through during before after above below
between under again further then once it its it's this that these those i you he she we they me him her us them
my your his our their what which who when where why how all each few more most other some such no nor not only
own same so than too very just now
""".split()

#: Endings of -es plurals of nouns in -is.
IS_PLURALS = ("analyses", "yses", "theses", "crises", "neuroses", "noses", "axes", "bases", "ellipses")

#: Fixed values of the Porter2 algorithm (published by its author): suffixes by step.
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(rf"[{_V}][^{_V}]", w[start:])
        return start + m.end() if m else len(w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str) -> bool:
    return bool(re.search(rf"(^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$", w))


def porter2(word: str) -> str:
    """The Porter2 (Snowball English) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(rf"(^|[{_V}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_V}].+s$", w):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(rf"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def stem(word: str) -> str:
    """Porter2 for ASCII words; -uses loses its -es, Greek -es plurals become -is first."""
    if not re.fullmatch(r"[A-Za-z]+", word):
        return word
    if len(word) >= 6 and word.endswith("uses"):
        word = word[:-2]
    elif len(word) >= 5 and word.endswith(IS_PLURALS):
        word = word[:-2] + "is"
    return porter2(word)


def subtokens(word: str) -> list[str]:
    """The parts of an identifier: at separators and where a lower-case letter or digit meets an upper-case one."""
    return [x for x in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", word)) if x]


def tokenize(text: str | None) -> list[str]:
    """Index tokens: words without ASCII punctuation around them, lower-cased, without stop words, stemmed,
    each line's new sub-tokens after them."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        own: list[str] = []
        for raw in line.split():
            word = raw.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
            low = word.lower()
            if not low or low in _STOP:
                continue
            own.append(stem(low))
            parts = subtokens(word)
            if len(parts) > 1:
                for p in (stem(x.lower()) for x in parts if len(x) >= 2 and x.lower() not in _STOP):
                    if p not in own:
                        own.append(p)
        out += own
    return out


_STOP = frozenset(STOP_WORDS)


@pandas_udf(ArrayType(StringType()))
def index_tokens(text: pd.Series) -> pd.Series:
    return text.map(tokenize)


def estimate_tokens(text: Column) -> Column:
    """At least 1; a token for every four bytes begun."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def subtokens_column(text: Column) -> Column:
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, "[^A-Za-z0-9]+"), lambda x: x != "")


def glob_to_regex(glob: str) -> str:
    """* within a path part, ** across parts, ? one sign."""
    out, i = "", 0
    while i < len(glob):
        if glob[i:i + 2] == "**":
            out, i = out + ".*", i + 2
            if glob[i:i + 1] == "/":
                out, i = out[:-2] + "(.*/)?", i + 1
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("[^/]" if glob[i] == "?" else re.escape(glob[i])), i + 1
    return f"^{out}$"


def replace_xrefs(text: Column) -> Column:
    """<<target,label>> becomes label, <<target>> becomes target."""
    return F.regexp_replace(F.regexp_replace(text, r"<<[^<>,]*,\s*([^<>]*)>>", "$1"), r"<<([^<>,]*)>>", "$1")


def strip_markup(text: Column) -> Column:
    """Prose of light markup: heading signs, attribute lines, anchors, delimiters and emphasis go, references become text."""
    t = F.regexp_replace(text, r"(?m)^(=+|#+)\s+", "")
    t = F.regexp_replace(t, r"(?m)^(:[\w-]+:.*|\[[^\]\n]*\]|(-{4,}|={4,}|\.{4,}|\|===))$\n?", "")
    return F.regexp_replace(replace_xrefs(t), r"(?<!\w)[*_`]+|[*_`]+(?!\w)", "")


def strip_tags(html: Column) -> Column:
    """Visible text of HTML: scripts, styles and tags go, runs of white space become one blank."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 1))


def snippet(text: Column, words: list[str], width: int = 200) -> Column:
    """The first line that has one of the words (any case), else the first non-blank one, cut to ``width`` and '...'."""
    rows = F.split(F.coalesce(text, F.lit("")), "\n")
    has = lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), F.lower(w)))
    line = F.trim(F.coalesce(F.get(F.filter(rows, has), F.lit(0)), F.get(F.filter(rows, lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def has_bigram(tokens: Column, query: list[str]) -> Column:
    """Whether two adjacent query words are adjacent in the token array, in that order."""
    if len(query) < 2:
        return F.lit(False)
    text = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    out = F.lit(False)
    for a, b in zip(query, query[1:]):
        out = out | text.contains(f" {a} {b} ")
    return out


def clock(text: Column) -> Column:
    """h:mm am/pm and h am/pm as hh:mm; null if there is no valid time."""
    h = F.regexp_extract(text, r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b", 1)
    m = F.regexp_extract(text, r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b", 2)
    p = F.lower(F.regexp_extract(text, r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\b", 3))
    hour, minute = F.expr("0") + F.when(h != "", h.cast("int")), F.when(m == "", 0).otherwise(m.cast("int"))
    ok = (h != "") & hour.between(1, 12) & minute.between(0, 59)
    return F.when(ok, F.format_string("%02d:%02d", (hour % 12) + F.when(p == "p", 12).otherwise(0), minute))


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h
