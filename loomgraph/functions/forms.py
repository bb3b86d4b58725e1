"""Scalar forms of names, questions, values and answers; everything is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge types that carry meaning rather than structure; SimilarTo is inferred.
SEMANTIC_TYPES = ["IsA", "IsEquivalentTo", "PartOf", "Causes", "SynonymOf", "SimilarTo", "PrerequisiteFor", "Implies", "RelatesTo", "AssociatedWith", "DefinesTerm", "Documents", "Mentions"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
#: Attributes of an embedded text that change without its meaning.
VOLATILE = ["source_hash", "last_modified", "span", "line", "confidence", "generated_at"]


def word_values() -> dict[str, str]:
    """Number words, months, ordinals and truth words with the value that each stands for."""
    out = {w: str(i) for i, w in enumerate(UNITS)} | {w: str(10 * (i + 2)) for i, w in enumerate(TENS)}
    out |= {"hundred": "100", "thousand": "1000"}
    out |= {w: f"{i + 1:02}" for i, w in enumerate(MONTHS)} | {w: str(i + 1) for i, w in enumerate(ORDINALS)}
    return out | {"yes": "true", "on": "true", "enabled": "true", "no": "false", "off": "false", "disabled": "false"}


def word_value(word: Column) -> Column:
    """What a word stands for; null if it stands for nothing else."""
    pairs = F.create_map(*(F.lit(x) for kv in word_values().items() for x in kv))
    return F.try_element_at(pairs, F.lower(word))


def with_values(words: Column) -> Column:
    """An array of words followed by the values that some of them stand for, without repeats."""
    return F.array_distinct(F.concat(words, F.filter(F.transform(words, word_value), lambda x: x.isNotNull())))


def fragment(anchor: Column) -> Column:
    """What stands after the last #; the whole anchor if there is none."""
    return F.element_at(F.split(anchor, "#"), -1)


def leaf(anchor: Column) -> Column:
    """The last part of the fragment, after ::, a dot or a slash."""
    return F.element_at(F.split(fragment(anchor), r"::|[./]"), -1)


def natural_form(symbol: Column) -> Column:
    """A symbol without its type arguments (innermost first, three deep) and blanks."""
    for _ in range(3):
        symbol = F.regexp_replace(symbol, "<[^<>]*>", "")
    return F.regexp_replace(symbol, r"[ \t]+", "")


def anchor_forms(anchor: Column) -> Column:
    """The names an anchor goes by: fragment, leaf, both in lower case, and its qualified prefixes."""
    parts = F.split(fragment(anchor), "::")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    own = F.array(fragment(anchor), leaf(anchor), F.lower(fragment(anchor)), F.lower(leaf(anchor)))
    return F.array_distinct(F.concat(own, prefixes))


def doc_type(anchor: Column) -> Column:
    """module, adr, plan, use-case or agent by how an anchor begins; other for the rest."""
    starts = [("mod-", "module"), ("module-", "module"), ("adr-", "adr"), ("plan-", "plan"), ("use-case-", "use-case"), ("agent-", "agent")]
    out = F.lit("other")
    for prefix, kind in reversed(starts):
        out = F.when(F.lower(anchor).startswith(prefix), kind).otherwise(out)
    return out


def is_private(anchor: Column) -> Column:
    """An anchor whose leaf begins with an underscore, or that lies in a private or internal folder."""
    return leaf(anchor).startswith("_") | anchor.rlike("(^|/)(private|internal)(/|$)")


def is_test(anchor: Column) -> Column:
    """An anchor of a test by its path or its name."""
    return F.lower(anchor).rlike(r"(^|/)(tests?|specs?|__tests__)(/|$)|(^|[#/:.])test_|_test($|[#/.])|(test|spec)\.[a-z]+")


def looks_like_code(question: Column) -> Column:
    """A question with an underscore, ::, ->, a call, a slash, or a hump inside a word."""
    return question.rlike(r"_|::|->|\(|/|[a-z][A-Z]")


def is_overview(question: Column) -> Column:
    """A question after the whole and not after one thing."""
    return F.lower(question).rlike(r"\b(overview|architecture|big picture|high level|how does .* work|what is)\b")


def token_boundary(name: Column, token: str) -> Column:
    """A whole word, a separated part or a hump of a name equals the token."""
    humps = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_contains(F.split(F.lower(humps), "[^a-z0-9]+"), token)


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    """At most 4 * ``tokens`` characters, cut back to a word's end, with an ellipsis if something is gone."""
    head = F.substring(text, 1, 4 * tokens)
    back = F.regexp_replace(head, r"[ \t\n\r]+[^ \t\n\r]*\z", "")
    return F.when(F.length(text) <= 4 * tokens, text).otherwise(F.concat(back, F.lit(" …")))


def preview(text: Column, needle: str, size: int = 512) -> Column:
    """At most ``size`` characters around the first match in any case; null without a match."""
    at = F.instr(F.lower(text), F.lit(needle.lower()))
    start = F.greatest(F.lit(1), at - (size - len(needle)) // 2)
    return F.when(at > 0, F.substring(text, start, F.lit(size)))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def source_hash(text: Column) -> Column:
    """SHA-256 of a text whose line ends are line feeds, whatever they were."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), 256)


def scope_hash(anchors: Column) -> Column:
    """SHA-256 of a set of anchors, independent of their order and of repeats."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(anchors)), "\n"), 256)


def embed_text(text: Column) -> Column:
    """A text without the lines of volatile attributes."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(f"^:({'|'.join(VOLATILE)}):"))
    return F.array_join(kept, "\n")


def embed_key(anchor: Column, text: Column, version: int = 1) -> Column:
    """The key of an embedding: the version, and the hash of anchor and normalised text."""
    return F.concat(F.lit(f"v{version}:"), F.sha2(F.concat_ws("\n", anchor, embed_text(text)), 256))


def is_semantic(edge_type: Column) -> Column:
    return edge_type.isin(SEMANTIC_TYPES)


def is_inferred(edge_type: Column) -> Column:
    return edge_type == "SimilarTo"


def redact(attributes: Column, names: list[str], public: bool = True) -> Column:
    """A map whose listed values are blacked out when it is to be public."""
    return F.transform_values(attributes, lambda k, v: F.when(k.isin(names), F.lit("[redacted]")).otherwise(v)) if public else attributes


def self_reference(path: Column, patterns: list[str], confidence: Column) -> Column:
    """0.1 where the source path has one of the patterns in it, else the confidence given."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(path, F.lit(p))
    return F.when(hit, 0.1).otherwise(confidence)


def timestamp_text(seconds: Column) -> Column:
    """Seconds since the epoch as RFC 3339 text in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_dated(path: Column) -> Column:
    """A file whose name without its extension is a date that exists."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return stem.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(stem, F.lit("yyyy-MM-dd")).isNotNull()


def auto_budget(base: Column, average_degree: Column, most: int = 32_000) -> Column:
    """A budget that grows with how connected a graph is: base * (1 + twice the average within 0 and 3)."""
    return F.least(F.lit(most), F.round(base * (1 + F.greatest(F.lit(0.0), F.least(F.lit(3.0), average_degree * 2)))).cast("long"))
