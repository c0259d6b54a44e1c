"""Column expressions over text: normalising, tokens, sentences, claims, citations, redaction, quantities.

White space is what Unicode and the C0 separators call it, words and digits are Unicode's, and lines
end at any of the usual line ends; every class is spelled out, so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class, without brackets, for Java's and other regular expressions.
SPACE = "\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The function words of the language gate.
ENGLISH = (
    "the a an and or of to in is are was were be been for on with that this it as at by from not have has had but they you we he she "
    "will would can could should may might do does did their its our your all each which there when what who how than then if no yes "
    "more most other some such only also after before between during under over about into out up down"
).split()
ENGLISH_RATIO, ENGLISH_TOKENS = 0.08, 20

# Lines of these forms are boilerplate.
BOILERPLATE = (
    rf"^[{SPACE}]*(©|copyright\b)",
    r"all rights reserved",
    r"cookie (policy|preferences|settings)",
    rf"^[{SPACE}]*(home|about us|contact|careers)([{SPACE}]*[|>·][{SPACE}]*[\p{{L}}\p{{N}}_]+.*)?[{SPACE}]*$",
    r"subscribe to our newsletter",
    r"terms of (service|use)",
)
#: Every such line has one of these, lower-cased.
BOILERPLATE_MARKS = ("©", "copyright", "all rights reserved", "cookie p", "cookie s", "about us", "contact", "careers", "home", "our newsletter", "terms of ")
LEAST_CHARS = 80

# What personal data looks like, in order, and what replaces it.
PERSONAL = (r"\bsk-[A-Za-z0-9-]{6,}\b", r"\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
REDACTED = "[REDACTED]"

# The five families of injected instructions.
INJECTION = (
    r"\b(ignore|disregard|forget|override|discard)\b[^.]{0,40}\b(instruction|directive|rule|guidance|context|prompt)s?\b",
    r"\b(output|emit|print|echo|return|reply|respond|answer)\b[^.]{0,40}\b(verbatim|exact|exactly|precisely|nothing\s+else|and\s+nothing)\b",
    r"\b(system|admin|administrator|operator|developer|maintainer)\b[^.]{0,25}\b(notice|override|directive|message|mode|instruction)s?\b",
    r"\byou\s+are\s+(now|from\s+now|henceforth)\b",
    r"\bnew\s+(instruction|directive|rule)s?\s*:",
)

# Units of quantities and their common names.
UNITS = "hours?|hrs?|days?|minutes?|mins?|kg|kilograms?|usd|dollars?|m/s|percent|%"
UNIT_NAMES = {"hour": "hours", "hr": "hours", "hrs": "hours", "day": "days", "minute": "minutes", "min": "minutes", "mins": "minutes", "kilogram": "kg", "kilograms": "kg", "dollar": "usd", "dollars": "usd", "%": "percent"}
QUANTITY = rf"(?iU)(?<![\w-])(\d[\d,]*(?:\.\d+)?)\s*({UNITS})\b"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def normal(text: Column) -> Column:
    """The key under which texts count as equal: lower case, white space squeezed."""
    return squeeze(F.lower(text))


def short_sha1(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 16)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repetitions; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("bigint"))


def english_counts(text: Column) -> tuple[Column, Column]:
    """(tokens, function words) of the language gate."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return F.size(words), F.size(F.filter(words, lambda w: w.isin(ENGLISH)))


def is_english(text: Column) -> Column:
    """Texts of few tokens pass."""
    total, common = english_counts(text)
    return (total < ENGLISH_TOKENS) | (common / F.greatest(total, F.lit(1)) >= ENGLISH_RATIO)


def without_boilerplate(text: Column) -> Column:
    """The text without boilerplate lines, line ends unified, at most one blank line in a row, stripped."""
    lines = F.split(text, LINE_END)
    kept = F.filter(lines, lambda line: ~line.rlike("(?iU)" + "|".join(f"(?:{p})" for p in BOILERPLATE)))
    # Only texts with one of the words that such lines have are taken apart.
    folded = F.translate(F.lower(text), "\u017f", "s")
    marked = F.lit(False)
    for mark in BOILERPLATE_MARKS:
        marked = marked | F.contains(folded, F.lit(mark))
    whole = F.when(marked, F.array_join(kept, "\n")).otherwise(F.regexp_replace(text, LINE_END, "\n"))
    return strip(F.regexp_replace(whole, "\n{3,}", "\n\n"))


def redacted(text: Column) -> Column:
    for pattern in PERSONAL:
        text = F.regexp_replace(text, "(?U)" + pattern, REDACTED)
    return text


def has_personal(text: Column) -> Column:
    return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in PERSONAL))


def looks_injected(text: Column) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in INJECTION))


def claims(answer: Column) -> Column:
    """The first six sentences of at least 20 characters, citation markers removed."""
    plain = F.regexp_replace(answer, r"\[[0-9]{1,3}\]", "")
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"[^.!?\n]+[.!?]"), F.lit(0)), lambda s: squeeze(s))
    return F.slice(F.filter(found, lambda c: F.length(c) >= 20), 1, 6)


def supported(claim: Column, context: Column) -> Column:
    """At least 0.7 of the claim's distinct tokens are in the context; a claim without tokens is supported."""
    own = token_set(claim)
    return F.when(F.size(own) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(own, token_set(context))) / F.size(own) >= 0.7)


def markers(answer: Column, most: Column) -> Column:
    """Cited places from 1 to most, each once, by first appearance."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda m: m.cast("int"))
    return F.array_distinct(F.filter(found, lambda m: (m >= 1) & (m <= most)))


def best_sentence(block: Column, question: Column) -> Column:
    """The first of the sentences nearest to the question by Jaccard similarity, cut to 300 characters."""
    flat, own = squeeze(block), token_set(question)
    sentences = F.transform(F.regexp_extract_all(flat, F.lit(r"[^.!?]+[.!?]"), F.lit(0)), lambda s: F.trim(s))
    ranked = F.transform(sentences, lambda s, i: F.struct(jaccard(own, token_set(s)).alias("score"), (-i).alias("place"), s.alias("text")))
    return F.substring(F.when(F.size(sentences) > 0, F.array_max(ranked)["text"]).otherwise(flat), 1, 300)


def quantities(text: Column) -> Column:
    """Array of (value, unit), normalised, each once, in order."""
    values, units = (F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(i)) for i in (1, 2))
    names = F.create_map(*[F.lit(x) for pair in UNIT_NAMES.items() for x in pair])

    def value(v: Column) -> Column:
        plain = F.replace(v, F.lit(","), F.lit(""))
        return F.when(F.instr(plain, ".") > 0, F.regexp_replace(plain, r"\.?0*$", "")).otherwise(plain)

    return F.array_distinct(F.zip_with(values, units, lambda v, u: F.struct(value(v).alias("value"), F.coalesce(F.try_element_at(names, F.lower(u)), F.lower(u)).alias("unit"))))


def contains_normal(text: Column, part: Column) -> Column:
    return F.contains(normal(text), normal(part))


def answer_matches(answer: Column, gold: Column) -> Column:
    """Null without a gold answer; else whether it is part of the answer, commas aside."""
    plain = lambda c: F.replace(normal(c), F.lit(","), F.lit(""))
    return F.when(gold.isNotNull(), F.contains(plain(answer), plain(gold)))
