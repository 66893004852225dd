"""Text expressions: cleaning, sentences, normal forms, mentions, validity of entity names, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import lexicons as L


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: a column that is used in many places is otherwise repeated in each."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _in(c: Column, words: list[str]) -> Column:
    return c.isin(words)


def clean_wiki_text(text: Column | str) -> Column:
    """Without citation marks like ``[3]`` and without a leading "Introduction" header."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\[\d+\]", "")
    t = F.regexp_replace(t, r"(?i)^\s*Introduction\s*\n+", "")
    return F.regexp_replace(t, r"(?i)^\s*Introduction\s+", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """Array of sentences: cut at white space after ``.``, ``!`` or ``?``; null gives an empty array."""
    return F.filter(F.split(collapse(clean_wiki_text(text)), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(text: Column | str) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def normalize_answer(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return collapse(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def strip_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")


def normalize_entity(text: Column | str) -> Column:
    """Trimmed, without punctuation at the edges, single spaces, lower case."""
    return F.lower(collapse(strip_punctuation(F.trim(F.coalesce(_col(text), F.lit(""))))))


def _trim_words(text: Column, words: list[str]) -> Column:
    either = "|".join(words)
    return F.regexp_replace(F.regexp_replace(text, rf"(?i)^((?:{either})(?:\s+|$))+", ""), rf"(?i)((?:^|\s+)(?:{either}))+$", "")


#: Patterns of mentions (a capitalised word, an acronym) and the most words that follow the first.
NAME = "[A-Z][a-zA-Z.]+"
ACRONYM = r"\b[A-Z]{2,}\b"
JOINED, ADJACENT = 6, 5


def entity_mentions(text: Column | str) -> Column:
    """Distinct capitalised runs and acronyms in order of pattern, then of place."""
    inner = "|".join(L.INNER_CONNECTORS)
    t = clean_wiki_text(text)
    found = F.concat(
        F.regexp_extract_all(t, F.lit(rf"\b{NAME}(?:\s+(?:{inner})\s+{NAME}){{1,{JOINED}}}\b"), F.lit(0)),
        F.regexp_extract_all(t, F.lit(rf"\b(?:{NAME})(?:\s+(?:{NAME})){{0,{ADJACENT}}}\b"), F.lit(0)),
        F.regexp_extract_all(t, F.lit(ACRONYM), F.lit(0)),
    )
    trimmed = F.transform(found, lambda m: _trim_words(_trim_words(collapse(strip_punctuation(m)), L.PREFIX_TRIM), L.CONNECTORS))

    def keep(m: Column) -> Column:
        low, single = F.lower(m), ~m.contains(" ")
        strong = (m.rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length(m) >= 3)) | ((F.length(m) >= 4) & m.rlike("^[A-Z]"))
        named = strong & ~F.upper(m).isin(L.ACRONYM_DROPS) & ~_in(low, L.SINGLE_DROPS)
        plain = ~_in(low, L.DEMONYMS) & ~((F.length(m) <= 2) & m.rlike("^[A-Za-z]+$")) & (m != "")
        return plain & ((single & named) | (~single & m.rlike(r"(^|\s)[A-Z]")))

    return F.array_distinct(F.filter(trimmed, keep))


def looks_like_date(surface: Column | str) -> Column:
    """A month name with a day and a year, or a bare year. The month is searched as a substring."""
    s = F.trim(_col(surface))
    low = F.lower(s)
    return (low.rlike("|".join(L.MONTHS)) & low.rlike(r"\b\d{1,2}\b") & low.rlike(r"\b\d{4}\b")) | s.rlike(r"^\d{4}$")


def is_valid_entity_surface(surface: Column | str) -> Column:
    """Whether a surface may become an entity."""
    s = F.trim(F.coalesce(_col(surface), F.lit("")))
    low, words = F.lower(s), F.split(s, r"\s+")
    first, second = F.lower(F.element_at(words, 1)), F.try_element_at(words, F.lit(2))
    head = F.element_at(F.split(first, "[-/]"), 1)
    lower_next = second.isNull() | (second.rlike(r"\p{Ll}") & ~second.rlike(r"\p{Lu}"))
    role = reduce(lambda a, b: a | b, [low.startswith(p) for p in L.ROLE_PREFIXES])
    bad = (
        role
        | looks_like_date(s)
        | s.rlike(r"^\p{N}+$")
        | _in(first, L.PRONOUNS + L.DETERMINERS)
        | _in(low, L.PRONOUNS)
        | (s.contains(",") & (F.length(s) > 40))
        | ((_in(first, L.DEMONYMS) | _in(head, L.DEMONYMS)) & lower_next)
    )
    return F.length(s).between(3, 80) & (F.size(words) <= 12) & ~bad


def looks_like_person(surface: Column | str) -> Column:
    """Two to five words of which the first and the last start in upper case or are an initial."""
    words = F.split(F.trim(F.coalesce(_col(surface), F.lit(""))), r"\s+")
    upper = lambda w: w.rlike(r"^\p{Lu}")
    return F.size(words).between(2, 5) & upper(F.element_at(words, 1)) & upper(F.element_at(words, -1))


def person_key(surface: Column | str) -> Column:
    """First and last word without dots, normalised; null for what does not look like a person."""
    words = F.split(F.trim(_col(surface)), r"\s+")
    ends = F.concat_ws(" ", *[F.translate(F.element_at(words, i), ".", "") for i in (1, -1)])
    return F.when(looks_like_person(surface), normalize_entity(ends))


def tokenize_title(title: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(title), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def title_stopword_ratio(title: Column | str) -> Column:
    words = tokenize_title(title)
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: _in(w, L.TITLE_STOPWORDS))) / F.size(words))


def safe_name(name: Column | str) -> Column:
    """A model's name as part of a path."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(name)), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def genericness(title: Column | str, avg_idf: Column, p10: Column, p90: Column, snippet: Column | str) -> Column:
    """How little a title names one thing, in 0..1."""
    t = F.lower(F.trim(F.coalesce(_col(title), F.lit(""))))
    head = F.substring(F.lower(F.trim(F.coalesce(_col(snippet), F.lit("")))), 1, 200)
    vague = t.contains("(disambiguation)") | head.contains("may refer to") | head.contains("may also refer to")
    listed = t.startswith("list of ") | t.startswith("index of ") | t.endswith(" (list)")
    scaled = F.when(p90 > p10 + 1e-9, (avg_idf - p10) / (p90 - p10)).otherwise(0.5)
    score = 0.70 * (1 - clamp01(scaled)) + 0.30 * title_stopword_ratio(title)
    score = score + F.when(listed, 0.25).otherwise(0.0) + F.when(vague, 0.40).otherwise(0.0)
    return F.when(t == "", 1.0).otherwise(clamp01(score))
