"""Answer rules: dates, places, options of a question, spans of the evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import lexicons as L
from lattica.functions.text import _col, bound, normalize_answer


#: Patterns of dates, of questions that offer two options, of lead-ins of answers and of spans.
ISO_DATE = r"^\s*(\d{3,4})-(\d{1,2})-(\d{1,2})\s*$"
MONTH_DAY_YEAR = r"^\s*([A-Za-z]+)\s+(\d{1,2})\s*,?\s*(\d{3,4})\s*$"
DAY_MONTH_YEAR = r"^\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{3,4})\s*$"
OPTIONS = (r"(?:,|\b)([^,?]+?)\s+or\s+([^?]+?)\?\s*$", r"(?i)\bout of\s+(.+?)\s+and\s+(.+?)\?\s*$", r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)\?\s*$")
ANSWER_TAIL = r"(?i)\banswer\s*:\s*(.+)"
ANSWER_LEAD = r"(?i)^(the answer is|answer is|final answer is)\s*[:\-]?\s*"
BORN, DIED = ("was born in ", "born in "), ("died in ", "died at ")
DIED_ON, STUDIED, WORKED = ("died on ", r"date of death[:\s]+"), ("studied at ", "educated at "), ("works at ", "worked at ", "professor at ")


def _month(name: Column) -> Column:
    pairs = [x for m in L.MONTHS for x in (F.lit(m), F.lit(m.capitalize()))]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def normalize_date(text: Column | str) -> Column:
    """``D Month YYYY`` for ISO dates and for dates with a month's name, otherwise the text without ordinal endings."""
    return bound(F.regexp_replace(F.trim(F.coalesce(_col(text), F.lit(""))), r"(?i)(\d+)(st|nd|rd|th)\b", "$1"), _date)


def _date(t: Column) -> Column:
    show = lambda d, m, y: F.concat_ws(" ", d.cast("int").cast("string"), m, y.cast("int").cast("string"))
    iso, mdy, dmy = ISO_DATE, MONTH_DAY_YEAR, DAY_MONTH_YEAR
    named = F.try_element_at(F.array(*[F.lit(m.capitalize()) for m in L.MONTHS]), F.nullif(_group(t, iso, 2).cast("int"), F.lit(0)))
    return (
        F.when(named.isNotNull(), show(_group(t, iso, 3), named, _group(t, iso, 1)))
        .when(_month(_group(t, mdy, 1)).isNotNull(), show(_group(t, mdy, 2), _month(_group(t, mdy, 1)), _group(t, mdy, 3)))
        .when(_month(_group(t, dmy, 2)).isNotNull(), show(_group(t, dmy, 1), _month(_group(t, dmy, 2)), _group(t, dmy, 3)))
        .otherwise(t)
    )


def binary_options(question: Column | str) -> Column:
    """Array of the two options that a question offers, or null."""
    q = _col(question)
    offered = [F.when(q.rlike(p), F.array(F.trim(F.regexp_extract(q, p, 1)), F.trim(F.regexp_extract(q, p, 2)))) for p in OPTIONS]
    return F.coalesce(*offered)


def _overlap(answer: Column, option: Column) -> Column:
    def share(a: Column, o: Column) -> Column:
        words = F.array_distinct(F.split(o, " "))
        shared = F.size(F.array_intersect(F.split(a, " "), words)) / F.size(words)
        return F.when((a == "") | (o == ""), 0.0).when(a.contains(o) | o.contains(a), 1.0).otherwise(shared)

    return bound(normalize_answer(answer), lambda a: bound(normalize_answer(option), lambda o: share(a, o)))


def place_question(q: Column) -> Column:
    return q.contains("place of birth") | q.contains("place of death") | q.rlike(r"\bwhere\b.*\bborn\b") | q.rlike(r"\bwhere\b.*\bdied\b")


def postprocess_answer(answer: Column | str, question: Column | str) -> Column:
    """The short form of a free answer to a question."""
    q = F.coalesce(_col(question), F.lit(""))
    return bound(F.trim(F.coalesce(_col(answer), F.lit(""))), lambda a: F.when(a == "", "").otherwise(bound(_first_line(a), lambda s: bound(q, lambda q: _short(s, q)))))


def _first_line(a: Column) -> Column:
    """The first line after the last "Answer:", without lead-ins, quotes and final dots."""
    tails = F.regexp_extract_all(a, F.lit(ANSWER_TAIL), F.lit(1))
    a = F.coalesce(F.trim(F.try_element_at(tails, F.lit(-1))), a)
    a = F.trim(F.element_at(F.split(a, r"\r\n|\n|\r"), 1))
    a = F.trim(F.regexp_replace(a, ANSWER_LEAD, ""))
    return F.regexp_replace(F.regexp_replace(a, "^[ \\t\"'`]+|[ \\t\"'`]+$", ""), r"\.+$", "")


def _short(a: Column, q: Column) -> Column:
    low = F.lower(F.trim(q))
    options = F.when(low.rlike("^(which|who)"), binary_options(q))
    chosen = bound(options, lambda o: bound(_overlap(a, o[0]), lambda x: bound(_overlap(a, o[1]), lambda y: F.when(F.greatest(x, y) >= 0.5, F.when(x >= y, o[0]).otherwise(o[1])))))
    closed = F.when(low.rlike("^(are|do|did|is) "), F.when(a.rlike(r"(?i)\bno\b"), "no").when(a.rlike(r"(?i)\byes\b"), "yes"))
    same = F.lower(F.trim(a))
    nation = F.when(
        low.startswith("what nationality"),
        F.when(same.isin("american", "united states", "usa", "america"), "America").when(same.isin("german", "germany"), "Germany"),
    )
    dated = F.when(low.startswith("when ") | low.contains("date"), normalize_date(a)).otherwise(a)
    bare = bound(dated, lambda d: F.coalesce(F.nullif(F.trim(F.regexp_replace(d, r"\s*\([^)]{0,60}\)\s*$", "")), F.lit("")), d))

    def city(b: Column) -> Column:
        region = F.lower(F.trim(F.regexp_extract(b, "^[^,]*,(.*)$", 1)))
        return F.when(place_question(low) & region.isin(L.US_STATES + L.COUNTRIES), F.trim(F.regexp_extract(b, "^([^,]*),", 1))).otherwise(b)

    return F.coalesce(chosen, closed, nation, bound(bare, city))


def normalize_place(place: Column | str) -> Column:
    """The city of "city, region, ..." where the region is a state or a country; otherwise both."""
    return bound(F.trim(F.coalesce(_col(place), F.lit(""))), _city)


def _city(p: Column) -> Column:
    parts = F.filter(F.transform(F.split(p, ","), lambda x: F.trim(x)), lambda x: x != "")
    city, region = F.try_element_at(parts, F.lit(1)), F.lower(F.try_element_at(parts, F.lit(2)))
    same = region.isin(L.US_STATES) & F.lower(city).startswith(region) & F.lower(city).contains("city")
    two = F.when(region.isin(L.COUNTRIES), city).when(same, parts[1]).when(region.isin(L.US_STATES), city).otherwise(F.concat_ws(", ", city, parts[1]))
    return F.when(F.size(parts) >= 3, city).when(F.size(parts) == 2, two).otherwise(p)


def extract_span(question: Column | str, evidence: Column | str) -> Column:
    """What the first rule that fits the question finds in the evidence; empty if none does."""
    q, text = F.lower(F.trim(F.coalesce(_col(question), F.lit("")))), F.coalesce(_col(evidence), F.lit(""))
    return bound(q, lambda q: bound(text, lambda text: _span(q, text)))


def _span(q: Column, text: Column) -> Column:
    def first(*leads: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, rf"(?i)\b{lead}([^.;\n]+)", 1)), F.lit("")) for lead in leads])

    born = F.when(q.contains("place of birth") | q.rlike(r"\bwhere\b.*\bborn\b"), normalize_place(F.nullif(first(*BORN), F.lit(""))))
    died = F.when(q.contains("place of death") | q.rlike(r"\bwhere\b.*\bdied?\b"), first(*DIED))
    date = F.when(q.startswith("when ") | q.contains("date"), first(*DIED_ON))
    study = F.when(q.contains("study") | q.contains("studied"), first(*STUDIED))
    work = F.when(q.contains("work at") | q.rlike(r"\bwhere\b.*\bwork\b"), first(*WORKED))
    found = F.coalesce(
        F.nullif(born, F.lit("")), F.when(died.isNotNull(), normalize_place(died)), F.when(date.isNotNull(), normalize_date(date)), study, work
    )
    return F.coalesce(found, F.lit(""))
