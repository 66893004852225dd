"""Tolerant reading of JSON that a model has written into free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import _col, bound

DAG = "nodes array<struct<id:string,question:string,depends_on:array<string>,operator:string>>, edges array<string>"
#: Names under which an edge may give its ends; an edge may also be a pair.
EDGE_ENDS = (("$.source", "$.from", "$.src", "$[0]"), ("$.target", "$.to", "$.dst", "$[1]"))


def json_object(text: Column | str) -> Column:
    """The object inside the longest fenced block, else from the first brace to the last; null without one."""
    t = F.coalesce(_col(text), F.lit(""))
    fenced = F.regexp_extract_all(t, F.lit(r"(?is)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    longest = F.try_element_at(F.array_sort(fenced, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.coalesce(longest, F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")))


def _variants(t: Column, key: str) -> list[Column]:
    no_tail = F.regexp_replace(t, r",\s*([}\]])", "$1")
    comma = F.regexp_replace(no_tail, rf"([}}\]])\s*(\"{key}\")", "$1, $2")
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(comma, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return [t, no_tail, comma, literal]


def _read(text: Column | str, schema: str, key: str, needed: str) -> Column:
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    parsed = [F.from_json(v, schema, options) for v in _variants(json_object(text), key)]
    return F.coalesce(*[F.when(p[needed].isNotNull(), p) for p in parsed])


def read_dag(text: Column | str) -> Column:
    """Nodes and edges of a question graph: trailing commas, a missing comma before "edges", single quotes and Python
    literals are put up with; null if nothing can be read. Ends of edges may be called source, from or src and target, to
    or dst, and an edge may be a pair."""

    def ends(e: Column) -> Column:
        plain = F.regexp_replace(e, "'", '"')
        return F.struct(*[F.coalesce(*[F.get_json_object(x, n) for n in names for x in (e, plain)]).alias(c) for c, names in zip(("source", "target"), EDGE_ENDS, strict=True)])

    read = _read(text, DAG, "edges", "nodes")
    return F.when(read.isNotNull(), F.struct(read["nodes"].alias("nodes"), F.transform(read["edges"], ends).alias("edges")))


def read_selected(text: Column | str) -> Column:
    """The numbers under "selected" of a reranking answer, or null."""
    return _read(text, "selected array<int>", "selected", "selected")["selected"]


def question_lines(text: Column | str, question: Column | str, most: int = 7) -> Column:
    """Lines without bullets, numbers and quotes, without repeats of the question, at most ``most``."""
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]+|\d+[.)]|\(?[a-z]\))\s*", ""), "^[\"']+|[\"']+$", ""))
    kept = F.filter(lines, lambda x: (F.trim(x) != "") & (F.lower(F.trim(x)) != F.lower(F.trim(_col(question)))))
    return F.slice(F.transform(kept, lambda x: F.trim(x)), 1, most)


def distinct_provenance(provenance: Column | str) -> Column:
    """Distinct by place (document, passage, sentence), the smallest quote of each, in that order."""
    place = lambda p: F.struct(p["doc_idx"].alias("doc_idx"), p["passage_id"].alias("passage_id"), p["sent_id"].alias("sent_id"), p["doc_id"].alias("doc_id"), p["quote"].alias("quote"))
    same = lambda a, b: (a["doc_idx"] == b["doc_idx"]) & (a["passage_id"] == b["passage_id"]) & (a["sent_id"] == b["sent_id"]) & (a["doc_id"] == b["doc_id"])
    ordered = F.array_sort(F.array_distinct(F.transform(_col(provenance), place)))
    return bound(ordered, lambda o: F.filter(o, lambda p, i: (i == 0) | ~same(p, F.get(o, i - 1))))
