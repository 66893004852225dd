"""Text, date, place and answer expressions on single values."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import answers as A
from lattica.functions import json_text as J
from lattica.functions import metrics as M
from lattica.functions import text as T
from lattica.functions.vectors import dot, l2_normalize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Introduction\n\nA [12] b.  C!\nD", ["A b.", "C!", "D"]), (None, []), ("", []), ("  x  ", ["x"]), ("Mr. X? Yes", ["Mr.", "X?", "Yes"])],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("He joined the Center for Science and Law at Stanford University.", ["Center for Science and Law at Stanford", "Stanford University"]),
        ("The CEO of NATO met Thomas C. Sudhof, an American.", ["NATO", "Thomas C. Sudhof"]),
        ("March and It and See", []),
        (None, []),
    ],
)
def test_mentions(spark, text, want):
    got = one(spark, T.entity_mentions(F.lit(text).cast("string")))
    assert [m for m in want if m in got] == want and not {"American", "CEO", "March", "It", "See"} & set(got)


@pytest.mark.parametrize(
    ("surface", "valid"),
    [
        ("Thomas Sudhof", True), ("ab", False), ("x" * 81, False), ("1971", False), ("April 25, 1971", False), ("professor of law", False),
        ("his house", False), ("the house", False), ("American author", False), ("German-American biochemist", False), ("American Airlines", True),
        ("a very long description, with a comma and more than forty characters", False), (None, False), ("12345", False),
    ],
)
def test_surfaces(spark, surface, valid):
    assert one(spark, T.is_valid_entity_surface(F.lit(surface).cast("string"))) is valid


def test_people(spark):
    key = lambda s: one(spark, T.person_key(F.lit(s)))
    assert key("Thomas C. Sudhof") == key("Thomas Sudhof") == "thomas sudhof"
    assert key("Thomas") is None and key("a b") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("April 25th, 1971", "25 April 1971"), ("1971-04-25", "25 April 1971"), ("25 april 1971", "25 April 1971"), ("soon", "soon"), ("1971-13-25", "1971-13-25"), (None, "")],
)
def test_dates(spark, text, want):
    assert one(spark, A.normalize_date(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("answer", "question", "want"),
    [
        ("Answer: Paris, France.", "Where was she born?", "Paris"),
        ("Montreal, Quebec", "Place of birth of X?", "Montreal, Quebec"),
        ("The answer is: it was The Matrix", "Which film is older, The Matrix or Alien?", "The Matrix"),
        ("Yes, they are", "Are they old?", "yes"),
        ("Well, no.", "Is it so?", "no"),
        ("American", "What nationality is he?", "America"),
        ("May 3, 1999", "When was it?", "3 May 1999"),
        ("Mercury (planet)", "What is it?", "Mercury"),
        (None, "What?", ""),
    ],
)
def test_answers(spark, answer, question, want):
    assert one(spark, A.postprocess_answer(F.lit(answer).cast("string"), F.lit(question))) == want


@pytest.mark.parametrize(
    ("question", "evidence", "want"),
    [
        ("Where was X born?", "X was born in Albany, New York. He died in Rome, Italy.", "Albany"),
        ("Place of death of X?", "He died in New York City, New York.", "New York"),
        ("When did X die?", "X died on April 3, 1950.", "3 April 1950"),
        ("Where did X study?", "X studied at Oxford; then left.", "Oxford"),
        ("Where does X work?", "X is professor at Yale.", "Yale"),
        ("Who is X?", "X was born in Rome.", ""),
    ],
)
def test_spans(spark, question, evidence, want):
    assert one(spark, A.extract_span(F.lit(question), F.lit(evidence))) == want


def test_json(spark):
    text = 'Plan: {"nodes": [{"id": "a", "question": "x",},], "edges": []}'
    assert one(spark, J.read_dag(F.lit(text)))["nodes"][0]["id"] == "a"
    assert one(spark, J.read_dag(F.lit("none here"))) is None
    assert one(spark, J.read_selected(F.lit("```json\n{'selected': [3, 1],}\n```"))) == [3, 1]
    lines = one(spark, J.question_lines(F.lit('1. Who?\n- "What?"\n\nAll?'), F.lit("all?")))
    assert lines == ["Who?", "What?"]


def test_metrics(spark):
    golds = F.array(F.lit("the cat sat"), F.lit("dog"))
    assert one(spark, M.exact_match(F.lit("Cat sat!"), golds)) == 1.0
    assert one(spark, M.token_f1(F.lit("cat cat"), golds)) == pytest.approx(0.5)
    assert one(spark, M.recall_at(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), 2)) == 0.5
    assert one(spark, M.recall_at(F.array(F.lit(1)), F.array().cast("array<int>"), 2)) == 0.0


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, l2_normalize(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, dot(v, v)) == 25.0


def test_genericness(spark):
    score = lambda t, a, s="": one(spark, T.genericness(F.lit(t), F.lit(a), F.lit(1.0), F.lit(3.0), F.lit(s)))
    assert score("", 1.0) == 1.0
    assert score("Paris", 3.0) == 0.0
    assert score("List of the kings", 2.0) == pytest.approx(0.35 + 0.3 * 0.5 + 0.25)
    assert score("Mercury", 3.0, "Mercury may refer to") == pytest.approx(0.4)
