"""Evaluation expressions over answers and retrieved documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.text import _col, normalize_answer


def exact_match(prediction: Column | str, golds: Column | str) -> Column:
    """1 if any gold answer has the prediction's normal form."""
    return F.array_contains(F.transform(_col(golds), lambda g: normalize_answer(g)), normalize_answer(prediction)).cast("double")


def token_f1(prediction: Column | str, golds: Column | str) -> Column:
    """The greatest multiset-overlap F1 over the golds."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    # bound once through one-element arrays: what a lambda names is not computed again for every word
    predicted, gold = F.array(words(prediction)), F.transform(_col(golds), lambda g: words(g))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))

    def one(p: Column, g: Column) -> Column:
        shared = F.array(F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(count(p, w), count(g, w))))
        return F.transform(shared, lambda n: F.when(n > 0, 2.0 * n / (F.size(p) + F.size(g))).otherwise(0.0))[0]

    best = F.transform(predicted, lambda p: F.array_max(F.transform(gold, lambda g: one(p, g))))
    return F.coalesce(best[0], F.lit(0.0))


def recall_at(retrieved: Column | str, golds: Column | str, k: int) -> Column:
    """Share of distinct gold documents among the first ``k``; 0 without gold."""
    gold = F.array_distinct(_col(golds))
    hit = F.size(F.array_intersect(F.slice(_col(retrieved), 1, k), gold))
    return F.when(F.size(gold) > 0, hit / F.size(gold)).otherwise(0.0)
