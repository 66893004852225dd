"""Exact token counts of every prefix of a text (operator 1).

A prefix of a text under byte-pair encoding ends in exactly one piece ``t`` for which the rest is itself an encoded
prefix and the two pieces stay apart when they are encoded together. That makes the counts of all prefixes a dynamic
programme over positions: ``count[i] = count[j] + 1`` for the one ``j`` whose last piece is compatible with
``text[j:i]``. Truncation ("how much of this fits in 4096 tokens") and budgets ("how many tokens up to here") are then
look-ups, without encoding anything again.

No piece holds a space mark after another character, or two neighbours that no piece has side by side; texts are cut
there, the programme runs once per distinct stretch and task, and counts of a text are sums over its stretches.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.rows import each_text

MARK = "▁"
#: Stretches kept in a task's memory; the table starts afresh beyond that.
CACHE = 400_000
#: Longer stretches are cut further, and kept only while short.
LONG = 24
SHORT = (2, 1)
#: Characters of a stretch after which the programme's state is kept.
HEAD = 6


class PrefixCounter:
    """Counts of the prefixes of texts under one sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [
            i
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        # a space stands for the mark, so that texts of one byte a character stay so
        self.score = {model.id_to_piece(i).replace(MARK, " "): model.get_score(i) for i in plain}
        #: By piece: which pieces may stand before it.
        self.after: dict[str, dict[str, bool]] = {piece: {} for piece in self.score}
        self.pairs = 0
        self.heads: dict[str, tuple[list[int], list[str]]] = {}
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        #: By the last three characters: the lengths to try, longest first.
        self.ends = {k: (*sorted(v, reverse=True), *SHORT) for k, v in ends.items()}
        self.beside = {a + b for piece in self.score for a, b in pairwise(piece)}
        if any(a != " " and b == " " for a, b in self.beside) or any("\n" in p for p in self.beside):
            raise ValueError("the model has pieces across a space or a line end")
        if model.encode("  a") != model.encode("  a".replace(" ", MARK)) or len(model.encode("ﬁ")) < 1:
            raise ValueError("the model rewrites texts")
        self.stretch = re.compile(" +[^ \n]*|[^ \n]+|\n")
        self.known: dict[str, bytes | tuple[int, ...]] = {}

    def encode(self, s: str) -> list[str]:
        """Plain merging by score, leftmost first; used for pairs of pieces only."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                score = self.score.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, a: str, b: str) -> bool:
        """Whether piece ``b`` is encoded by itself after ``a`` (at the start: at all)."""
        if a and a[-1] + b[0] not in self.beside:
            return self._stay("", b)
        return self.encode(a + b) == ([a, b] if a else [b])

    def prefixes(self, s: str) -> bytes | tuple[int, ...]:
        """Counts for the prefixes of lengths 1, 2, ... of a stretch."""
        n, begun = len(s), 0
        if n > HEAD and (got := self.heads.get(s[:HEAD])):  # the programme goes on from a prefix it has seen
            begun, count, last = HEAD, [*got[0], *[0] * (n - HEAD)], [*got[1], *[""] * (n - HEAD)]
        else:
            count, last = [0] * (n + 1), [""] * (n + 1)
        after, ends = self.after, self.ends
        for i in range(begun + 1, n + 1):
            for k in ends.get(s[i - 3 : i] if i > 2 else "", SHORT):
                j = i - k
                if j < 0:
                    continue
                piece = s[j:i]
                pairs = after.get(piece)
                if pairs is None:
                    if k > 1:
                        continue
                    count[i], last[i] = count[j] + len(piece.encode()), piece
                    break
                before = last[j]
                ok = pairs.get(before)
                if ok is None:
                    self.pairs += 1
                    if self.pairs > 2 * CACHE:
                        self.pairs = 0
                        for x in after.values():
                            x.clear()
                    ok = pairs[before] = self._stay(before, piece)
                if ok:
                    count[i], last[i] = count[j] + 1, piece
                    break
            else:  # pragma: no cover
                raise AssertionError("no encoding of a prefix")
        if n > HEAD and not begun:
            if len(self.heads) > CACHE // 4:
                self.heads.clear()
            self.heads[s[:HEAD]] = count[: HEAD + 1], last[: HEAD + 1]
        return bytes(count[1:]) if n <= LONG else tuple(count[1:])

    def _cut(self, s: str) -> list[str]:
        ends = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.beside]
        return [s[a:b] for a, b in pairwise([0, *ends, len(s)])]

    def _of(self, s: str) -> bytes | tuple[int, ...]:
        got = self.known.get(s)
        if got is not None:
            return got
        if len(s) <= LONG:
            if len(self.known) > CACHE:
                self.known.clear()
            got = self.known[s] = self.prefixes(s)
            return got
        parts = self._cut(s)
        if len(parts) == 1:
            return self.prefixes(s)
        out: list[int] = []
        for part in parts:
            base = out[-1] if out else 0
            out += [base + x for x in (self._of(part) if len(part) <= LONG else self.prefixes(part))]
        return tuple(out)

    def _stretches(self, text: str) -> list[str]:
        return self.stretch.findall(" " + text.replace(MARK, " ")) if text else []

    def total(self, text: str) -> int:
        known, n = self.known, 0
        for s in self._stretches(text):
            got = known.get(s)
            n += (got or self._of(s))[-1]
        return n

    def table(self, text: str) -> list[int]:
        """Counts for prefixes of 0, 1, ... characters: one entry more than the text has characters."""
        out, base = [0], 0
        for k, s in enumerate(self._stretches(text)):
            got = self._of(s)
            out += [base + x for x in (got[1:] if k == 0 else got)]  # the first mark is not of the text
            base += got[-1]
        return out

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        ends, base, best = 0, 0, 0
        for k, s in enumerate(self._stretches(text)):
            got = self._of(s)
            own = got[1:] if k == 0 else got
            if base > limit + 1:  # a longer prefix has at most as many tokens fewer as one stretch can merge away
                break
            for i, x in enumerate(own, 1):
                if base + x <= limit:
                    best = ends + i
            base, ends = base + got[-1], ends + len(own)
        return best


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> PrefixCounter:
    """One counter a worker process: what it has learnt serves the next task too."""
    return PrefixCounter(model_path)


def prefix_tokens(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns and ``prefix_tokens array<int>``: entry ``i`` is the count of the first ``i`` characters.

    Null and empty texts have the one entry 0. Rows are never merged: repeated rows give repeated results.
    """

    def make():
        counter = counter_of(model_path)
        return lambda t: (counter.table(t or ""),)

    return each_text(df, text, make, "prefix_tokens array<int>", keep)


def tokens_before(prefix_tokens: str, n_chars) -> F.Column:
    """Count of the first ``n_chars`` characters, from a stored table; the whole text's beyond its end."""
    table = F.col(prefix_tokens)
    return F.element_at(table, F.least(F.lit(n_chars) + 1, F.size(table)).cast("int"))


def chars_within(prefix_tokens: str, budget: int) -> F.Column:
    """Length of the longest prefix of at most ``budget`` tokens, from a stored table."""
    fits = F.transform(F.col(prefix_tokens), lambda x, i: F.when(x <= budget, i))
    return F.coalesce(F.array_max(fits), F.lit(0))


def token_counts(
    df: DataFrame, model_path: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Kept columns, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``chars_in_limit`` of every text.

    ``n_tokens`` is the last entry of the text's prefix table, which is summed over its stretches and not stored here.
    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows, null keys and any other columns are left as they are;
    an empty table gives an empty result.
    """

    def make():
        counter = counter_of(model_path)

        def run(t):
            t = t or ""
            n = counter.total(t)
            return len(t.encode()), n, n > limit, len(t) if n <= limit else counter.fitting(t, limit)

        return run

    return each_text(df, text, make, "n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long", keep)
