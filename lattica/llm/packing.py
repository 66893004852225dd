"""Packing documents into sequences by cutting-stock column generation (operator 6).

A document is its token ids and a closing id. Every full sequence length is cut off as a sequence of its own, and of what
remains half a sequence where there is as much: pieces of more than half cannot share a sequence. The pieces of any corpus
then have a histogram of at most half as many lengths as a sequence has tokens. On it a linear
programme over patterns (how many pieces of which lengths share a sequence) is solved by column generation: a knapsack
dynamic programme prices new patterns with the dual values of the current ones. Lengths are planned in steps of ``STEP``
tokens, which keeps the programme small; offsets are exact, so what a step wastes is padding at a sequence's end. Pattern
counts are rounded down, the few pieces that are left (no more than the patterns can hold once each) go first-fit-decreasing into further sequences,
and ranked documents of each length are handed the slots of that length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.rows import SLICE, give_back, kept, small_batches
from lattica.plans.checkpoints import cut

LENGTH = 1024
CLOSE = 0
#: Tokens in which lengths are planned.
STEP = 4
#: Columns that may be generated, and the gap to the bound at which they suffice.
COLUMNS, GAP = 1500, 5e-4
#: Pieces that are ranked together.
RANKED = 50_000
#: Stretches kept in a task's memory.
CACHE = 1 << 17
#: Unicode white space as the vocabulary's pattern has it; a stretch is a run without it and the one space before.
WHITE = "\t-\r \x85\xa0  -     　"
#: Fixed value: how the byte-level vocabulary's library cuts texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")


class Encoder(dict):
    """Ids of a text as little-endian bytes, as ``tokenizers`` gives them for a byte-level vocabulary.

    Its pattern never joins a character that is not white space to a space after it, so stretches are encoded once each
    and kept. Stretches of Latin characters, whose classes no Unicode version has changed, are merged by ``tiktoken``
    with the ranks of the same vocabulary, which answers single words faster; others, and texts with a special string,
    go to the library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != sorted(made):
            raise ValueError("merges are not in the order of their ids")
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
        self.latin = tiktoken.Encoding("stretches", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, stretch: str) -> bytes:
        try:
            stretch.encode("latin-1")
            ids = self.latin(stretch)
        except UnicodeEncodeError:
            ids = self.library.encode(stretch, add_special_tokens=False).ids
        got = array("I", ids).tobytes()
        if len(stretch) <= 32:
            if len(self) > CACHE:
                self.clear()
            self[stretch] = got
        return got

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, STRETCH.findall(text)))


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@kept
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def spans(n: int, length: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` ids is cut: full sequences, then half of one, then the rest."""
    full, half = n - n % length, length // 2
    cuts = [*range(0, full + 1, length), *([full + half] if n - full > half else []), *([n] if n > full else [])]
    return list(pairwise(cuts))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, close: int) -> Iterator[pa.RecordBatch]:
    encoder, end = encoder_of(path), np.array([close], "<u4").tobytes()
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            rows = []
            for i, t in enumerate(part.column("text")):
                ids = encoder.ids(t.as_py() or "") + end
                n = len(ids) // 4
                for at, stop in spans(n, length):
                    rows.append((i, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]), n))
            i, *rest = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            data = [part.column("doc").take(pa.array(i)), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(data, names=["doc", "start", "length", "ids_crc32", "doc_tokens"])
    give_back()


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within ``room``: its value and the count of each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(sizes[0]), room + 1):  # sizes ascend
        n = int(np.searchsorted(sizes, c, side="right"))
        gains = best[c - sizes[:n]] + values[:n]
        i = int(gains.argmax())
        best[c], took[c] = (gains[i], i) if gains[i] > best[c - 1] else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, columns: int = COLUMNS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (columns: counts of each size) and how often each is used, by the revised simplex method."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for k in range(columns):
        dual = inverse.sum(axis=0)
        value, counts = knapsack(dual, sizes, room)
        if value <= 1 + gap:  # dual / value is feasible, so no solution is better by more than this
            break
        direction = inverse @ counts
        able = np.flatnonzero(direction > 1e-9)
        ratio = x[able] / direction[able]
        out = int(able[ratio.argmin()])
        step = max(0.0, float(ratio.min()))
        x -= step * direction
        x[out] = step
        basis[:, out] = counts
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if k % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), x


def plan(histogram: dict[int, int], room: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Slots for the pieces of each planned length: first rank, first sequence and slot of runs of them; sequences in all.

    ``histogram`` counts pieces by length in steps, ``room`` is a sequence's. The ``r``-th piece of a length is in the run
    with the last first rank not above ``r``, as many sequences further as ranks, as the run's ``slot``-th piece there.
    """
    full = histogram.get(room, 0)
    sizes = np.array(sorted(k for k in histogram if k < room), np.int64)
    runs: dict[int, list[list[int]]] = {int(s): [] for s in sizes}
    used, sequence = dict.fromkeys(runs, 0), 0

    def place(counts: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        slot = 0
        for size, n in counts:
            for _ in range(n):
                runs[size].append([used[size], sequence, slot])
                used[size] += times
                slot += 1
        sequence += times

    if len(sizes):
        demand = np.array([histogram[int(s)] for s in sizes], float)
        columns, x = patterns(sizes, demand, room)
        left = demand.astype(np.int64)
        for p in range(columns.shape[1]):
            times, counts = int(np.floor(x[p] + 1e-7)), columns[:, p]
            some = counts > 0
            times = min([times, *(left[some] // counts[some]).tolist()])
            if times > 0:
                place([(int(sizes[i]), int(counts[i])) for i in np.flatnonzero(counts)], times)
                left -= times * counts
        free: list[list[int]] = []  # of opened sequences: their room and what is in them
        for i in reversed(range(len(sizes))):
            for _ in range(int(left[i])):
                fits = [b for b in free if b[0] >= sizes[i]]
                bin_ = min(fits, key=lambda b: b[0]) if fits else [room]
                if not fits:
                    free.append(bin_)
                bin_[0] -= int(sizes[i])
                bin_.append(int(sizes[i]))
        for bin_ in free:
            place([(s, 1) for s in bin_[1:]], 1)
    if full:
        runs[room] = [[0, sequence, 0]]
        sequence += full
    return {k: tuple(np.array(v, np.int64).T) for k, v in runs.items() if v}, sequence


def _placed(batches: Iterator[pa.RecordBatch], slots: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps, rank = (batch.column(c).to_numpy() for c in ("steps", "rank"))
        sequence, slot = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(steps):
            own = steps == size
            first, begin, at = slots[int(size)]
            run = np.searchsorted(first, rank[own], side="right") - 1
            sequence[own] = begin[run] + rank[own] - first[run]
            slot[own] = at[run]
        data = [*(batch.column(c) for c in ("doc", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(slot)]
        yield pa.RecordBatch.from_arrays(data, names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, close: int = CLOSE) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row a piece.

    Every id of every document is in exactly one piece and sequences hold at most ``length`` ids, gapless from offset 0.
    Null texts count as empty: one piece, the closing id. Repeated rows and rows of one key are documents of their own,
    null keys too. Only key and text are read; an empty table gives no rows. What the driver sees is one count for each
    length. Pieces are ranked by hash slices of a length, key and start, so a length that very many documents share is
    ranked in many tasks; equal rows may swap slots.
    """
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    out = "doc long, start long, length long, ids_crc32 long, doc_tokens long"
    with small_batches(df.sparkSession):
        pieces = cut(rows.mapInArrow(lambda b: _pieces(b, tokenizer, length, close), out))
    steps = pieces.withColumn("steps", F.ceil(F.col("length") / STEP).cast("int"))
    histogram = {r["steps"]: r["count"] for r in steps.groupBy("steps").count().collect()}
    slots, _ = plan(histogram, length // STEP)
    n_slices = max(1, -(-max(histogram.values(), default=1) // RANKED))
    sliced = steps.withColumn("slice", F.pmod(F.xxhash64("doc", "start"), F.lit(n_slices)).cast("int"))
    sums = cut(sliced.groupBy("steps", "slice").agg(F.count("*").alias("n")))
    before = Window.partitionBy("steps").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("steps", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("steps", "slice").orderBy("doc", "start", "doc_tokens", "ids_crc32")
    ranked = sliced.join(ahead, ["steps", "slice"]).withColumn("rank", F.col("ahead") + F.row_number().over(inside) - 1)
    shared = df.sparkSession.sparkContext.broadcast(slots)
    kept = ranked.select("doc", "start", "length", "ids_crc32", "doc_tokens", "steps", "rank")
    placed = kept.mapInArrow(lambda b: _placed(b, shared.value), f"{out}, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset")
    return placed.select(F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
