"""Windows, vectors, running best, the command line, against plain versions."""

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest

from lattica import __main__ as cli
from lattica.functions.vectors import embed
from lattica.operators import retrieval, segmentation


def plain_windows(counts, budget, overlap):
    out, a = [], 0
    while a < len(counts):
        b = a + 1
        while b < len(counts) and sum(counts[a : b + 1]) <= budget:
            b += 1
        out.append((a, b))
        if b == len(counts):
            break
        back = b
        while back > a + 1 and sum(counts[back:b]) < overlap:
            back -= 1
        a = max(a + 1, back if sum(counts[back:b]) >= overlap else a + 1)
    return out


def test_windows_against_plain_greedy():
    rng = np.random.default_rng(2)
    for _ in range(500):
        counts = rng.integers(1, 40, rng.integers(1, 30)).tolist()
        got = segmentation.spans_of(counts, [5] * len(counts), 60, int(rng.integers(1, 30)) if rng.random() < 0.5 else 12)
        starts = [a for a, *_ in got]
        assert starts[0] == 0 and got[-1][1] == len(counts) and starts == sorted(set(starts))
        for a, b, n, c in got:
            assert n == sum(counts[a:b]) and c == 6 * a and (n <= 60 or b == a + 1)
    for _ in range(300):
        counts = rng.integers(1, 40, rng.integers(1, 30)).tolist()
        assert [(a, b) for a, b, *_ in segmentation.spans_of(counts, [1] * len(counts), 60, 12)] == plain_windows(counts, 60, 12)
    assert segmentation.spans_of([], [], 10, 2) == []


def test_embed_against_plain_counts(spark):
    texts = {1: "The cat, the CAT; a dog2", 2: None, 3: "", 4: "é!", 5: "word " * 5000}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    for r in embed(rows, "id", "text", 16).collect():
        v = [0.0] * 16
        for w, n in Counter(re.findall("[a-z0-9]+", (texts[r["id"]] or "").lower())).items():
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += n
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        assert r["embedding"] == pytest.approx([x / size for x in v])
    assert embed(rows.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("owner", [None, "doc"])
def test_running_best_against_all_products(spark, owner):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 4)), 1)  # many ties
    q = np.round(rng.normal(size=(7, 4)), 1)
    items = spark.createDataFrame([(f"i{k:05d}", x[k].tolist(), int(k % 37)) for k in range(3000)], "item string, embedding array<double>, doc long").repartition(3)
    asked = spark.createDataFrame([(k, q[k].tolist()) for k in range(7)], "qid long, embedding array<double>")
    got = {}
    for r in retrieval.dense_topk(items, "item", asked, "qid", 12, owner=owner).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["item"], round(r["sim"], 9))
    for k in range(7):
        sims = sorted((-round(float(x[i] @ q[k]), 9), f"i{i:05d}", i % 37) for i in range(3000))
        if owner:
            first = {}
            for s, i, d in sims:
                first.setdefault(d, (s, d, i))
            sims = [(s, i) for s, d, i in sorted(first.values())]
        assert [got[k][r] for r in range(1, 13)] == [(i, -s) for s, i, *_ in sims[:12]]


def test_command_line(spark, tmp_path):
    docs = [{"title": f"Title {w}", "text": f"The {w} stands in the {w} garden. Nothing else is said of it.", "idx": i} for i, w in enumerate(["Alphaville", "Betatown", "Gammaburg", "Deltaport"])]
    asks = [{"id": 0, "question": "What stands in the Gammaburg garden?", "paragraphs": [{"title": docs[2]["title"], "text": docs[2]["text"], "is_supporting": True}]}]
    (tmp_path / "c.json").write_text(json.dumps(docs))
    (tmp_path / "q.json").write_text(json.dumps(asks))
    args = ["evaluate", "--corpus", str(tmp_path / "c.json"), "--questions", str(tmp_path / "q.json"), "--index", str(tmp_path / "i"), "--out", str(tmp_path / "o"), "--retrieval-top-k", "3"]
    cli.run(cli.parser().parse_args(args), spark)
    meta = {r["name"]: r["rows"] for r in cli.readers.index_meta(spark, str(tmp_path / "i")).collect()}
    assert meta["docs"] == meta["passages"] == 4
    documents = spark.read.json(str(tmp_path / "o/documents"))
    assert documents.where("rank = 1").first()["doc_idx"] == 2 and documents.count() == 3
    assert spark.read.json(str(tmp_path / "o/metrics")).first()["recall_1"] == 1.0


def test_tokenizer_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    from lattica.config import Config
    from lattica.functions.tokens import tokenizer_counts

    path = tokenizers.path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    text = "One short sentence. Another rather unusual sentence follows here! And a third?"
    docs = segmentation.corpus(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    made = segmentation.passages(docs, Config(chunk_tokens=10, chunk_overlap=0), tokenizer_counts(path)).orderBy("chunk_idx").collect()
    assert [s for r in made for s in r["sentences"]] == ["One short sentence.", "Another rather unusual sentence follows here!", "And a third?"]
    assert [r["token_count"] for r in made] == [sum(len(model.encode(s)) for s in r["sentences"]) for r in made]
