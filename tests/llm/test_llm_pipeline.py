"""The pipeline's stages, each on what the one before has kept, and its odd rows."""

import tracemalloc
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import jaccard, marks, packing, quality, rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == documents.columns
        seen[name], docs = (docs, after), after
    before, after = seen["near_dedup"]
    texts = {}
    for r in before.orderBy("doc_id").collect():
        texts.setdefault(r["text"], r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} <= set(texts.values())
    before, after = seen["substring_dedup"]
    assert before.count() == after.count()
    before, after = seen["mix_sources"]
    words = lambda df: sum(len(t.encode().split()) for (t,) in df.select("text").collect())
    assert abs(words(after) - 1.5 * words(before)) <= before.select("source").distinct().count()
    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] > 0


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", None, "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, None, None, "b", 0)]
    rows += [(k, f"Some plain words of document {k} that are long enough, and then {k} more to go.", "en", "a", 1) for k in (3, 3, 4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS taken", "2 AS own", "3 AS copy", "4 AS size", "5 AS row_doc", "6 AS mark", "7 AS text_of_row")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name != "packing":
                assert out.columns == frame.columns
            n = out.count()
            if frame is not docs:
                assert n == 0
            elif name == "near_dedup":
                # wordless texts are one group, as are the two equal rows of key 3 and each text of a null key
                kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
                words = {r[1] for r in rows if r[1]}
                assert [t for _, _, t in kept if t] == sorted(words, key=lambda t: next(i for i, k in enumerate(kept) if k[2] == t)) and sum(not t for _, _, t in kept) == 1
            elif name == "substring_dedup":
                assert n == len(rows)
            elif name == "packing":
                assert sum(r["start"] == 0 for r in out.collect()) == len(rows)


def test_near_dedup_by_similarity(spark, documents):
    """Edited copies go, whatever bits they differ in; groups agree with brute force over all pairs, in small blocks too."""
    import itertools

    from lattica.llm.jaccard import near_copies, shingles

    words = [f"w{i}" for i in range(300)]
    changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    rows = [(1, changed()), (2, changed(50, 150)), (3, changed(50, 150, 250, 280)), (4, changed(*range(0, 300, 20))), (5, "few words"), (6, "Few  words"), (7, None), (8, "")]
    rows += [(100 + i, changed(i, 299 - i)) for i in range(60)]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in documents.orderBy("doc_id").limit(300).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k: set(shingles(t).tolist()) for k, t in rows}
    up = {k: k for k in held}

    def top(k):
        return k if up[k] == k else top(up[k])

    for a, b in itertools.combinations(sorted(held), 2):
        both = len(held[a] & held[b])
        if 5 * both >= 4 * (len(held[a]) + len(held[b]) - both):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    want = {k: top(k) for k in held}
    got = {}
    for r in near_copies(docs, block=8).collect():  # the stage below has whole blocks
        got.setdefault(r["component"], set()).add(r["key"])
    assert {min(x): x for x in got.values()} == {k: {x for x in want if want[x] == k} for k in set(want.values())}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(want.values()) and 2 not in kept and 4 in kept


def test_near_dedup_keeps_different_texts_of_a_key(spark):
    """Rows are judged by key and text: only copies go, equal rows stay once, a null key is the smallest, other columns may be named anything."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(7, "one text of the key", "a"), (7, "a wholly different text", "b"), (7, "one text of the key", "c"), (None, long, "d"), (3, long, "e"), (2, long + " more", "f")]
    rows += [(None, "null key alone", "g"), (None, "null key alone", "h"), (9, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").selectExpr("*", "1 AS key", "2 AS twin", "3 AS component", "mark AS n")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"] or -1, r["text"]) for r in got.collect()))
    assert kept == sorted([(7, rows[0][1]), (7, rows[1][1]), (-1, long), (-1, "null key alone"), (9, "alone")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_near_copies_in_bounded_memory(spark):
    """A block's pairs are looked at in small pieces, and batches are small only while the stage works."""
    rng, n = np.random.default_rng(2), 3000
    parity = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * jaccard.PARITY), pa.array(rng.integers(0, 1 << 62, n * jaccard.PARITY)))
    zero = pa.array(np.zeros(n, np.int64))
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.full(n, 100)), parity], names=["shingle", "part_lo", "part_hi", "node", "root", "n", "parity"])
    tracemalloc.start()
    assert list(jaccard._pairs(iter([batch]), Fraction("0.8"))) == []
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with rows.small_batches(spark):
        assert spark.conf.get(name) == f"{rows.BATCH}b"
    assert spark.conf.get(name) == before


def test_workers_keep_one_operators_objects(spark):
    """A worker that has packed holds no encoder any more when it turns to other texts."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    for _ in range(2):
        packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count()
        held = rows.each_text(docs, "text", lambda: lambda t: (packing.encoder_of.cache_info().currsize,), "n int")
        assert {r["n"] for r in held.collect()} == {0}


def test_split_leaves_rows_in_the_jvm(spark):
    """Both sides together are the table, whatever its columns; only marks go to Python."""
    data = [(i, None if i % 5 == 0 else f"t{i}", i * 7) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, mark long").repartition(3)
    keys = df.where("doc_id % 3 = 0").select("doc_id")
    sides = marks.split(df, F.xxhash64("doc_id"), marks.bitmap(keys, F.xxhash64("doc_id")))
    free, marked = ([tuple(r) for r in side.collect()] for side in sides)
    assert sorted(map(str, free + marked)) == sorted(map(str, data))
    assert {i for i, *_ in marked} >= set(range(0, 300, 3)) and len(marked) < 110
    assert all(s.columns == df.columns and "MapInArrow" not in s._jdf.queryExecution().toString() for s in sides)


def test_pairs_come_from_the_first_shared_shingle(spark, monkeypatch):
    """However many shingles two sets share, blocks make their pair once, and none that the shared shingle's places exclude."""
    names = ["shingle", "part_lo", "part_hi", "node", "root", "n", "parity", "place", "before"]

    def pairs(rows):
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        columns = [pa.array([r[i] for r in rows]) for i in range(6)] + [lists([[0] * jaccard.PARITY] * len(rows)), pa.array([r[6] for r in rows]), lists([r[7] for r in rows])]
        made = jaccard._pairs(iter([pa.RecordBatch.from_arrays(columns, names=names)]), Fraction("0.8"))
        return [tuple(x.values()) for batch in made for x in batch.to_pylist()]

    # nodes 101 and 102 share 1, 2 and 3; 103 has 2 at a place that leaves too few members to share
    rows = [(1, 0, 0, 101, 101, 100, 0, [101, 101]), (1, 0, 0, 102, 102, 100, 3, [9, 102])]
    rows += [(2, 0, 0, 101, 101, 100, 4, [1, 101]), (2, 0, 0, 102, 102, 100, 5, [8, 1]), (2, 0, 0, 103, 103, 100, 12, [103, 103])]
    rows += [(3, 0, 0, 101, 101, 100, 5, [2, 1]), (3, 0, 0, 102, 102, 100, 6, [2, 8])]
    assert pairs(rows) == [(101, 102)]
    assert sorted(pairs([(*r[:6], 11, [r[3]] * 2) for r in rows])) == [(101, 102)] * 3 + [(101, 103), (102, 103)]

    # texts below the similarity that share most of their shingles
    text = lambda k: " ".join(f"x{k}-{i}" if i % 40 == 20 else f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(k, text(k)) for k in range(60)], "doc_id long, text string")
    made, plain = spark.sparkContext.accumulator(0), jaccard._pairs

    def counted(batches, t):
        for x in plain(batches, t):
            made.add(x.num_rows)
            yield x

    monkeypatch.setattr(jaccard, "_pairs", counted)
    assert jaccard.near_copies(docs).select("component").distinct().count() == 60
    assert made.value <= 60 * 59 // 2


def test_driver_gives_back_what_training_took(spark, documents, monkeypatch):
    """After the fit the driver's freed memory goes back to the system, before the later stages run."""
    calls, model = [], quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    monkeypatch.setattr(quality, "give_back", lambda: calls.append(1))
    quality.filtered(documents, model)
    quality.quality(documents, model)
    assert len(calls) == 2
