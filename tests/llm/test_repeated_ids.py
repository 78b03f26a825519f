"""Ids on several rows with different texts or vectors, shuffled; ids of added tokens; the recall of sketches."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from skyloom.llm import embedding_dedup, near_dedup, packing, quality, substring_dedup
from skyloom.llm.words import word_hashes

TEXT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("id", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TEXT).coalesce(1)


def some(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n))


P, Q, R = some(90, 1), some(90, 2), some(90, 3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_dedup_of_repeated_ids(spark, seed):
    rows = [(5, P), (6, P + " x"), (6, Q), (7, Q), (8, R), (8, R), (9, R + " y"), (9, None), (10, None), (10, some(80, 7)), (None, P), (11, "")]
    random.Random(seed).shuffle(rows)
    got = {(r.doc_id, r.class_id, r.kept) for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert got == {(5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (9, 8, False), (10, 10, True), (11, 11, True), (None, None, True)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_embeddings_of_repeated_ids(spark, seed):
    a, b = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b, "x"), (4, None, "x"), (4, b, "x"), (5, a, None), (5, a, "x")]
    random.Random(seed).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(frame).collect()}
    # of id 1 the lesser vector counts, b
    assert got == {(1, 2, 1, True), (2, 1, 2, True), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 2, False)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup_of_repeated_ids(spark, seed):
    rows = [(1, P), (2, P), (2, Q), (3, R + "\n" + Q), (3, R), (None, P)]
    random.Random(seed).shuffle(rows)
    got = sorted(((r.doc_id or 0), r.n_removed, r.text) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect())
    twice = [r for r in rows if r[0] == 3]
    # of the rows of document 3, the first in the table keeps what both have
    third = [(3, 1, R + "\n"), (3, 1, "")] if twice[0][1] != R else [(3, 0, R), (3, 1, "")]
    assert got == sorted([(0, 0, P), (1, 0, P), (2, 1, ""), (2, 0, Q), *third])


def test_quality_sample_is_bounded(spark, monkeypatch):
    frame = docs(spark, [(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 8)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grade: seen.append(len(rows)))
    quality.train(frame, labels, sample=3)
    quality.train(frame, labels, sample=100)
    assert seen == [3, 7]


ENDS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "in<|endoftext|>side", "  <|endoftext|>  ", "<|endoftext|", "plain text", "", "a\n<|endoftext|>'s"]


def test_added_tokens_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    told = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    assert encode.ranked is not None
    slow = packing.Encoder(path)
    slow.ranked = None
    for text in ENDS:
        want = np.array(told.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text) == want == slow(text)
    rows = packing.tokenized_pieces(docs(spark, list(enumerate(ENDS))), path).collect()
    assert {r.doc_id: r.length for r in rows} == {i: len(told.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(ENDS)}


@pytest.mark.parametrize("words", [60, 150, 500])
def test_sketches_find_pairs_at_the_threshold(words):
    r, hits = random.Random(words), 0
    for _ in range(150):
        a = [str(r.random()) for _ in range(words)]
        b = list(a)
        for i in r.sample(range(words), words // 5):
            b[i] = str(r.random())
        one, two = (near_dedup.order_sketches(word_hashes(" ".join(w).replace(".", ""))) for w in (a, b))
        hits += bool((one == two).any())
    assert hits / 150 >= 0.9


def test_license_query_names_planted_texts(spark, tmp_path):
    import oracle

    from skyloom.llm import licenses

    rows = []
    for i, (name, text) in enumerate(sorted(licenses.TEXTS.items())):
        rows += [(3 * i, text), (3 * i + 1, "Copyright (c) 2020 Someone\n\n" + text.upper().replace(".", " . ")), (3 * i + 2, text + "\none more line")]
    rows += [(None, None), (None, ""), (1000, "Copyright 2020 me"), (0, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.license) for r in licenses.op10_license_scan(spark, str(tmp_path)).collect()}
    for i, (name, _) in enumerate(sorted(licenses.TEXTS.items())):
        assert {(3 * i, name), (3 * i + 1, name), (3 * i + 2, None)} <= got
    assert (1000, None) in got and (None, None) in got
    assert oracle.differences(spark, licenses.op10_license_scan, licenses.OP10_SQL, str(tmp_path)) == []


def test_quality_rows_are_those_of_a_plain_computation(spark):
    sf = "/root/testdata/sf0.001"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, cuts = quality.train(frame, labels)
    got = {r.doc_id: r for r in quality.score_quality(frame, (weights, cuts)).collect()}
    weights = weights.astype(np.float32).astype(np.float64)
    for r in frame.collect():
        score = sum(weights[i] for i in quality.features(r.text).tolist())
        over = [1 / (1 + np.exp(-(score - c))) for c in cuts]
        assert got[r.doc_id].expected_grade == pytest.approx(sum(over)) and got[r.doc_id].p_top == pytest.approx(over[-1]) and got[r.doc_id].selected == (over[-1] >= 0.5)


@pytest.mark.parametrize("seed", range(30))
def test_bound_and_packing_enclose_the_best_packing(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 20), r.randint(5, 10)]) for _ in range(r.randint(1, 9))]

    def fits(left, rooms):
        """Whether the sizes, largest first, fit the bins with that room."""
        if not left:
            return True
        return any(fits(left[1:], rooms[:i] + (room - left[0],) + rooms[i + 1 :]) for i, room in enumerate(rooms) if room >= left[0] and room not in rooms[:i])

    best = next(n for n in range(1, 10) if fits(sorted(sizes, reverse=True), (20,) * n))
    bins, offsets = packing.best_fit_decreasing(np.array(sizes), 20)
    assert packing.lower_bound(np.array(sizes), 20) <= best <= bins.max() + 1
    spans = sorted((b, o, o + s) for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes))
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(spans, spans[1:])) and all(e <= 20 for *_, e in spans)


@pytest.mark.parametrize("width", [24, 64, 256, 768])
def test_vectors_near_the_threshold_meet_at_any_width(width):
    r = np.random.default_rng(width)
    a, z = r.normal(size=(2, 150, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    one, two = embedding_dedup.buckets(a), embedding_dedup.buckets(b)
    assert ((one[:, :, :1] == two) | (two[:, :, :1] == one)).any(axis=(1, 2)).mean() >= 0.95
