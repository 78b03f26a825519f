"""The ten operators and the pipeline: edge cases, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm import embedding_dedup, exact_dedup, language_id, licenses, line_dedup, mixing, near_dedup, packing, quality, registry, substring_dedup
from skyloom.llm.words import occurrence_labelled, shingles, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("__id", T.StringType()), T.StructField("n", T.StringType())])


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r)), len(r[1] or ""), "x", "y") for r in rows], DOCS)


def some(n, seed=1, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "..."), (None, "a null id"), (5, "twice"), (5, "twice"), (6, some(60_000, 9))]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_match_sql(spark, name):
    assert oracle.differences(spark, registry.QUERIES[name], registry.ORACLE[name], SF) == []


# ---- 6 exact dedup


def test_fingerprints_compose():
    r = random.Random(2)
    for _ in range(50):
        text = "".join(r.choice("ab \n é日") for _ in range(r.randint(0, 300)))
        assert exact_dedup.fingerprint(text, r.randint(1, 40)) == exact_dedup.fingerprint(text)
    a, b = b"left", b"and right"
    assert exact_dedup.combine(exact_dedup.chunk_hash(a), exact_dedup.chunk_hash(b), len(b)) == exact_dedup.chunk_hash(a + b)


def test_same_text_streams_chunks():
    assert exact_dedup.same_text("a b\n" * 50, "ab" * 50, 7)
    assert not exact_dedup.same_text("ab" * 50, "ab" * 49 + "ac", 7)
    assert not exact_dedup.same_text("ab" * 50, "ab" * 51, 7)


def test_exact_dedup_edges_and_huge_documents(spark):
    rows = [*ODD, (10, "x y"), (11, "xy"), (12, "x  y "), (13, "x  y ")]
    for huge in (1 << 22, 2):  # the second sends all but the shortest by way of chunks
        got = exact_dedup.exact_dedup(docs(spark, rows), huge_chars=huge).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert by[11].keep_id == 12 and by[11].group_size == 4 and not by[13].kept and by[12].kept
        assert by[1].group_size == 3 and by[3].kept and not by[1].kept
        assert sum(r.kept for r in got if r.doc_id == 5) == 1
        assert by[None].kept and by[12].text_sha256 == hashlib.sha256(b"xy").hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_collisions_are_told_apart(spark, monkeypatch):
    groups = {("aa", "bb")}
    rows = docs(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc")])
    prints = exact_dedup.fingerprints(rows).withColumn("h1", F.when(F.col("sha").isin(*[hashlib.sha256(x.encode()).hexdigest() for p in groups for x in p]), F.lit(1)).otherwise(F.col("h1"))).withColumn("h2", F.when(F.col("h1") == 1, F.lit(1)).otherwise(F.col("h2")))
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda *a, **k: prints)
    monkeypatch.setattr(exact_dedup, "_collisions", lambda *a: spark.createDataFrame([(1, 1, 2)], "h1 long, h2 long, n long"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_a_real_collision_is_told_apart_end_to_end(spark):
    a, b = "ONONQOPRQPPOPNNOQN", "RSRRPRPOOPQRPSRRPR"  # found by lattice reduction: equal modulo both primes
    assert exact_dedup.fingerprint(a)[:3] == exact_dedup.fingerprint(b)[:3]
    rows = docs(spark, [(1, a), (2, b), (3, f" {a}"), (4, b), (None, a), (6, "another")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (3, 3, False), 2: (2, 2, True), 3: (3, 3, True), 4: (2, 2, False), None: (3, 3, False), 6: (6, 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.keep_distinct(rows).collect()) == [2, 3, 6]


def test_keep_distinct_keeps_columns(spark):
    kept = exact_dedup.keep_distinct(docs(spark, [*ODD, (7, "twice")]))
    assert kept.columns == DOCS.fieldNames()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "None", "5", "6"])


# ---- 2 language identification


def test_language_profiles_hold_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op2_language_id(spark, SF).join(d, "doc_id").collect()
    out = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(got) == d.count() and sum(out) / len(out) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    model = {"en": language_id.top(*language_id.ngram_counts("the and of " * 50)).tolist(), "fr": language_id.top(*language_id.ngram_counts("été où déjà " * 50)).tolist()}
    got = language_id.predict(docs(spark, [*ODD, (7, "the and"), (8, "où été"), (9, "日本")]), model).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == by[4] == "und" and by[7] == "en" and by[8] == "fr" and len(got) == len(ODD) + 3
    assert {r.score for r in got if r.doc_id == 9} == {0.0}
    assert {r.lang_pred for r in language_id.predict(docs(spark, [(1, "a")]), {}).collect()} == {"und"}
    assert language_id.predict(docs(spark, []), model).collect() == []


def test_ngrams_of_blocks_add_up():
    text = "abc déf " * 50
    k, n = language_id.ngram_counts(text)
    assert dict(zip(k.tolist(), n.tolist()))[ord("a")] == 50 and n.sum() == 50 * (6 + 8 + 6)


def test_prediction_against_plain_python(spark):
    """Counts, ranks and distances by dictionaries, over all rows of the smallest table."""

    def grams(text):
        found = {}
        for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
            for g in [*word, *zip("_" + word, word + "_"), *zip("_" + word, word, word[1:] + "_")]:
                found[g] = found.get(g, 0) + 1
        return found

    def code(g):
        points = [0 if c == "_" else ord(c) for c in g]
        return sum(p << 21 * i for i, p in enumerate(points)) + {1: 0, 2: language_id.PAIR, 3: language_id.TRIPLE}[len(g)]

    def listed(counts):
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.TOP]

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    totals = {}
    for r in rows:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for g, n in grams(r.text).items():
                totals.setdefault(r.lang, {})[g] = totals.get(r.lang, {}).get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(listed(c))} for lang, c in totals.items()}
    got = {r.doc_id: r for r in language_id.op2_language_id(spark, SF).collect()}
    for r in rows:
        own = listed(grams(r.text))
        far = {lang: sum(abs(p[g] - i) if g in p else language_id.TOP for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang)) if own else "und"
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(1 - far[best] / (language_id.TOP * len(own)) if own else 0.0)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_ngram_counts_are_alike_wherever_blocks_are_cut(monkeypatch, block):
    r = random.Random(block)
    for _ in range(40):
        text = "".join(r.choice("aÉz ñ. \n日-") for _ in range(r.randint(0, 90)))
        want = dict(zip(*(x.tolist() for x in language_id.ngram_counts(text))))
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert dict(zip(*(x.tolist() for x in language_id.ngram_counts(text)))) == want, text
        monkeypatch.undo()


def test_a_word_across_blocks():
    text = "x" * (language_id.BLOCK - 3) + " words" + " and" * 20
    got = dict(zip(*(x.tolist() for x in language_id.ngram_counts(text))))
    assert got[ord("d")] == 21 and got[ord("o") | ord("r") << 21 | ord("d") << 42 | language_id.TRIPLE] == 1 and got[ord("d") | ord("s") << 21 | language_id.PAIR] == 1


# ---- 1 near dedup


def test_edit_distance_against_the_full_table():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(4)
    for _ in range(400):
        a = [r.randrange(6) for _ in range(r.randint(0, 90))]
        b = [x for x in a if r.random() > 0.1] + [r.randrange(6) for _ in range(r.randint(0, 4))]
        most, want = r.randint(0, 30), full(a, b)
        assert near_dedup.edit_distance(a, b, most) == (want if want <= most else None)


def test_words_and_labels():
    assert len(word_hashes("One, two; THREE\nfour-five é")) == 6
    assert (word_hashes("A b") == word_hashes("a  B!")).all()
    long = some(200_000)
    assert (word_hashes(long)[-5:] == word_hashes(" ".join(long.split()[-5:]))).all()
    assert len(set(occurrence_labelled(shingles(word_hashes("a b c d e " * 9), 5)).tolist())) == 41


def edited(text, share, seed):
    r, words = random.Random(seed), text.split()
    for i in range(int(share * len(words))):
        words[r.randrange(len(words))] = f"new{seed}x{i}"
    return " ".join(words)


def test_near_dedup_finds_copies_and_leaves_others(spark):
    base = [some(300, s, 3000) for s in range(6)]
    passage = some(120, 99, 3000)
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(base)], *[(200 + i, edited(base[0], 0.06, i)) for i in range(40)], (300, base[1].upper() + "!!"), (301, edited(base[2], 0.1, 7))]
    rows += [(400 + i, passage + " " + some(200, 500 + i, 3000)) for i in range(30)]  # a shared passage doesn't make them alike
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert {got[200 + i].class_id for i in range(40)} == {100} and got[300].class_id == 101 and got[301].class_id == 102
    assert not got[200].kept and got[100].kept and all(got[400 + i].kept for i in range(30))
    assert all(got[i].kept and got[i].class_id == i for i in (1, 2, 3, 4, 5, 6)) and got[None].class_id is None
    assert len(got) == len({r[0] for r in rows}) and near_dedup.near_dedup(docs(spark, [])).collect() == []


def classes_by_brute_force(texts):
    """The least document that links reach, where similar documents that share a sketch are linked; and the links."""
    words = {i: word_hashes(t) for i, t in texts.items()}
    keys = {i: near_dedup.order_sketches(w) >> np.uint64(near_dedup.NUMBER_BITS) for i, w in words.items()}
    ids = sorted(words)
    links = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if (keys[i] == keys[j]).any() and near_dedup.similar(words[i], words[j])]
    least, before = {i: i for i in ids}, None
    while before != least:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least, links


@pytest.mark.parametrize("block", [24, 1024])
def test_near_pairs_in_a_crowd_with_a_shared_passage(spark, monkeypatch, block):
    # pairs share 12 words besides the passage that all share: nearly all their common sketches are the crowd's
    passage = some(75, 99, 3000)
    texts = {i: " ".join([passage, some(12, 700 + i // 2, 3000), some(13, 900 + i, 3000)]) for i in range(160)}
    # longer ones of other lengths in the same buckets, some alike
    texts |= {1000 + i: " ".join([passage, some(40 + 5 * (i // 2 % 9), 1700 + i // 2, 3000)]) + f" end{i}" for i in range(90)}
    want, links = classes_by_brute_force(texts)
    assert {(i, i + 1) for i in range(0, 160, 2)} <= set(links)
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # several blocks a bucket, and one
    got = near_dedup.near_dedup(docs(spark, [*texts.items()])).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_a_bucket_of_thousands_meets_in_one_group(spark):
    rows = spark.range(3000).selectExpr("128L AS key", "id AS doc", "100 + CAST(id % 150 AS INT) AS n", "id AS cls")
    met = near_dedup._blocks(rows)
    assert met.count() == 3000 and met.select("part").distinct().count() == 1


def test_long_texts_of_few_other_words_are_told_apart_by_their_bags(monkeypatch):
    base = some(600, 5, 9000)
    words = [(word_hashes(f"{base} {some(200, 40 + i, 9000)}") >> np.uint64(33)).astype(np.int32) for i in range(40)]
    aligned = []
    monkeypatch.setattr(near_dedup, "similar", lambda a, b, real=near_dedup.similar: aligned.append(1) or real(a, b))
    n = len(words)
    keys = [list(range(i << near_dedup.NUMBER_BITS, (i << near_dedup.NUMBER_BITS) + near_dedup.SKETCHES)) for i in range(n)]
    crowd = pa.table({"key": [5] * n, "part": [0] * n, "side": pa.array([0] * n, pa.int32()), "cls": list(range(n)), "keys": pa.array(keys, pa.list_(pa.int64())), "words": pa.array(words, pa.list_(pa.int32()))})
    near_dedup._meetings(crowd)
    assert len(aligned) < n * (n - 1) / 8


@pytest.mark.parametrize("many", [5, 12, 13, 40, 200])
def test_groups_of_variants_have_one_class_at_any_size(spark, many):
    base, apart = some(150, 31, 3000), some(150, 32, 3000)
    texts = {i: edited(base if i % 2 else apart, 0.07, 40 + i) for i in range(2 * many)}
    want, _ = classes_by_brute_force(texts)
    got = near_dedup.near_dedup(docs(spark, [*texts.items()])).collect()
    assert {r.doc_id: r.class_id for r in got} == want and sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


def test_near_dedup_against_all_pairs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {r.doc_id: word_hashes(r.text) for r in d}
    parent = {i: i for i in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(words)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near_dedup.similar(words[i], words[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = near_dedup.op1_order_minhash(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in ids}


# ---- 5 mixing


def test_water_filling_and_draws(spark):
    rows = [(i, "w " * (i % 7), None, s) for i, s in enumerate(["a", "b", None, "c"] * 50)] + [(1000, None, None, "d"), (None, "x", None, "a")]
    got = mixing.plan_mixture(docs(spark, rows)).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.size * r.times
        assert r.times <= 2
    assert abs(sum(v[1] for v in by.values()) - 1.5 * sum(v[0] for v in by.values())) < 1e-6
    assert all(v[1] <= 2 * v[0] + 1e-9 and abs(v[2] - v[1]) <= 7 for v in by.values()) and len(got) == len(rows)
    assert mixing.plan_mixture(docs(spark, [])).collect() == [] and mixing.mix(docs(spark, rows)).columns == DOCS.fieldNames()


def test_rows_without_an_id_are_drawn_apart(spark):
    rows = docs(spark, [(None, f"w{i} " * 3, None, "a") for i in range(400)] + [(1, "w " * 3, None, "b"), (1, "v " * 3, None, "a")])
    got = mixing.plan_mixture(rows, weights=(1,), share=1.5).collect()
    taken, all_ = sum(r.size * r.times for r in got if r.source == "a"), sum(r.size for r in got if r.source == "a")
    assert abs(taken - 1.5 * all_) < 20 and {r.times for r in got if r.source == "a"} == {1, 2}
    assert mixing.mix(rows, weights=(1,)).count() == sum(r.times for r in got)
    sizes = mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10)], "source string, source_size long")).collect()
    assert {r.source: r.target for r in sizes} == {"a": 20.0, "b": 1490.0, "c": 20.0}  # worked by hand: a and c are clamped, b takes the rest


# ---- 4 packing


def test_encoder_equals_the_whole_text():
    e, r = packing.Encoder(packing.tokenizer_path()), random.Random(3)
    alphabet = ["a", "The", "é", " ", " ", "  ", "\n", "\n\n", ",", ".", "'s", "!!", "1", "²", "\t", "\0", "\x85", "日本", "|", "don't", "\r\n"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert e(text) == np.array(e.as_told.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_encoder_equals_the_tokenizer_on_whole_documents(spark):
    e = packing.Encoder(packing.tokenizer_path())
    assert e.ranked is not None
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert e(r.text) == np.array(e.as_told.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(e("a" * 300_000)) % 4 == 0


def test_pieces_of_one_id_are_spread_over_groups(spark, monkeypatch):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 900 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    sizes, whole = [], packing._pack_round

    def counted(items, groups, *options):
        out = whole(items, groups, *options)
        sizes.append([r["count"] for r in out.groupBy("grp").count().collect()])
        return out

    monkeypatch.setattr(packing, "_pack_round", counted)
    got = packing.pack(rows, rounds=1)
    assert got.count() == 50_000 and max(sizes[0]) < 1.2 * packing.GROUP and len(sizes[0]) == 50_000 // packing.GROUP + 1
    loads = got.groupBy("sequence_id").agg(F.sum("length").alias("load")).agg(F.max("load")).first()[0]
    assert loads <= 1024


def test_bounds_and_best_fit():
    r = np.random.default_rng(5)
    for _ in range(30):
        sizes = r.integers(1, 101, r.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(sizes, 100)
        loads = np.bincount(bins, sizes)
        assert loads.max() <= 100 and packing.lower_bound(sizes, 100) <= len(loads)
        for b in range(len(loads)):
            at = np.flatnonzero(bins == b)
            order = at[np.argsort(offsets[at])]
            assert (offsets[order] == np.concatenate([[0], np.cumsum(sizes[order])[:-1]])).all()
    assert packing.lower_bound(np.array([51] * 9), 100) == 9 and packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_packing_round_trip(spark):
    rows = docs(spark, [*ODD, *[(100 + i, some(40 + 13 * i % 700, i)) for i in range(120)]])
    pieces = packing.tokenized_pieces(rows, packing.tokenizer_path()).cache()
    got = packing.pack(pieces, group=30).collect()
    assert len(got) == pieces.count()
    e = packing.Encoder(packing.tokenizer_path())
    ids = {r.doc_id: e(r.text or "") + (2).to_bytes(4, "little") for r in rows.collect()}
    by = {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_ in by.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 1024
    alone, _ = packing.best_fit_decreasing(np.array([r.length for r in got if r.length < 1024]))
    full = sum(r.length == 1024 for r in got)
    assert full + packing.lower_bound(np.array([r.length for r in got if r.length < 1024])) <= len(by) <= full + alone.max() + 1 + 5  # small groups, so a few more than one group takes
    assert packing.pack(pieces.limit(0)).collect() == []


# ---- 8 embeddings


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_embedding_links_against_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 24))
    x = np.concatenate([x, x[:60] + 0.15 * r.normal(size=(60, 24)), x[:10]])
    rows = [(i, v.tolist(), int(i % 150 % 3)) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] + [1.0] * 23, 1), (503, [None] + [1.0] * 23, 1), (504, x[0].tolist(), None), (505, [], 1), (506, [1.0, 2.0], 1), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit("x"))
    got = {q.vec_id: q for q in embedding_dedup.embedding_dedup(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([q[2] for q in rows])
    want = ((unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert all(got[q[0]].n_links == 0 and got[q[0]].kept for q in odd if q[0]) and len(got) == len(rows) + len(odd)
    assert embedding_dedup.embedding_dedup(df.limit(0)).collect() == []


# ---- 9 substring dedup


def test_repeated_lines_go_with_their_offsets(spark):
    passage = some(60, 3)
    texts = {10: "one line of its own here\n" + passage, 11: passage.upper() + ".\nand another line of eleven words\nshort one", 12: "short one\n" + passage + "\n" + passage, 13: None, 14: "", 15: "só — não\n" + passage + "\nfim"}
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, [*texts.items(), *ODD])).collect()}
    assert got[10].text == texts[10] and got[10].n_removed == 0
    assert got[11].text == "and another line of eleven words\nshort one" and got[12].text == "short one\n" and got[15].text == "só — não\nfim"
    for k in (11, 12, 15):
        at, text = 0, ""
        for s in got[k].removed:
            text, at = text + texts[k][at : s.start], s.end
            assert s.first_doc_id == 10
        assert text + texts[k][at:] == got[k].text
    assert got[13].text is None and got[14].text == "" and substring_dedup.substring_dedup(docs(spark, [])).collect() == []


def test_passages_inside_longer_or_other_lines(spark):
    passage = some(64, 3, 3000).split()
    own = [some(30, 80 + i, 3000) for i in range(8)]
    broken = " ".join(passage[:31]) + "\n" + " ".join(passage[31:])
    texts = {20: f"{own[0]} {' '.join(passage)} {own[1]}", 21: f"{own[2]}, {' '.join(passage).upper()} - {own[3]}", 22: f"{own[4]} {broken} {own[5]}", 23: f"{own[6]} {' '.join(passage[:40])} {own[7]}", 24: "again and " * 90}
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs(spark, [*texts.items()])).collect()}
    assert got[20].text == texts[20] and got[23].text == texts[23]
    assert got[21].text.split() == f"{own[2]}, - {own[3]}".split() and got[22].text.split() == f"{own[4]} {own[5]}".split()
    assert {s.first_doc_id for k in (21, 22) for s in got[k].removed} == {20} and got[24].text.split() == ["again", "and"] * 25


def removed_by_brute_force(texts):
    """The numbers of the words that go: those of runs that an earlier document has, or the document itself before the run."""
    k = substring_dedup.PASSAGE
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts.items()}
    where = {}
    for i in sorted(words):
        for at in range(len(words[i]) - k + 1):
            where.setdefault(tuple(words[i][at : at + k]), {}).setdefault(i, at)
    gone = {i: set() for i in words}
    for i in words:
        for at in range(len(words[i]) - k + 1):
            found = where[tuple(words[i][at : at + k])]
            if min(found) < i or at >= found[i] + k:
                gone[i].update(range(at, at + k))
    return words, gone


def test_removed_words_against_brute_force(spark, monkeypatch):
    r, pool = random.Random(12), [some(r_, 300 + r_, 2000).split() for r_ in (30, 49, 50, 51, 64, 90, 140)]
    texts = {}
    for i in range(90):
        parts = []
        for j in range(r.randint(1, 5)):
            parts += [some(r.randint(0, 40), 5000 + 10 * i + j, 2000).split(), r.choice(pool) if r.random() < 0.6 else []]
        parts = [w.upper() if r.random() < 0.1 else w for p in parts for w in p]
        texts[i] = "".join(w + r.choice([" ", " ", " ", ", ", "\n", " — "]) for w in parts)
    texts |= {90: texts[7], 91: texts[8].replace(" ", "  "), 92: None, 93: "", 94: "the same again " * 70, 95: "x" * 300_000 + " " + texts[9], 96: "é" + texts[3]}
    monkeypatch.setattr(substring_dedup, "BLOCK", 1 << 10)
    words, gone = removed_by_brute_force(texts)
    got = {q.doc_id: q for q in substring_dedup.substring_dedup(docs(spark, [*texts.items()])).collect()}
    assert sum(map(bool, gone.values())) > 40 and not all(gone[i] for i in range(90))
    for i, t in texts.items():
        left = [w for n, w in enumerate(words[i]) if n not in gone[i]]
        assert re.findall(r"[^\W_]+", (got[i].text or "").lower()) == left, i
        assert (got[i].n_removed > 0) == bool(gone[i]) and (got[i].text is None) == (t is None)


def test_words_of_long_texts_are_those_of_their_blocks(monkeypatch):
    text = "Ab cd_ÉF 9x\n" * 50 + "z" * 400 + " İx ǅ"
    want = [x.tolist() for x in substring_dedup.words_of(text)]
    assert [text[a:b] for a, b in zip(*want[:2])] == re.findall(r"[^\W_]+", text)
    for block in (1, 7, 64, 399):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        assert [x.tolist() for x in substring_dedup.words_of(text)] == want


# ---- 7 and 10


def test_boilerplate_lines_of_a_host(spark):
    page = lambda i: f"<html><body><nav>Home</nav><p>Text {i}.</p><div>All rights</div></body></html>"
    rows = [(i, f"https://www.A.example/{i}", page(i)) for i in range(6)] + [(10, "https://b.example/x", page(10)), (11, None, page(11)), (12, "https://a.example/", None), (13, "no url", "")]
    got = {r.page_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0))).collect()}
    assert got[3].text == "Text 3." and got[3].n_dropped == 2 and got[3].host == "a.example"
    assert got[10].n_dropped == 0 and got[11].n_dropped == 0 and got[12].n_lines == 0 and got[13].text == ""


def test_license_texts_and_spellings(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.lower().replace("sublicense", "sub-licence").replace(",", "")), (3, mit + " And more."), (4, None), (5, ""), (6, "Some text.\n> RELEASED under the MIT Licence!\nmore"), (7, "© me\nAll rights reserved")]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got[1].license == got[2].license == "MIT" and got[3].license is None and got[6].line_licenses == ["MIT"]
    assert got[4].license is None and got[4].digest == got[5].digest == got[7].digest


PUBLISHED = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no license texts on this machine")
@pytest.mark.parametrize("file,name", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only"), ("GPL-2", "GPL-2.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")])
def test_published_license_texts_respelled(spark, file, name):
    with open(f"{PUBLISHED}/{file}", encoding="utf-8") as f:
        text = f.read()
    whole = text.replace(" license ", " licence ").replace(",", " ;").upper()
    rows = [(1, whole), (2, text + "\nand a line more"), (3, text[: len(text) // 2]), (None, text), (4, "x " * 500_000 + "\n# SPDX-License-Identifier: MPL-2.0")]
    got = licenses.license_scan(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].license == by[None].license == name and by[2].license is None and by[3].license is None
    assert ["MPL-2.0"] in [r.line_licenses for r in got if r.doc_id == 4]


@pytest.mark.parametrize("name", sorted(licenses.TEXTS))
def test_each_license_text_respelled(spark, name):
    text = licenses.TEXTS[name]
    wrapped = "   ".join(text.upper().replace(".", " . ").split(" "))
    got = licenses.license_scan(docs(spark, [(1, "© 2001 A\nAll rights reserved.\n" + wrapped), (1, text), (2, text + " or not")])).collect()
    assert sorted(str(r.license) for r in got) == sorted([name, name, "None"])


def test_scans_of_empty_tables_and_long_repeated_rows(spark):
    assert licenses.license_scan(docs(spark, [])).collect() == []
    assert line_dedup.line_dedup(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    page = "<p>Same line</p>" + "<p>" + "long " * 200_000 + "</p>"
    rows = [(1, "http://h.example/a", page)] * 5 + [(None, "http://h.example/b", "<p>Other</p>")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r.n_dropped == 2 and r.text == "" for r in got if r.page_id) and [r.text for r in got if r.page_id is None] == ["Other"]


# ---- 3 quality


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(7)
    grade = r.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([r.integers(100, 200, 20), [int(g)] if r.random() < 0.9 else []])).astype(int) for g in grade]
    w, cuts = quality.fit(rows, grade, width=256)
    score = np.array([w[x].sum() for x in rows])
    assert cuts[0] < cuts[1] and score[grade == 0].mean() < score[grade == 1].mean() < score[grade == 2].mean()
    p = quality.tail(score, cuts)
    assert (p[:, 0] >= p[:, 1]).all()


def test_fit_reaches_the_optimum_of_a_plain_search():
    r = np.random.default_rng(9)
    grade = r.integers(0, 3, 200)
    rows = [np.unique(np.concatenate([[int(g)] if r.random() < 0.7 else [], r.integers(3, 6, 2)])).astype(int) for g in grade]
    w, cuts = quality.fit(rows, grade, width=8)

    def likelihood(w, cuts):
        p = quality.tail(np.array([w[x].sum() for x in rows]), cuts)
        above = np.column_stack([np.ones(len(rows)), p, np.zeros(len(rows))])
        return np.log(np.maximum(above[np.arange(len(rows)), grade] - above[np.arange(len(rows)), grade + 1], 1e-12)).sum()

    best = likelihood(w, cuts)
    # no step along a weight or a threshold gains more than the penalty and the stopping rule allow
    for i in range(8):
        for d in (-0.5, 0.5):
            moved = w.copy()
            moved[i] += d
            assert likelihood(moved, cuts) < best + 2
    for i in range(2):
        for d in (-0.3, 0.3):
            moved = cuts.copy()
            moved[i] += d
            assert likelihood(w, np.sort(moved)) < best + 2


def test_quality_of_an_empty_table(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(d, labels)
    assert quality.score_quality(docs(spark, []), model).collect() == []
    assert quality.train(d.limit(0), labels) is None


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, labels.where("doc_id % 3 <> 0"))
    got = quality.score_quality(d, model).join(quality.grades(labels.where("doc_id % 3 = 0")), "doc_id").collect()
    clean, junk = [r.selected for r in got if r.grade == 2], [r.selected for r in got if r.grade == 0]
    assert sum(clean) / len(clean) > 0.95 and sum(junk) / len(junk) < 0.2
    assert all(r.expected_grade is not None for r in quality.score_quality(docs(spark, ODD), model).collect())
    assert [r.selected for r in quality.score_quality(docs(spark, [(1, "a")]), None).collect()] == [False]
    assert quality.train(d, labels.limit(0)) is None


def test_rows_are_numbered_by_place_or_staged(spark, tmp_path):
    from skyloom.llm.rows import keep_rows, numbered

    rows = docs(spark, [(i % 7 or None, f"t{i}", "en", "a") for i in range(500)]).repartition(5)
    rows.write.parquet(str(tmp_path / "d"))
    for at in (spark.read.parquet(str(tmp_path / "d")), rows):
        got, name = numbered(at)
        assert got.count() == got.select(name).distinct().count() == 500
        first = dict(got.select("text", name).collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        again = dict(got.select(name, "text", "doc_id").select("text", name).collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert first == again
        kept = keep_rows(got, got.where(f"{name} % 2 = 0").select(name), name)
        assert kept.columns == DOCS.fieldNames() and {r.text for r in kept.collect()} == {t for t, n in first.items() if n % 2 == 0}
    assert numbered(spark.read.parquet(str(tmp_path / "d")).limit(0))[0].count() == 0


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = docs(spark, [(1, None), (2, "..."), *[(10 + i, some(200, i, 2000), "en", "ab"[i % 2]) for i in range(30)], (50, some(200, 0, 2000), "en", "a"), (51, edited(some(200, 1, 2000), 0.05, 3), "en", "b")])
    at = rows.select("doc_id", "text", "lang", "source", "n_chars")
    ids = [{r.doc_id for r in at.collect()}]
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = f(spark, at, SF)
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append({r.doc_id for r in at.collect()})
    assert ids[1] == ids[0] - {1, 2} and ids[2] == ids[1] - {50} and ids[3] == ids[2] - {51} and ids[4] <= ids[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert {r.doc_id for r in packed.collect()} == ids[4]
    empty = rows.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, SF) if empty.columns[0] == "doc_id" else empty
    assert empty.count() == 0


def test_stages_keep_different_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [*[(None, some(60, i, 2000), "en", "a") for i in range(3)], *[(7, some(60, 10 + i, 2000), "en", "a") for i in range(3)], (8, some(60, 20, 2000), "en", "a")]
    at = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, f in corpus_pipeline.STAGES[:3]:
        at = f(spark, at, SF)
        assert sorted((str(r.doc_id), r.text) for r in at.collect()) == sorted((str(r[0]), r[1]) for r in rows), name
