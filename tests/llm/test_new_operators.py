"""Collocations, token alignment and URL filters: edge cases and brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from skyloom.llm import collocations, packing, token_alignment, url_filter
from skyloom.llm.packing import tokenizer_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("l", T.StringType()), T.StructField("h", T.StringType()), T.StructField("row", T.StringType()), T.StructField("pairs", T.StringType()), T.StructField("rank", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (3 - len(r)), *"vwxyz") for r in rows], DOCS)


# ---- 11 collocations


def phrases_of(rows, least=10, top=2000, covered=50):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    longer = {p: a for p, a in f.items() if len(p) == 4 and a >= least}
    for p, a in f.items():
        if len(p) < 3 or a < least:
            continue
        if len(p) == 3 and any(q[0] == p[0] and p[1:] in (q[1:3], q[2:4]) and 100 * b >= covered * a for q, b in longer.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        found[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def texts(seed, n, words=12):
    r = random.Random(seed)
    vocabulary = ["a", "B", "ab", "é", "É", "\u2028", "\U0001f600", "ÿ", "x-y", "New", "York", "City"][:words]
    return "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b", " "]) for _ in range(n))


def test_collocations_match_brute_force(spark):
    rows = [(i, texts(i, r), [None, "und", "en", "EN", ""][i % 5]) for i, r in enumerate([0, 1, 2, 30, 500, 3000, 400, 20, 900, 40, 3000])]
    rows += [(None, None, "en"), (5, "new york city " * 40, "en"), (5, "new york city " * 40, "en"), (6, "...,,,", None), (7, "a " * 5000, "fr")]
    want = phrases_of(rows)
    assert len(want) > 100
    assert {tuple(r) for r in collocations.collocations(docs(spark, rows)).collect()} == want
    small = collocations.collocations(docs(spark, rows), vocabulary=3, shard=7, top=50)
    assert {tuple(r) for r in small.collect()} == phrases_of(rows, top=50)
    assert collocations.collocations(docs(spark, rows).limit(0)).collect() == []
    assert collocations.collocations(docs(spark, [(1, "one two three", "en")])).collect() == []


def test_scores_pass_64_bits(spark):
    wide = 9_000_000_000_000
    counts = spark.createDataFrame([(1, 2, 0, 0, wide + 7), (1, 3, 0, 0, wide + 1), (1, 2, 3, 0, wide)], "l long, a long, b long, c long, f long")
    (row,) = collocations.scored_phrases(counts).collect()
    assert row.score == 1_000_000 * wide * wide // ((wide + 7) * (wide + 1))


@pytest.mark.parametrize("seed", range(4))
def test_trie_counts_as_a_dictionary(seed):
    r = np.random.default_rng(seed)
    symbols = r.integers(-(1 << 62), 1 << 62, 40)
    phrases = {tuple(symbols[r.integers(0, 40, 1 + k)]) + (0,) * (3 - k) for k in (1, 2, 3) for _ in range(300)}
    phrases = np.array(sorted(phrases))
    t = collocations.Trie(phrases, np.arange(len(phrases)))
    words = symbols[r.integers(0, 40, 5000)] * r.integers(0, 2, 5000)
    for first in (*symbols[:6], np.int64(5)):
        reached = np.zeros(len(t.base), np.int64)
        t.count(first, words, reached)
        got = {int(r): int(reached[s]) for s, r in zip(t.accept, t.rows) if reached[s]}
        seen = collections.Counter((first, *words[i : i + k], *(0,) * (3 - k)) for k in (1, 2, 3) for i in range(len(words) - k + 1) if (words[i : i + k] != 0).all())
        assert got == {i: seen[tuple(p)] for i, p in enumerate(phrases) if seen[tuple(p)]}


def test_words_over_block_edges_are_whole(monkeypatch):
    raw = texts(3, 400).encode().lower() + b"q" * 100 + b" end"
    whole = collocations.words_of(raw, 0, True)
    for size in (7, 16, 33):
        monkeypatch.setattr(collocations, "BLOCK", size)
        for a, b in zip(collocations.words_of(raw, 0, True), whole):
            assert (a == b).all()


def test_coded_rows_are_short_and_end_with_a_break(monkeypatch):
    monkeypatch.setattr(collocations, "CODED", 50)
    raw = [texts(i, 4000) for i in range(3)] + ["a " * 300, "", "..", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(raw)), pa.array(raw)], names=["lang", "text"])
    out = [np.frombuffer(r.as_py(), np.int64) for b in collocations._coded_batches(0, None)([batch]) for r in b.column("words")]
    whole = np.concatenate(out)
    _, _, piece, h, _ = collocations.words_of("\n".join(raw).encode().lower(), 0)
    assert (whole[whole != 0] == h.view(np.int64)).all()
    assert all(w[-1] == 0 and (len(w) <= 100 or (w[50:-1] != 0).all()) for w in out)
    assert sum((w == 0).sum() for w in out) == len(np.unique(piece))


def test_packed_counts_of_tasks_are_summed():
    pack = lambda *x: np.array(x, "<i8").tobytes()
    got = collocations._sum_of((0, 0), pa.table({"rows": [pack(5, 9), pack(9, 1 << 40)], "n": [pack(1, 2), pack(30, 4)]}))
    assert got.to_pydict() == {"row": [5, 9, 1 << 40], "f": [1, 32, 4]}


def test_shards_are_counted_in_one_pass(spark, monkeypatch):
    passes, stage = [], collocations.stage
    monkeypatch.setattr(collocations, "stage", lambda df, name: passes.append(name) or stage(df, name))
    rows = [(i, texts(i, 3000), ["en", "fr"][i % 2]) for i in range(4)]
    for most in (1, 8):
        passes.clear()
        monkeypatch.setattr(collocations.phrase_counts, "__defaults__", (0, most))
        assert {tuple(r) for r in collocations.collocations(docs(spark, rows), shard=60).collect()} == phrases_of(rows)
        assert passes.count("shard_counts") == 1 if most > 1 else passes.count("shard_counts") > 1


# ---- 12 token alignment


def aligned(texts):
    """Groups and links from the spans of tokens, text by text, with the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    letters, names = packing.byte_letters(), {i: t for t, i in a_model.get_vocab().items()}
    piece = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    told, counts = [], collections.Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            told.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[i], b[end_b.index(e)]) for i, e in enumerate(end_a) if e in end_b]
        ends = [e for e in end_a if e in end_b]
        groups = ";".join(",".join(str(i) for i, e in zip(a, end_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, end_b) if lo < e <= hi) for lo, hi in zip([0, *ends], ends))
        counts.update(links)
        told.append((len(a), len(b), len(ends), links, groups))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if t is None else (*t[:3], len(t[3]), sum(counts[x] == top[x[1]] for x in t[3]), sum(counts[x] for x in t[3]), hashlib.sha256(t[4].encode()).hexdigest()) for t in told]


TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b   c", "<|endoftext|> and </s><unk> <0x41>", "▁ is a piece", "naïve Ünïcödé 日本語のテキスト \U0001f600\U0001f468\u200d\U0001f469", "tab\tnew\nline\r\n", "don't we're 12345 3.14", "\x00\x01\x1f", "e\u0301 ﬁ ½ Ａ", "twice", "twice", "the end " * 300, "x" * 3000]


def test_alignment_matches_spans(spark):
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab é日 \n.'0\U0001f600▁\u00a0") for _ in range(r.randint(1, 80))) for _ in range(150)]
    frame = docs(spark, [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)])
    want = sorted(zip([-1 if i % 9 == 0 else i // 2 for i in range(len(texts))], aligned(texts)))
    for most in (token_alignment.PAIRS, 0):
        got = [(-1 if r.doc_id is None else r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in token_alignment.align_documents(frame, most=most).collect()]
        assert sorted(got) == want
    assert token_alignment.align_documents(frame.limit(0)).collect() == []


def test_long_texts_are_cut_where_no_token_goes_on(monkeypatch):
    pair = token_alignment.tokenizer_pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    text = " lead" + " ".join(t for t in TEXTS if t and "▁" not in t) + "  trail  "
    assert pair.b.cuts
    whole = pair.ids(text)
    monkeypatch.setattr(token_alignment, "BLOCK", 9)
    monkeypatch.setattr(token_alignment.blocks_of, "__defaults__", (9,))
    assert len(list(token_alignment.blocks_of(text))) > 100
    assert all(np.array_equal(a, b) for a, b in zip(pair.ids(text), whole))


@pytest.mark.parametrize("seed", range(5))
def test_gustavson_product_is_the_matrix_product(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 3, (7, 11)) * r.integers(0, 2, (7, 11)), r.integers(0, 3, (11, 5)) * r.integers(0, 2, (11, 5))

    def csr(m):
        rows, columns = np.nonzero(m)
        return token_alignment.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), columns, m[rows, columns], m.shape[1])

    def dense(c):
        out = np.zeros((len(c.indptr) - 1, c.columns), np.int64)
        out[c.row_of, c.indices] = c.data
        return out

    assert (dense(token_alignment.product(csr(a), csr(b))) == a @ b).all()
    assert (dense(token_alignment.transposed(csr(a))) == a.T).all()


def test_links_of_each_kind(spark):
    frame = docs(spark, [(1, "unbelievable naïveté"), (2, None), (3, "日本 text")])
    rows = {k: token_alignment.token_links(frame, k).collect() for k in ("overlap", "end", "group")}
    of = lambda k: {(r.doc_id, r.a_at, r.b_at) for r in rows[k]}
    assert of("end") <= of("overlap") <= of("group") and {r.doc_id for r in rows["group"]} == {1, 3}
    assert {(r.doc_id, r.a_at, r.b_at) for r in rows["group"] if r.shared} == of("overlap")
    assert sum(r.shared for r in rows["overlap"] if r.doc_id == 1) == len(" unbelievable naïveté".encode())
    with pytest.raises(ValueError):
        token_alignment.token_links(frame, "other")


# ---- 13 URL filter

URLS = [
    ("http://NET/", "net/", "block"), ("http://a.net", None, "allow"), ("http://a.NET/x", "net/", "block"), ("x://example.net/en/", "example.net/en/", "allow"), ("ftp://q.example.net/en", "net/", "block"),
    ("http://a.org/fr/?x", "org/fr/", "allow"), ("http://a.org?/fr/", None, "allow"), ("http://example.com/de/#a", "example.com/de/", "block"), ("http://xexample.com/de/", None, "allow"), (None, None, "allow"), ("", None, "allow"),
    ("no scheme", None, "allow"), ("a://b://c.net/d", None, "allow"), ("http://.net/", "net/", "block"), ("http://é.NET/en/É\n/", "net/", "block"), ("http://" + "a." * 2000 + "net/" + "b/" * 20_000, "net/", "block"),
    ("http://www.spam-farm.example.com/a/?utm_source=x&b=1#t", None, "block"), ("https://m.spam-farm.example.com/a.html?b=1", None, "block"), ("https://m.fine.example.com/a.html?b=1", None, "allow"), ("http://net:80/", None, "allow"), ("http://NET/", "net/", "block"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i // 2, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, row string")


def test_rules_and_lists(spark):
    frame = pages(spark, [u for u, *_ in URLS])
    got = url_filter.filter_urls(frame, url_filter.rules_table(spark), url_filter.listed_urls(frame)).collect()
    assert sorted((r.page_id, r.rule or "", r.verdict) for r in got) == sorted((i // 2, rule or "", verdict) for i, (_, rule, verdict) in enumerate(URLS))
    assert {r.verdict for r in url_filter.filter_urls(frame, url_filter.rules_table(spark).limit(0), url_filter.listed_urls(frame).limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(frame.limit(0), url_filter.rules_table(spark), url_filter.listed_urls(frame)).collect() == []


def test_rules_without_closing_slash_and_ties(spark):
    rules = url_filter.rules_table(spark, (("a.b", "/ads", "block"), ("b", "", "allow"), ("b", "/x/y", "allow"), ("a.b", "/q/", "allow"), ("a.b", "/q/", "block"), ("b", None, "block")))
    frame = pages(spark, ["s://a.b/adsense", "s://a.b/ad", "s://c.b", "s://b/x/yz/", "s://a.b/q/1"])
    got = url_filter.filter_urls(frame, rules, url_filter.listed_urls(frame)).collect()
    assert sorted((r.path, r.rule, r.verdict) for r in got) == [("", "b", "allow"), ("/ad", "b", "allow"), ("/adsense", "a.b/ads", "block"), ("/q/1", "a.b/q/", "block"), ("/x/yz/", "b/x/y", "allow")]


def test_bloom_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    held, blocks = url_filter.bloom_filter(keys)
    assert url_filter.passing(keys, "key", held, blocks).count() == 5000
    assert url_filter.passing(spark.range(20_000).selectExpr("concat('other', id) AS key"), "key", held, blocks).count() < 200
    crowded, blocks = url_filter.bloom_filter(keys, 4)
    assert blocks == 4 and url_filter.passing(keys, "key", crowded, blocks).count() == 5000
