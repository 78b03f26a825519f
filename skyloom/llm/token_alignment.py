"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

Two tokenizers cut the same bytes. An incidence matrix has a row for each token and a column for each byte,
with a one where the token covers the byte. The product of one matrix with the other's transpose
counts the bytes that two tokens share: its entries are the overlap links. Where tokens of both end together,
the text falls into groups; the product of the two token-group matrices links all tokens of a group.
Matrices are compressed sparse rows built by hand, and products are made row by row as Gustavson does it: each entry of a left
row calls a row of the right matrix, and equal columns are summed; NumPy does so for all rows of a block of texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.packing import encoder, tokenizer_path
from skyloom.llm.rows import table
from skyloom.plans.staging import stage

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that are tokenised at a time, and bytes that are aligned at a time. Texts of any length are read whole.
BLOCK, BYTES = 1 << 20, 1 << 20
#: Different id pairs whose counts may be broadcast: 17 bytes each, 71 MB. More are joined by a shuffle.
PAIRS = 1 << 22


# ---- compressed sparse rows


@dataclass
class Csr:
    """Row r has the columns ``indices[indptr[r]:indptr[r + 1]]`` and the values beside them."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def byte_incidence(ends: np.ndarray) -> Csr:
    """Token by byte, of tokens that lie one after the other and end there."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int32), n)


def group_incidence(groups: np.ndarray, n: int) -> Csr:
    """Token by group; each token is in one."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int32), n)


def transposed(m: Csr) -> Csr:
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    rows, data = m.row_of, m.data
    if np.any(m.indices[1:] < m.indices[:-1]):
        order = np.argsort(m.indices, kind="stable")
        rows, data = rows[order], data[order]
    return Csr(indptr, rows, data, len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's product: row i of the result sums the rows k of ``b`` for the entries (i, k) of ``a``."""
    called = b.indptr[a.indices + 1] - b.indptr[a.indices]
    if len(called) and called.min() == called.max() == 1:  # each entry calls a row of one entry
        at, rows, values = b.indptr[a.indices], a.row_of, a.data
    else:
        first = np.cumsum(called) - called
        at = np.arange(int(called.sum())) + np.repeat(b.indptr[a.indices] - first, called)
        rows, values = np.repeat(a.row_of, called), np.repeat(a.data, called)
    columns, values = b.indices[at], values * b.data[at]
    key = rows * b.columns + columns
    if np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, rows, columns, values = key[order], rows[order], columns[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    summed = np.add.reduceat(values, new) if len(new) else values[:0]
    return Csr(np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(a.indptr) - 1))]), columns[new], summed, b.columns)


# ---- tokenizers


class Pieces:
    """A SentencePiece model's ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        #: whether no piece goes on over a space that follows another character, so that texts may be cut there
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of the ids' pieces."""
        return b"".join(map(self.bytes.__getitem__, ids))


_pieces: dict[str, Pieces] = {}


def blocks_of(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text cut into blocks before single spaces between other characters than white space, where neither tokenizer merges; each but the first begins with its space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                break
            if end > at and end + 1 < len(text) and not text[end - 1].isspace() and not text[end + 1].isspace():
                break
            end += 1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Pair:
    """Both tokenizers. ``ids`` gives a text's ids of either, or none where the tokens' bytes aren't those of a space and the text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a), _pieces.get(path_b) or _pieces.setdefault(path_b, Pieces(path_b))
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.a.bytes, self.b.bytes))

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        none = np.empty(0, np.int64), np.empty(0, np.int64), 0
        if not text:
            return none
        left, right, size = [], [], 0
        # a block's own space, or the one set before the text
        for i, part in enumerate(blocks_of(text) if self.b.cuts else (text,)):
            part = part[1:] if i else part
            a, b = self.a.plain_ids(" " + part), self.b.ids(part)
            want = (" " + part).encode("utf-8", "surrogatepass")
            if self.a.joined(a) != want or self.b.joined(b) != want:
                return none
            left.append(np.array(a, np.int64))
            right.append(np.array(b, np.int64))
            size += len(want)
        return np.concatenate(left), np.concatenate(right), size


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    """The Python worker's own: it lasts from task to task."""
    return _pairs.get((path_a, path_b)) or _pairs.setdefault((path_a, path_b), Pair(path_a, path_b))


# ---- alignment of a block of texts


class Alignment:
    """The links of several texts' tokens, laid one after the other."""

    def __init__(self, pair: Pair, texts: list[tuple[np.ndarray, np.ndarray, int]]):
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *(t[k] for t in texts)]) for k in (0, 1))
        self.end_a, self.end_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        overlap = product(byte_incidence(self.end_a), transposed(byte_incidence(self.end_b)))
        #: overlap links: places of both tokens, and the bytes that they share
        self.left, self.right, self.shared = overlap.row_of, overlap.indices, overlap.data
        self.together = self.end_a[self.left] == self.end_b[self.right]
        ends = self.end_a[self.left[self.together]]
        self.groups = len(ends)
        self.group_a, self.group_b = np.searchsorted(ends, self.end_a), np.searchsorted(ends, self.end_b)
        self.ends = ends

    def links(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both tokens of each link, and the bytes that they share: of tokens that overlap, that end together, or that are in one group."""
        if kind == "group":
            found = product(group_incidence(self.group_a, self.groups), transposed(group_incidence(self.group_b, self.groups)))
            left, right = found.row_of, found.indices
            start_a, start_b = self.end_a - np.diff(self.end_a, prepend=0), self.end_b - np.diff(self.end_b, prepend=0)
            shared = [np.concatenate([[0], e])[:-1] for e in (self.end_a, self.end_b)]
            both = np.minimum(self.end_a[left], self.end_b[right]) - np.maximum(shared[0][left], shared[1][right])
            return left, right, np.maximum(both, 0)
        on = self.together if kind == "end" else slice(None)
        return self.left[on], self.right[on], self.shared[on]

    def told(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2;`` of all groups, and the places in it after each group of A, and of B."""
        n = len(self.a) + len(self.b)
        code = np.empty(n, np.int64)
        count_a, count_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        before_b = np.cumsum(count_b) - count_b
        at_a, at_b = np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + np.cumsum(count_a)[self.group_b]
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        digits, size, step = _digits()
        code[at_a] = self.a + step * last_a
        code[at_b] = self.b + 2 * step * last_b
        cells = digits[code]
        after = np.cumsum(size[code])
        return cells[cells != 0].tobytes(), after, at_b


_digit_table: list = []


def _digits() -> tuple[np.ndarray, np.ndarray, int]:
    """Each number's decimal digits and a separator: a comma, from ``step`` on a bar, from twice ``step`` on a semicolon."""
    if not _digit_table:
        step = 100_000
        cells = np.zeros((3, step, 6), np.uint8)
        number = np.arange(step)
        width = np.where(number > 0, np.floor(np.log10(np.maximum(number, 1))).astype(int), 0) + 1
        for w in range(1, 6):
            on = np.flatnonzero(width == w)
            for d in range(w):
                cells[:, on, d] = 48 + number[on] // 10 ** (w - 1 - d) % 10
            for k, mark in enumerate(b",|;"):
                cells[k, on, w] = mark
        _digit_table.extend((cells.reshape(3 * step, 6), np.tile(width + 1, 3), step))
    return tuple(_digit_table)


def _aligned(batches, pair: Pair):
    """``(keys, counts of the texts' tokens, Alignment)`` of some texts at a time."""
    held, keys, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text")):
            ids = pair.ids(text.as_py())
            keys.append(key.as_py())
            held.append(ids)
            size += ids[2] + 64
            if size >= BYTES:
                yield keys, held, Alignment(pair, held)
                held, keys, size = [], [], 0
    if held:
        yield keys, held, Alignment(pair, held)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_DIGEST_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _digest_batches(path_a: str, path_b: str):
    """One row a text: counts, the digest of its groups, and its different linked id pairs with their numbers."""

    def run(batches):
        pair = tokenizer_pair(path_a, path_b)
        for keys, held, found in _aligned(batches, pair):
            left, right, _ = found.links("end")
            codes = (found.a[left] << 32) + found.b[right]
            cut = np.cumsum([t[2] for t in held])
            group_end, link_end = np.searchsorted(found.ends, cut, "right"), np.searchsorted(found.end_a[left], cut, "right")
            written, after, at_b = found.told()
            last_b = np.cumsum([len(t[1]) for t in held])
            rows, group_at, link_at, text_at = [], 0, 0, 0
            for i, (key, (a, b, _)) in enumerate(zip(keys, held)):
                mine, times = np.unique(codes[link_at : link_end[i]], return_counts=True)
                digest = ""
                if len(b):
                    end = int(after[at_b[last_b[i] - 1]])
                    digest, text_at = hashlib.sha256(written[text_at : end - 1]).hexdigest(), end
                rows.append((key, len(a), len(b), group_end[i] - group_at, link_end[i] - link_at, digest, mine, times.astype(np.int32)))
                group_at, link_at = group_end[i], link_end[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)

    return run


def pair_counts(digests: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many links hold the ids linked, and whether no id of A is linked more often with the id of B."""
    flat = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("m"))
    counts = stage(flat.groupBy("pair").agg(F.sum("m").alias("n")), "pair_counts")
    of = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(of.alias("b")).agg(F.max("n").alias("top"))
    return stage(counts.join(top, of == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair_best")


_TOLD = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _looked_up(digests: DataFrame, counts: DataFrame) -> DataFrame:
    """The texts' rows with ``n_best`` and ``count_sum``, by a sorted table that every task holds."""
    got = counts.orderBy("pair").toArrow()
    held = digests.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            edge = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[edge])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _TOLD), pa.array(total(times * best[at])), pa.array(total(times * n[at]))], names=[*_TOLD, "n_best", "count_sum"])

    return digests.select(*_TOLD, "pairs", "times").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _joined(digests: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffle of the texts' pairs, whose hot keys can be split."""
    flat = digests.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("m"))
    met = flat.join(counts, "pair")
    scored = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return digests.select("row", *_TOLD).join(scored, "row", "left").select(*_TOLD, zero("n_best"), zero("count_sum"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def token_links(docs: DataFrame, kind: str = "overlap", path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, a_at, b_at, a_id, b_id, shared)``, one row per link: places and ids of both tokens, and the bytes that both cover.

    ``kind`` is ``overlap``, ``end`` (tokens that end together) or ``group`` (tokens of one group). Texts without
    tokens, as in ``align_documents``, give no rows; rows that repeat an id each give theirs.
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"no such kind of link: {kind}")
    paths = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)

    def run(batches):
        pair = tokenizer_pair(*paths)
        for keys, held, found in _aligned(batches, pair):
            left, right, shared = found.links(kind)
            count_a, count_b = (np.array([len(t[k]) for t in held]) for k in (0, 1))
            text = np.repeat(np.arange(len(held)), count_a)[left]
            at_a, at_b = left - (np.cumsum(count_a) - count_a)[text], right - (np.cumsum(count_b) - count_b)[text]
            ids = pa.array(keys, pa.int64()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (at_a, at_b, found.a[left], found.b[right], shared))], names=["doc_id", "a_at", "b_at", "a_id", "b_id", "shared"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, shared long")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per document.

    A text that is null or empty, or whose tokens' bytes aren't those of a space and the text, has no
    tokens: zeros and an empty digest. Rows that repeat an id, or have none, each get their row and count
    each. An empty table gives no rows; other columns are ignored. Up to ``most`` different id pairs are
    looked up in a broadcast table, more in a join.
    """
    paths = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    digests = stage(_rows(docs, id_col, text_col).mapInArrow(_digest_batches(*paths), _DIGEST_DDL).withColumn("row", F.monotonically_increasing_id()), "digests")
    counts = pair_counts(digests)
    found = (_looked_up if counts.count() <= most else _joined)(digests, counts)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
