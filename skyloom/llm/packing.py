"""Best-fit packing with bound-certified repacking.

Documents are tokenised, cut into pieces that fit a sequence, and dealt to groups of
bounded size. Each group is packed by best-fit decreasing. Dual-feasible functions give a
lower bound on the group's sequences: a group that meets its bound is certified and done.
The groups with a gap exchange their documents: these are dealt anew, over half as many
groups, and packed again; the new packing stands if it takes fewer sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.plans.staging import is_empty, stage

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pieces in a group of the first round, about.
GROUP = 4096
#: Times that groups with a gap exchange documents.
ROUNDS = 3


def byte_letters() -> dict[str, int]:
    """The byte for which each letter stands in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE tokenizer file's ids of a whole text.

    If the ids are numbered in the order of the merges, they serve as ranks: the pair of lowest
    rank is merged first, which the ``tiktoken`` library does at a fifth of the cost. Any other
    file is read by ``tokenizers`` itself. Called, it gives the ids as little-endian 32-bit bytes, and added tokens in the text, such as
    an end mark, are one id, as ``tokenizers`` has it; ``plain_ids`` takes them for ordinary text.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens") or ()}
        plain &= not any(t[k] for t in told.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip"))
        byte = byte_letters()
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in self.added else bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
        self.ranked = None
        ordinary = {t: i for t, i in vocab.items() if t not in self.added}
        if plain and len(ordinary) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes[i]: i for i in ordinary.values()}, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _tokenizer(self, plain: bool):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = plain
        return found

    @cached_property
    def as_told(self):
        return self._tokenizer(False)

    @cached_property
    def as_plain(self):
        return self._tokenizer(True)

    def plain_ids(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else self.as_plain.encode(text, add_special_tokens=False).ids

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of the ids' tokens."""
        return self.ranked.decode_bytes(ids) if self.ranked else b"".join(map(self.bytes.__getitem__, ids))

    def __call__(self, text: str) -> bytes:
        if not self.ranked:
            ids = self.as_told.encode(text, add_special_tokens=False).ids
        elif self.split and any(t in text for t in self.added):
            ids = [i for part in self.split.split(text) for i in ((self.added[part],) if part in self.added else self.ranked.encode_ordinary(part))]
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's own encoder: it lasts from task to task."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece: all are full but the first, which has what is left over."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each row's token ids, then the end id, in pieces."""

    def run(batches):
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = memoryview(encode(text.as_py() or "") + end)
                key = key.as_py()
                out += [(key, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE) if out else pa.RecordBatch.from_pylist([], schema=_PIECE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by the best of three families of dual-feasible functions.

    A function u is dual feasible if sizes that fit one bin have values that sum to at most
    the capacity; then the values' sum over the capacity bounds the bins from below.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(object)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # large sizes take a whole bin, small ones nothing
    for least in range(1, capacity // 2 + 1):
        value = np.where(size > capacity - least, capacity, np.where(size >= least, size, 0))
        best = max(best, -(-int((count * value).sum()) // capacity))
    # sizes rounded down to multiples of the (k + 1)-th part, except exact multiples; scaled by k
    for k in range(1, 33):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and its offset there; larger first, each into the fullest bin that it fits."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    there = 0  # bit r is set if some bin has room r
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                there ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        room -= size
        if room:
            with_room[room].append(at)
            there |= 1 << room
    return bins, offsets


_PACKED = "number long, doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, bins long, bound long"


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "number"], ascending=[False, True])
        sizes = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(sizes, capacity)
        return pdf.assign(bin=bins, offset=offsets, bins=int(bins.max()) + 1, bound=lower_bound(sizes, capacity))

    return run


def _pack_round(items: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """Deal the pieces over so many groups by a seeded hash of their numbers and pack each group."""
    dealt = items.select("number", "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(_pack_group(capacity), _PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS, seed: int = 11) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every sequence holds at most ``capacity`` tokens.

    A group is about ``group`` pieces of the whole table and at most 2^rounds as many later,
    whatever the size of the table. Pieces are staged with a number of their own and dealt by it,
    so that rows of one id, or of none, are spread; they are pieces of their own. An empty table
    gives no rows.
    """
    pieces = stage(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    items = pieces.where(F.col("length") < capacity)
    groups = items.count() // group + 1
    done = []
    packed = stage(_pack_round(items, groups, seed, capacity), "packed")
    for turn in range(1, rounds + 1):
        gaps = packed.where("bins > bound")
        if groups < 2 or is_empty(gaps):
            break
        groups = max(1, gaps.agg(F.count_distinct("grp")).first()[0] // 2)
        again = stage(_pack_round(gaps, groups, seed + turn, capacity), "repacked")
        if _bins(again) >= _bins(gaps):
            break
        done.append(_numbered(packed.where("bins <= bound"), turn))
        packed = again
    out = full.select(*_OUT)
    for part in [*done, _numbered(packed, rounds + 1)]:
        out = out.unionByName(part.select(*_OUT))
    return out


_OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _bins(packed: DataFrame) -> int:
    return packed.groupBy("grp").agg(F.max("bins").alias("bins")).agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]


def _numbered(packed: DataFrame, turn: int) -> DataFrame:
    """Even sequence numbers: 4 bits of the round, the group, 24 bits of the bin."""
    return packed.withColumn("sequence_id", 2 * (F.lit(turn << 57) + F.shiftleft("grp", 24) + F.col("bin")))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack all rows of ``docs``; a null text is empty and so just the end id."""
    return pack(tokenized_pieces(docs, path or tokenizer_path(), capacity=capacity), capacity)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
