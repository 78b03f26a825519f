"""Phrase collocation mining with broadcast double-array tries.

Words are 64-bit hashes, proved different for different words before they are used. Candidates follow the
Apriori rule: a phrase can only be frequent if its words and its shorter phrases are. They are found level by
level: windows of two words are counted into hash buckets, and only windows whose bucket is
frequent become candidates; then windows of three whose two pairs passed. A bucket holds at
least its phrases' occurrences, so no frequent phrase is lost. Candidates are dealt by their first two words to shards of
bounded size, each a double-array trie that is broadcast. A task advances the states of a shard's text positions at once, one
word at a time, and counts the accepting states; the counts of tasks are summed. Only these counts decide.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.llm.words import BASE, INVERSE, mix, powers
from skyloom.plans.staging import is_empty, stage

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer candidate around it has at least so many hundredths of its occurrences.
COVERED = 50
#: Bytes of text that are worked on at a time, and words of a coded row, about; a text is always whole.
CHUNK, BLOCK, CODED = 2 << 20, 1 << 20, 1 << 12
#: Rows of a batch of texts, of coded words and of phrases: some 2, 4 and 1 MB.
TEXTS, ROWS, PHRASES = 500, 128, 10_000
#: Frequent words whose hashes may be broadcast, 32 MB. With more, words aren't filtered and pairs alone decide.
VOCABULARY = 1 << 22
#: Hash buckets of windows; a bit of each is broadcast, 16 MB.
BUCKET_BITS = 27
#: Phrases of a shard, and shards that are counted in one pass over the words. A trie takes some 35 bytes for each phrase.
SHARD, TRIES = 1 << 18, 8
#: Values of the lower letter of a word's number in a trie.
LETTERS = 256

_BREAK, _BLANK = 2, 1
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b" \t", np.uint8)] = _BLANK
_KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _BREAK


# ---- words


def _letters(seed: int, which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + mix(np.array([2 * seed + which + 1], np.uint64)))


def words_of(raw: bytes, seed: int, checked: bool = False) -> tuple[np.ndarray, ...]:
    """Start, end, number of the piece and 64-bit hash of each word of a lower-case text; with a second hash if ``checked``, else the first twice."""
    letters = [_letters(seed, k) for k in range(1 + checked)]
    data, at, piece, found = np.frombuffer(raw, np.uint8), 0, 0, []
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gaps = np.flatnonzero(_KIND[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + BLOCK)  # one word longer than a block
        part = data[at:end]
        kind = _KIND[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kind == 0, [False]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        pieces = np.cumsum(kind == _BREAK) + piece
        hashes = []
        for t in letters:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(t[part] * powers(BASE, len(part))[: len(part)], out=total[1:])
            hashes.append(mix((total[stop] - total[start]) * powers(INVERSE, len(part) + 1)[start]))
        hashes[0] = np.maximum(hashes[0], np.uint64(1))  # 0 stands for a break
        found.append((start + at, stop + at, pieces[start], hashes[0], hashes[-1]))
        at, piece = end, int(pieces[-1])
    if not found:
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    return tuple(np.concatenate(c) for c in zip(*found))


def _name(lang: str, seed: int) -> int:
    """The hash of a language's name. It begins with a line break, as no word does."""
    data = np.frombuffer(b"\n" + lang.encode("utf-8", "surrogatepass"), np.uint8)
    total = (_letters(seed, 0)[data] * powers(BASE, len(data))[: len(data)]).sum()
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0]) or 1


def _chunks(batches):
    """``(lang, bytes)``: texts of one language in lower case, with a line break after each."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A to Z only
            held.setdefault(lang.as_py(), []).append(raw)
            size += len(raw) + 64
            if size >= CHUNK:
                yield from ((k, b"\n".join(v) + b"\n") for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v) + b"\n") for k, v in held.items())


_WORD = pa.schema([("l", pa.int64()), ("h", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def _word_batches(seed: int):
    """Counts of a chunk's words, and a row for each language, of count 0. A word whose second hash isn't that of its first hash's other words has a row of count 0 too."""

    def run(batches):
        for lang, raw in _chunks(batches):
            name = _name(lang, seed)
            start, end, _, h, g = words_of(raw, seed, True)
            order = np.argsort(h)
            first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(h)))
            of = order[first]
            odd = order[g[order] != np.repeat(g[of], count)]
            of, count = np.concatenate([of, odd]), np.concatenate([count, np.zeros(len(odd), np.int64)])
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[of].tolist(), end[of].tolist())]
            hashes = h[of].view(np.int64)
            for at in range(0, len(of), 100_000):
                n = len(hashes[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.full(n, name), hashes[at : at + n], words[at : at + n], count[at : at + n]), _WORD)], schema=_WORD)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, name, "\n" + lang, 0), _WORD)], schema=_WORD)

    return run


def word_counts(docs: DataFrame, most_seeds: int = 8) -> tuple[DataFrame, int]:
    """``(l, h, word, n)`` of each language's words, and the seed under which no two words have one hash ``h``; ``l`` is the language's own."""
    for seed in range(most_seeds):
        rows = docs.mapInArrow(_word_batches(seed), "l long, h long, word string, n long")
        words = stage(rows.groupBy("l", "h", "word").agg(F.sum("n").alias("n")), "words")
        if is_empty(words.select("h", "word").distinct().groupBy("h").count().where("count > 1")):
            return words, seed
    raise ValueError("no seed keeps all words apart")


def _coded_batches(seed: int, held):
    """Rows of word hashes, eight bytes each; 0 where no phrase goes on: at breaks and for words that aren't frequent. A row ends with a break."""

    def run(batches):
        known = None if held is None else held.value
        for lang, raw in _chunks(batches):
            _, _, piece, h, _ = words_of(raw, seed)
            w = h.view(np.int64)
            if known is not None and len(known):
                w = np.where(known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w, w, 0)
            elif known is not None:
                w = np.zeros_like(w)
            w = np.append(np.insert(w, np.flatnonzero(np.diff(piece)) + 1, 0), 0)
            w = w[(w != 0) | np.concatenate([[True], w[:-1] != 0])]
            breaks = np.flatnonzero(w == 0)
            ends = breaks[np.unique(np.searchsorted(breaks, np.append(np.arange(CODED, len(w), CODED), len(w) - 1)))] + 1
            rows = [w[i:j].tobytes() for i, j in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), _name(lang, seed))), pa.array(rows, pa.binary())], names=["l", "words"])

    return run


# ---- candidates


def window_keys(l: int, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of k words without a break, and a 64-bit key of each."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    whole = w[:n] != 0
    for i in range(1, k):
        whole &= w[i : i + n] != 0
    at = np.flatnonzero(whole)
    key = np.full(len(at), l, np.int64).view(np.uint64) + np.uint64(k)
    for i in range(k):
        key = mix(key * np.uint64(BASE) + w[at + i].view(np.uint64))
    return at, key


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _on(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _safe_windows(l: int, w: np.ndarray, k: int, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of k words all of whose shorter windows passed; with ``maps`` up to k, those that passed themselves."""
    at, key = window_keys(l, w, k)
    if k > 2 and len(at):
        below, _ = _safe_windows(l, w, k - 1, maps[: k - 2])
        ok = np.zeros(len(w) + 1, bool)
        ok[below] = True
        on = ok[at] & ok[at + 1]
        at, key = at[on], key[on]
    if len(maps) >= k - 1 and len(at):
        on = _on(maps[k - 2], _bucket(key))
        at, key = at[on], key[on]
    return at, key


def _coded_rows(batches):
    """A batch's words, language by language; every row ends with a break."""
    for batch in batches:
        found: dict[int, list[np.ndarray]] = {}
        for l, words in zip(batch.column("l"), batch.column("words")):
            found.setdefault(l.as_py(), []).append(np.frombuffer(words.as_buffer(), np.int64))
        yield from ((l, np.concatenate(w)) for l, w in found.items())


@contextmanager
def short_batches(spark, most: int):
    """Within it, batches that are read from Parquet and those for Python have at most so many rows, as rows are long."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def _bits_of(part_bits: int, least: int):
    """Which buckets of a part hold ``least`` windows, from its packed counts."""
    size = 1 << BUCKET_BITS - part_bits

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for at, n in zip(rows.column("at"), rows.column("n")):
            total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<u2")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    return run


def frequent_buckets(coded: DataFrame, k: int, maps: list, least: int, words: int) -> np.ndarray:
    """A bit for each bucket: whether windows of k words fall into it ``least`` times. Its size is fixed.

    Buckets are dealt to parts, of which there are more the more words there are, so that a part's counts, about a million
    however long the corpus, are few megabytes. A batch's counts of a part are one packed row.
    """
    part_bits = min(17, max(7, (words >> 20).bit_length()))
    shift = BUCKET_BITS - part_bits

    def run(batches):
        held = [m.value for m in maps]
        for l, w in _coded_rows(batches):
            _, key = _safe_windows(l, w, k, held)
            bucket, n = np.unique(_bucket(key), return_counts=True)
            at, n = (bucket & (1 << shift) - 1).astype("<u4"), np.minimum(n, 0xFFFF).astype("<u2")
            first = np.flatnonzero(np.diff(bucket >> shift, prepend=-1))
            ends = [*first[1:].tolist(), len(bucket)]
            cut = list(zip(first.tolist(), ends))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first] >> shift), pa.array([at[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([n[i:j].tobytes() for i, j in cut], pa.binary())], names=["part", "at", "n"])

    packed = coded.mapInArrow(run, "part long, at binary, n binary")
    found = stage(packed.groupBy("part").applyInArrow(_bits_of(part_bits, least), "part long, bits binary"), "buckets")
    bits, size = np.zeros(1 << BUCKET_BITS - 3, np.uint8), 1 << shift - 3
    for part, some in found.toLocalIterator():
        bits[part * size : (part + 1) * size] = np.frombuffer(bytes(some), np.uint8)
    return bits


def candidates(coded: DataFrame, k: int, maps: list) -> DataFrame:
    """``(l, a, b, c)``: the different windows of k words that passed every bucket; 0 for no word."""

    def run(batches):
        held = [m.value for m in maps]
        for l, w in _coded_rows(batches):
            at, key = _safe_windows(l, w, k, held)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            odd = np.zeros(len(at), bool)
            odd[first] = True
            for i in range(k):  # windows of one key that differ, if there were any
                odd |= w[at + i] != w[at[first][which] + i]
            at = at[odd]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), l)), *(pa.array(w[at + i] if i < k else np.zeros(len(at), np.int64)) for i in range(MAX_WORDS))], names=["l", "a", "b", "c"])

    return coded.mapInArrow(run, "l long, a long, b long, c long").distinct()


# ---- double-array tries


def displaced(parents: np.ndarray, symbols: np.ndarray, seed: int = 1, window: int = 8192) -> tuple[np.ndarray, int]:
    """A base for each parent so that all ``base[parent] + symbol`` differ, and the array's size; parents are 0, 1, … and sorted.

    Parents of many children come first: of a window of bases, the first that fits. Those of few children draw
    their bases all at once, round by round. The array grows where too little is free.
    """
    draw = np.random.default_rng(seed)
    count = np.bincount(parents)
    first = np.cumsum(count) - count
    base, limit, widest = np.zeros(len(count), np.int64), max(16, len(parents)), int(symbols.max()) + 2 + window
    free = np.ones(2 * limit + widest, bool)

    def grown(to: int) -> tuple[int, np.ndarray]:
        return to, np.concatenate([free, np.ones(max(0, to + widest - len(free)), bool)])

    for p in sorted(np.flatnonzero(count > 8).tolist(), key=lambda p: -count[p]):
        mine = symbols[first[p] : first[p] + count[p]].tolist()
        for turn in range(1, 1 << 30):
            at = int(draw.integers(0, limit))
            fits = free[at + mine[0] : at + mine[0] + window].copy()
            for i, s in enumerate(mine[1:]):
                fits &= free[at + s : at + s + window]
                if i & 15 == 15 and not fits.any():
                    break
            if fits.any():
                break
            if turn % 3 == 0:
                limit, free = grown(limit + limit // 8)
        base[p] = at + int(fits.argmax())
        free[base[p] + np.array(mine)] = False
    for k in range(8, 0, -1):
        left, idle = np.flatnonzero(count == k), 0
        while len(left):
            places = draw.integers(0, limit, len(left))
            slots = places[:, None] + symbols[first[left][:, None] + np.arange(k)]
            ok = np.flatnonzero(free[slots].all(axis=1))
            own = np.zeros(len(ok) * k, bool)
            own[np.unique(slots[ok].reshape(-1), return_index=True)[1]] = True
            won = ok[own.reshape(-1, k).all(axis=1)]
            base[left[won]] = places[won]
            free[slots[won].reshape(-1)] = False
            idle = 0 if len(won) * 16 >= len(left) else idle + 1
            if idle >= 24:
                limit, free = grown(limit + limit // 8)
                idle = 0
            left = np.delete(left, won)
    taken = np.flatnonzero(~free)
    return base, int(taken[-1]) + 1 if len(taken) else 1


class Trie:
    """A double-array trie over 64-bit symbols. A word's number is two letters, so that rows are short and fill the array: from
    state s, letter x leads to ``base[s] + x`` if ``check`` there says s. State 0 is the root."""

    def __init__(self, phrases: np.ndarray, rows: np.ndarray):
        """``phrases`` has a row for each phrase, closed by zeros; ``rows`` is what an accepting state stands for."""
        self.symbols = np.unique(phrases[phrases != 0])
        letters = np.stack(self.letters(self.numbers(phrases)), axis=2).reshape(len(phrases), -1)
        most = int(letters.max())
        node, parents, symbols, nodes = np.zeros(len(phrases), np.int64), [], [], 1
        end = np.zeros(len(phrases), np.int64)
        for level in range(letters.shape[1]):
            on = np.flatnonzero(letters[:, level])
            edges, which = np.unique(node[on] * (most + 1) + letters[on, level], return_inverse=True)
            parents.append(edges // (most + 1))
            symbols.append(edges % (most + 1))
            node[on] = end[on] = nodes + which
            nodes += len(edges)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        inner, which = np.unique(parent, return_inverse=True)
        base, size = displaced(which, symbol)
        slot = np.concatenate([[0], base[which] + symbol])  # of every node: a node's edge is the one before its number
        self.base, self.check = np.zeros(size, np.int32), np.full(size + most + 1, -1, np.int32)
        self.base[slot[inner]] = base
        self.check[slot[1:]] = slot[parent]
        # the accepting states in order, and what each stands for
        order = np.argsort(slot[end])
        self.accept, self.rows = slot[end][order].astype(np.int32), rows[order]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers; 0 for words of no phrase."""
        at = np.minimum(np.searchsorted(self.symbols, words), len(self.symbols) - 1)
        return np.where(self.symbols[at] == words, at + 1, 0)

    @staticmethod
    def letters(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two letters of each number, from 1; 0 and 0 for the number 0."""
        return (numbers + LETTERS - 1) // LETTERS, np.where(numbers > 0, (numbers - 1) % LETTERS + 1, 0)

    def step(self, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words lead on from their states, and to which next states."""
        numbers = self.numbers(words)
        on = np.flatnonzero(numbers)
        high, low = self.letters(numbers[on])
        middle = self.base[state[on]] + high
        to = self.base[np.minimum(middle, len(self.base) - 1)] + low
        there = (self.check[middle] == state[on]) & (self.check[to] == middle)
        return on[there], to[there]

    def visited(self, first: int, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that are reached from the places of ``words``, after ``first``, and how often."""
        _, start = self.step(np.zeros(1, np.int64), np.array([first]))
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, state, found = places, np.full(len(places), start[0]), []
        for _ in range(MAX_WORDS):
            on, state = self.step(state, words[place])
            found.append(state)
            place = place[on] + 1
            inside = place < len(words)
            place, state = place[inside], state[inside]
        return np.unique(np.concatenate(found), return_counts=True)

    def count(self, first: int, words: np.ndarray, into: np.ndarray) -> None:
        """Adds to ``into`` how often each state is reached from all places of ``words``, after ``first``."""
        states, n = self.visited(first, words, np.arange(len(words)))
        into[states] += n

    def tally(self, first: int, words: np.ndarray, places: np.ndarray, into: np.ndarray) -> None:
        """Adds to ``into``, one count for each accepting state, how often it is reached from the places; most other states are halves of words."""
        states, n = self.visited(first, words, places)
        at = np.minimum(np.searchsorted(self.accept, states), len(self.accept) - 1)
        on = self.accept[at] == states
        into[at[on]] += n[on]


_PARTS = {"symbols": np.int64, "base": np.int32, "check": np.int32, "accept": np.int32, "rows": np.int64}
#: Bytes of a row of a written trie.
PIECE = 1 << 20


def _trie_of(key: tuple, shard: pa.Table) -> pa.Table:
    """The shard's trie in pieces: ``(shard, name, piece, data)``."""
    t = Trie(np.stack([shard.column(c).to_numpy() for c in ("l", "a", "b", "c")], axis=1), shard.column("row").to_numpy())
    raw = {c: getattr(t, c).astype(kind).tobytes() for c, kind in _PARTS.items()}
    cut = [(c, i, x[at : at + PIECE]) for c, x in raw.items() for i, at in enumerate(range(0, len(x), PIECE))]
    names, numbers, data = zip(*cut)
    return pa.table({"shard": pa.array([key[0].as_py()] * len(cut), pa.int64()), "name": names, "piece": pa.array(numbers, pa.int32()), "data": pa.array(data, pa.binary())})


def _shards(wanted: DataFrame, shard: int) -> int:
    return max(1, -(-wanted.count() // shard))


def written_tries(wanted: DataFrame, shards: int) -> DataFrame:
    """The tries of all shards, in pieces."""
    dealt = wanted.withColumn("shard", F.pmod(F.shiftright("a", 1).bitwiseXOR(F.col("b")), F.lit(shards)))
    return stage(dealt.groupBy("shard").applyInArrow(_trie_of, "shard long, name string, piece int, data binary"), "tries")


def _sum_of(key: tuple, some: pa.Table) -> pa.Table:
    """The counts of a part's phrases, from the packed counts of tasks."""
    join = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in some.column(c)])
    rows, which = np.unique(join("rows"), return_inverse=True)
    total = np.zeros(len(rows), np.int64)
    np.add.at(total, which, join("n"))
    return pa.table({"row": rows, "f": total})


def phrase_counts(coded: DataFrame, wanted: DataFrame, tries: DataFrame, pairs, shards: int, words: int = 0, most: int = TRIES) -> DataFrame:
    """``(l, a, b, c, f)``: the occurrences of every wanted phrase of two words or more, by the tries of ``most`` shards at a time.

    ``pairs`` has the bits of the frequent buckets of pairs. A place whose pair is in one goes to the trie of its pair's shard only.
    A task's counts of a part of a shard are one packed row; there are the more parts the more ``words`` there are.
    """
    spark, counts, parts = coded.sparkSession, None, max(1, words >> 23)
    for begin in range(0, shards, most):
        held = {}
        for i in range(begin, min(shards, begin + most)):
            got = sorted(tries.where(F.col("shard") == i).select("name", "piece", "data").toLocalIterator(), key=lambda r: r.piece)
            if got:
                held[i] = spark.sparkContext.broadcast({c: b"".join(bytes(r.data) for r in got if r.name == c) for c in _PARTS})
        if not held:
            continue

        def run(batches, held=held):
            tries = {i: Trie.__new__(Trie) for i in held}
            for i, t in tries.items():
                t.__dict__.update({c: np.frombuffer(held[i].value[c], kind) for c, kind in _PARTS.items()})
            reached = {i: np.zeros(len(t.accept), np.int64) for i, t in tries.items()}
            for l, words in _coded_rows(batches):
                at, _ = _safe_windows(l, words, 2, [pairs.value])
                of = ((words[at] >> 1) ^ words[at + 1]) % shards
                for i, t in tries.items():
                    t.tally(l, words, at[of == i], reached[i])
            for i, t in tries.items():
                on = np.flatnonzero(reached[i])
                cuts = np.searchsorted(on, np.arange(parts + 1) * len(t.accept) // parts)
                for part, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                    if x < y:
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part]), pa.array([t.rows[on[x:y]].tobytes()]), pa.array([reached[i][on[x:y]].tobytes()])], names=["shard", "part", "rows", "n"])

        packed = coded.mapInArrow(run, "shard long, part long, rows binary, n binary")
        found = stage(packed.groupBy("shard", "part").applyInArrow(_sum_of, "row long, f long"), "shard_counts")
        for b in held.values():
            b.unpersist()
        counts = found if counts is None else counts.unionAll(found)
    if counts is None:
        return spark.createDataFrame([], "l long, a long, b long, c long, f long")
    return wanted.join(counts, "row").select("l", "a", "b", "c", "f")


# ---- scores


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 a² / (left · right)) in whole numbers of 38 digits."""
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) DIV ({wide(left)} * {wide(right)})")


def scored_phrases(counts: DataFrame, least: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """``(l, a, b, c, f, left, right, score)`` of the candidates that no longer one covers."""
    part = lambda keys, name, of: counts.where(of).select(*[F.col(k).alias(k2) for k, k2 in zip(("l", "a", "b"), ("l", *keys))], F.col("f").alias(name))
    one, two = "b = 0", "b <> 0 AND c = 0"
    pairs, triples = counts.where(f"{two} AND f >= {least}"), counts.where(f"c <> 0 AND f >= {least}")
    inside = triples.select("l", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "f")
    inside = inside.groupBy("l", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max("f").alias("longer"))
    pairs = stage(pairs.join(inside, ["l", "a", "b"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * f").drop("longer"), "pairs")
    pairs = pairs.join(part(("a",), "left", one), ["l", "a"]).join(part(("b",), "right", one), ["l", "b"])
    pairs = pairs.select("l", "a", "b", "c", "f", "left", "right", _score("f", "left", "right").alias("score"))
    triples = triples.join(part(("a",), "l1", one), ["l", "a"]).join(part(("b", "c"), "r1", two), ["l", "b", "c"]).join(part(("a", "b"), "l2", two), ["l", "a", "b"]).join(part(("c",), "r2", one), ["l", "c"])
    cut = F.least(*[F.struct(_score("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("left"), F.col(f"r{k}").alias("right")) for k in (1, 2)])
    triples = triples.withColumn("cut", cut).select("l", "a", "b", "c", "f", "cut.left", "cut.right", "cut.score")
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = MIN_COUNT, covered: int = COVERED, vocabulary: int = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two and three words.

    Text is lower-cased (A to Z) and split at ``.,;:!?`` and line breaks; words lie between blanks
    and tabs. A null language is ``und``, a null text empty. ``n`` is the language's words, ``a`` the phrase's
    occurrences, at least ``least``; ``l`` and ``r`` are those of the two parts at the cut of the lowest score, which is
    floor(1000000 a² / (l r)). A phrase within a longer candidate of at least ``covered`` hundredths of its
    occurrences goes. Equal scores rank by ``a``, then by phrase. Repeated rows count each; an
    empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with short_batches(spark, TEXTS):
        words, seed = word_counts(texts)
        frequent = words.where(F.col("n") >= least)
        known = frequent.select("h").distinct()
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        held = spark.sparkContext.broadcast(np.sort(known.toArrow().column("h").to_numpy())) if known.count() <= vocabulary else None
        coded = stage(texts.mapInArrow(_coded_batches(seed, held), "l long, words binary"), "coded")
    maps, wanted = [], None
    with short_batches(spark, ROWS):
        for k in range(2, MAX_WORDS + 1):
            maps.append(spark.sparkContext.broadcast(frequent_buckets(coded, k, maps, least, total)))
            more = candidates(coded, k, list(maps))
            wanted = more if wanted is None else wanted.unionAll(more)
        wanted = stage(wanted.withColumn("row", F.monotonically_increasing_id()), "wanted")
    shards = _shards(wanted, shard)
    with short_batches(spark, PHRASES):
        tries = written_tries(wanted, shards)
    with short_batches(spark, ROWS):
        counts = stage(phrase_counts(coded, wanted, tries, maps[0], shards, total), "phrase_counts")
    none = F.lit(0).cast("long")
    counts = counts.unionAll(frequent.select("l", F.col("h").alias("a"), none.alias("b"), none.alias("c"), F.col("n").alias("f")))
    names = stage(frequent.groupBy("h").agg(F.min("word").alias("word")), "names")
    named = stage(scored_phrases(counts, least, covered), "scored")
    for c in ("a", "b"):
        named = named.join(names.select(F.col("h").alias(c), F.col("word").alias(f"{c}_word")), c)
    named = named.join(names.select(F.col("h").alias("c"), F.col("word").alias("c_word")), "c", "left")
    named = named.select("l", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "f", "left", "right", "score")
    # the first of each slice, then of each language: no language is ordered in one task
    best = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    for keys in (["l", F.pmod(F.xxhash64("phrase"), F.lit(256))], ["l"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    sizes = words.groupBy("l").agg(F.sum("n").alias("n"), F.max(F.when(F.col("h") == F.col("l"), F.substring("word", 2, 1 << 30))).alias("lang"))
    out = named.join(sizes, "l")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), F.col("left").alias("l"), F.col("right").alias("r"), "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), cuts AS (
  SELECT c.*, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, w, j, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first AND x.k = j JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest AND y.k = cuts.k - j
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1
), i AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY lang, part
), o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM b LEFT JOIN i ON b.k = 2 AND i.lang = b.lang AND i.part = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
