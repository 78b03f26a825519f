"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch is drawn for each of many permutations: the two shingles of five words, labelled
by occurrence, that come first in the permutation, in the order in which they stand in the
text. Equal sketches make two documents candidates; their word sequences are then aligned
within the band that the threshold allows. Documents are similar if the edit distance of
their words is at most a fifth of the longer one's length.

The work follows documents of different words only: copies are one node. What is asked for is
the classes: the components of the graph that joins every two similar documents which share a
sketch. A bucket that holds few documents gives all its pairs by a join; in a larger one all
documents are compared with the first. Components of these links settle most large buckets,
which then hold one class. In the others every two documents of different classes still meet:
the bucket is dealt into blocks, and each two blocks whose lengths allow it meet in one group,
which compares what has no earlier sketch in common. So no class depends on a bucket's size. No
bucket is ever gathered; the comparisons in one grow with the square of the documents that
belong to different classes and have about one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import flagged, keep_rows, numbered, table
from skyloom.llm.words import BASE, mix, occurrence_labelled, shingles, word_hashes
from skyloom.operators.graph import connected_components
from skyloom.plans.staging import is_empty, stage

#: Words in a shingle.
WORDS = 5
SIMILARITY = 0.8
#: Sketches of a document. Two documents whose shingles agree to the share J have one alike with probability 1 - (1 - J²)^SKETCHES, about. So many are the fewest eights that find over 0.9 of the pairs at the similarity 0.8, whatever their length.
SKETCHES = 88
#: Last bits of a sketch that its number replaces.
NUMBER_BITS = 7
#: A bucket up to this size gives all its pairs at once.
SMALL = 12
#: Documents, and words, of a block of a larger one, on average. Bags of two blocks take some 40 MB.
BLOCK, BLOCK_WORDS = 4096, 1 << 20
#: Bins of a document's bag of words, and of the coarse one.
BINS, COARSE = 2048, 128

_multipliers = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(BASE)).astype(np.uint32) | np.uint32(1)


def order_sketches(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The order sketches of a word sequence, one for each permutation; empty if it has no word."""
    items = occurrence_labelled(shingles(words, k))
    n = len(items)
    if not n:
        return np.empty(0, np.uint64)
    low = (items >> np.uint64(32)).astype(np.uint32)
    first, second = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    step = max(1, min(SKETCHES, (1 << 16) // n))  # so many permutations at a time stay in the cache
    for at in range(0, SKETCHES, step):
        ranks = low * _multipliers[at : at + step, None]
        rows = np.arange(len(ranks))
        first[at : at + step] = a = ranks.argmin(axis=1)
        if n > 1:
            ranks[rows, a] = 0xFFFFFFFF
        second[at : at + step] = ranks.argmin(axis=1)
    left, right = items[np.minimum(first, second)], items[np.maximum(first, second)]
    return mix(left * np.uint64(BASE) + mix(right) + np.arange(SKETCHES, dtype=np.uint64))


def edit_distance(a: np.ndarray | list, b: np.ndarray | list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most ``most``, else None.

    Bit-parallel dynamic programming, one column for each item of ``b``, over a band of rows
    within ``most`` of the diagonal. Rows enter the band's foot with the distance of going on
    down, and leave it at the head, where the distance goes on by one; both only overestimate
    paths that leave the band, so what is found up to ``most`` is exact.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return None
    a, b = list(a), list(b)
    head = 0
    while head < min(m, n) and a[head] == b[head]:
        head += 1
    foot = 0
    while foot < min(m, n) - head and a[m - 1 - foot] == b[n - 1 - foot]:
        foot += 1
    a, b = a[head : m - foot], b[head : n - foot]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) if max(m, n) <= most else None
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    block = max(32, most // 2)
    lo, hi, up, down, score = 0, 0, 0, 0, 0  # rows lo..hi are in the band; score is the distance at row hi
    for at in range(0, n, block):
        end = min(m, at + block + most)
        if end > hi:
            up |= ((1 << end - hi) - 1) << hi - lo
            score += end - hi
            hi = end
        start = max(0, min(at - most, hi - 1))
        if start > lo:
            up, down, lo = up >> start - lo, down >> start - lo, start
        full, last = (1 << hi - lo) - 1, 1 << hi - lo - 1
        for x in b[at : at + block]:
            eq = (where.get(x, 0) >> lo) & full
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(across | up))
            minus = up & across
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            plus = plus << 1 | 1
            minus <<= 1
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical & full
    return score if hi == m and score <= most else None


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most (1 - threshold) of the longer sequence's length."""
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # replacing word by word and adding the rest bounds it from above
    short = min(len(a), len(b))
    if np.count_nonzero(a[:short] != b[:short]) + abs(len(a) - len(b)) <= most:
        return True
    # words that one has and the other lacks bound the distance from below
    both = np.sort(np.concatenate([occurrence_labelled(x.astype(np.uint64)) for x in (a, b)]))
    if max(len(a), len(b)) - int((both[1:] == both[:-1]).sum()) > most:
        return False
    return edit_distance(a.tolist(), b.tolist(), most) is not None


def _sketch_batches(batches):
    for batch in batches:
        count, one, two, keys = [], [], [], []
        for text in batch.column("text"):
            words = word_hashes(text.as_py())
            count.append(len(words))
            placed = mix(words + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(BASE))
            one.append(int(placed.sum().astype(np.int64)))
            two.append(int(mix(placed ^ np.uint64(BASE)).sum().astype(np.int64)))
            keys.append(order_sketches(words).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "h1", "h2", "keys"])


def _buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, doc, n, centre, nc)`` of the buckets up to SMALL, and of the larger ones; the centre is the first document, of nc words."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("centre"), F.min_by("n", "doc").alias("nc")).where("size > 1")
    # staged, so that the join has a shuffle of its own, whose hot keys can be split
    held = stage(rows.join(stage(sizes, "sizes"), "key"), "buckets")
    return held.where(F.col("size") <= SMALL), held.where(F.col("size") > SMALL)


def _buckets_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The small and the large buckets of all sketches."""
    # a sketch's number replaces the last bits of its hash, so that it needs no column
    at = F.posexplode("keys").alias("at", "key")
    return _buckets(nodes.select(F.col("id").alias("doc"), F.col("n").cast("int").alias("n"), at).select("doc", "n", (F.shiftleft(F.shiftright("key", NUMBER_BITS), NUMBER_BITS) + F.col("at")).alias("key")))


def _lengths_allow(x: str, y: str) -> F.Column:
    return F.greatest(x, y) - F.least(x, y) <= (1 - SIMILARITY) * F.greatest(x, y) + 1e-9


def _all_pairs(small: DataFrame) -> DataFrame:
    """Each pair once for each bucket of at most SMALL documents, lengths permitting."""
    left, right = small.select("key", F.col("doc").alias("a"), F.col("n").alias("na")), small.select("key", F.col("doc").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "key").where(F.col("a") < F.col("b")).where(_lengths_allow("na", "nb")).select("a", "b")


def _class_of(rows: DataFrame, doc: str, classes: DataFrame, name: str) -> DataFrame:
    """``rows`` with the class of their document: its component, or itself if nothing links to it."""
    held = classes.select(F.col("node").alias(doc), F.col("component").alias(name))
    return rows.join(held, doc, "left").withColumn(name, F.coalesce(name, doc))


def _unsettled(large: DataFrame, star: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, doc, n, cls)`` of the large buckets whose documents aren't all of one class."""
    apart = _class_of(_class_of(star.select("a", "b"), "a", classes, "ca"), "b", classes, "cb").where("ca <> cb")
    loose = large.join(apart.select(F.col("a").alias("centre"), F.col("b").alias("doc")), ["centre", "doc"], "left_semi")
    held = large.select("key", "doc", "n").join(stage(loose.select("key").distinct(), "loose"), "key", "left_semi")
    return stage(_class_of(held, "doc", classes, "cls"), "unsettled")


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows once for each meeting of two blocks of their bucket: ``part`` names it, ``side`` is 0 or 1.

    A bucket of up to BLOCK documents is one block. A larger one has blocks for each band of
    lengths; a similar document's length lies in the same band or in a neighbouring one.
    """
    band = F.floor(F.log(1 / SIMILARITY, F.col("n"))).cast("int")
    cells = rows.withColumn("band", band).groupBy("key", "band").agg(F.count("*").alias("of"), F.sum("n").alias("words"))
    cells = cells.withColumn("blocks", F.ceil(F.greatest(F.col("of") / BLOCK, F.col("words") / BLOCK_WORDS)).cast("long"))
    # so many bands as there are powers of 1.25 below the longest text
    bands = cells.groupBy("key").agg(F.sum("of").alias("all"), F.sum("words").alias("all_words"), F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    one = (F.col("all") <= BLOCK) & (F.col("all_words") <= BLOCK_WORDS)
    # the second key, which follows from the first, gives the join a shuffle of its own, whose hot keys can be split
    half = F.pmod("key", F.lit(2))
    dealt = rows.withColumn("band", band).withColumn("half", half).join(bands.withColumn("half", half), ["key", "half"])
    count = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0).cast("long"))
    name = lambda b, h: F.shiftleft(b.cast("long"), 24) + h
    meet = lambda left, right, side: F.struct((F.shiftleft(left, 32) + right).alias("part"), F.lit(side).cast("int").alias("side"))
    numbers = lambda b: F.filter(F.sequence(F.lit(-1).cast("long"), count(b) - 1), lambda h: h >= 0)
    own, mine = F.col("band"), F.pmod(F.xxhash64("doc"), F.greatest(count(F.col("band")), F.lit(1).cast("long")))
    same = F.transform(numbers(own), lambda h: F.when(mine <= h, meet(name(own, mine), name(own, h), 0)).otherwise(meet(name(own, h), name(own, mine), 1)))
    above = F.transform(numbers(own + 1), lambda h: meet(name(own, mine), name(own + 1, h), 0))
    below = F.transform(numbers(own - 1), lambda h: meet(name(own - 1, h), name(own, mine), 1))
    parts = F.when(one, F.array(meet(F.lit(0).cast("long"), F.lit(0).cast("long"), 0))).otherwise(F.concat(same, above, below))
    return dealt.select("key", "doc", "cls", F.explode(parts).alias("p")).select("key", "p.part", "p.side", "doc", "cls")


def _meetings(table: pa.Table) -> pa.Table:
    """The pairs of classes that one meeting of two blocks joins: of documents whose first common sketch is the bucket's."""
    at = int(table.column("key")[0].as_py()) & (1 << NUMBER_BITS) - 1
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, SKETCHES) >> NUMBER_BITS
    side, words = table.column("side").to_numpy(), [w.values.to_numpy() for w in table.column("words")]
    names, cls = np.unique(table.column("cls").to_numpy(), return_inverse=True)
    n = np.array([len(w) for w in words])
    bags = np.empty((len(words), BINS), np.int16)
    for i, w in enumerate(words):  # cut counts differ by no more than whole ones, and fit when added up
        bags[i] = np.minimum(np.bincount(w & BINS - 1, minlength=BINS), BINS - 1)
    coarse = bags.reshape(len(words), BINS // COARSE, COARSE).sum(axis=1, dtype=np.int16)
    alone = int(table.column("part")[0].as_py()) >> 32 == int(table.column("part")[0].as_py()) & 0xFFFFFFFF
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    found = []
    for turn, i in enumerate(left.tolist()):
        on = right[turn + 1 :] if alone else right
        most = np.floor((1 - SIMILARITY) * np.maximum(n[on], n[i]) + 1e-9)
        ok = (cls[on] != cls[i]) & (np.abs(n[on] - n[i]) <= most)
        on, most = on[ok], most[ok]
        # the bags of hashed words differ by no more than the words do, so no similar pair goes here
        ok = (np.abs(coarse[on] - coarse[i]).sum(axis=1) + np.abs(n[on] - n[i])) / 2 <= most
        ok[ok] = (keys[on[ok], :at] != keys[i, :at]).all(axis=1)
        on, most = on[ok], most[ok]
        on = on[(np.abs(bags[on] - bags[i]).sum(axis=1) + np.abs(n[on] - n[i])) / 2 <= most]
        for j in on.tolist():
            if cls[j] != cls[i] and similar(words[i], words[j]):
                found.append((names[cls[i]], names[cls[j]]))
                cls[cls == cls[j]] = cls[i]
    return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})


def _class_links(rows: DataFrame, nodes: DataFrame, words: DataFrame) -> DataFrame:
    """``(a, b)``: classes that similar documents of one large bucket join."""
    held = flagged(nodes.select(F.col("id").alias("doc"), "keys"), "doc", rows.select("doc").distinct(), "may").where("may").drop("may")
    met = _blocks(rows).join(held.join(words.withColumnRenamed("id", "doc"), "doc"), "doc")
    return met.select("key", "part", "side", "cls", "keys", "words").groupBy("key", "part").applyInArrow(_meetings, "a long, b long").distinct()


def _word_batches(batches):
    for batch in batches:
        words = [(word_hashes(x.as_py()) >> np.uint64(33)).astype(np.int32) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.int32()))], names=["id", "words"])


def _word_table(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, words)`` of the wanted documents; most others aren't hashed again."""
    found = flagged(rows, "id", ids, "may").where("may").select("id", "text").mapInArrow(_word_batches, "id long, words array<int>")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs whose word sequences are similar."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("wa"), batch.column("wb")
            ok = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id)`` of every document with words; a class is named by its smallest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sketched = stage(rows.mapInArrow(_sketch_batches, "id long, n long, h1 long, h2 long, keys array<long>").where("n > 0"), "sketches")
    firsts = stage(sketched.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "firsts")
    # only words that several documents share are joined; all others are nodes by themselves
    shared = firsts.where("copies > 1").select("h1", "h2", "n", "node")
    copies = stage(sketched.select("id", "h1", "h2", "n").join(shared, ["h1", "h2", "n"]).where("id <> node").select("id", "h1", "h2", "node").distinct(), "copies")
    maybe = flagged(sketched, "id", copies.select("id"), "may")
    nodes = maybe.where("NOT may").unionAll(maybe.where("may").join(copies, ["id", "h1", "h2"], "left_anti").select(*maybe.columns)).select("id", "n", "keys")
    small, large = _buckets_of(nodes)
    star = stage(large.where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b"), F.col("nc").alias("na"), F.col("n").alias("nb")).distinct(), "star")
    pairs = stage(_all_pairs(small).unionAll(star.where(_lengths_allow("na", "nb")).select("a", "b")).distinct(), "pairs")
    ends = pairs.select("a", "b").unionAll(star.select("a", "b"))
    ids = stage(ends.select(F.col("a").alias("id")).unionAll(ends.select("b")).distinct(), "wanted")
    words = stage(_word_table(rows, ids), "words")
    classes = stage(connected_components(_verified(pairs, words), "a", "b"), "classes")
    more = stage(_class_links(_unsettled(large, star, classes), nodes, words), "class_links")
    of_node = sketched.select("id", "h1", "h2").join(copies, ["id", "h1", "h2"], "left").select("id", F.coalesce("node", "id").alias("node"))
    of_node = _class_of(of_node, "node", classes, "cls")
    if not is_empty(more):
        of_node = _class_of(of_node, "cls", connected_components(more, "a", "b"), "joined").withColumn("cls", F.col("joined"))
    return of_node.groupBy("id").agg(F.min("cls").alias("class_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, kept)``, one row per document.

    ``class_id`` is the smallest id that links between similar documents reach; ``kept`` is true
    for one row of each class. Links themselves aren't counted: a pair whose documents are
    of one class already need not be compared. A null text, an empty text, one without any word,
    and a null id link with nothing: each is a class of its own (a null id has a null class).
    Documents of the same words are one class. Rows that repeat an id are one document with all
    their texts: it links with whatever any of them links with. An empty table gives no rows.
    """
    rows, number = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    ids = rows.select(F.col(number).alias("__row"), "doc_id")
    found = near_duplicate_classes(rows.where("doc_id IS NOT NULL"), number).withColumnRenamed("id", "__found")
    placed = ids.where("doc_id IS NOT NULL").join(found, F.col("__row") == F.col("__found"), "left").select("doc_id", F.coalesce("class_id", "__row").alias("cls"))
    placed = stage(placed, "classes_of_rows")
    # an id whose rows are of several classes joins these
    joins = placed.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("top")).where("a <> top")
    joins = stage(placed.join(joins, "doc_id").where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "joined_by_id")
    if not is_empty(joins):
        placed = _class_of(placed, "cls", connected_components(joins, "a", "b"), "whole").withColumn("cls", F.col("whole"))
    names = stage(placed.groupBy("cls").agg(F.min("doc_id").alias("class_id")), "class_names")
    told = placed.select("doc_id", "cls").distinct().join(names, "cls").select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"))
    return told.unionAll(ids.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that stand for their class of near duplicates."""
    rows, number = numbered(docs)
    found = near_duplicate_classes(rows, number)
    classes = rows.select(F.col(number).alias("__row")).join(found, F.col("__row") == F.col("id"), "left").select("__row", F.coalesce("class_id", "__row").alias("class_id"))
    ranked = rows.select(F.col(number).alias("__row"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(number).alias("row")).alias("rank"))
    best = classes.join(ranked, "__row").groupBy("class_id").agg(F.min("rank").alias("best")).select("best.row")
    return keep_rows(rows, best, number)


def op1_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
