"""Substring dedup by hashes of texts, lines and passages.

The units are whole texts and lines of at least PASSAGE words, and every run of PASSAGE words
wherever lines break. A unit's normal form is its lower-case words; digests of 95 bits are grouped
over the whole corpus. The unit of the smallest document, then of the first place, stays, and
all words of the others go. What is removed is told as character offsets into the original text.

Not every run is shuffled. Marks, the least hashes of SEED-word runs, tell which runs can recur:
each run of PASSAGE words holds one, and equal runs hold the same. Runs are hashed only where
their mark recurs, and not within a text or a line that goes as a whole.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import chunked, flagged, numbered, table
from skyloom.llm.words import BASE, INVERSE, mix, powers
from skyloom.plans.staging import stage

#: Words of a unit: shorter passages recur by chance and stay.
PASSAGE = 50
#: Words of the runs whose least hash is the mark of a passage.
SEED = 25
#: Characters whose words are found at a time; texts of any length are read whole.
BLOCK = 1 << 20

_tables: list[np.ndarray] = []


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start, the end and the hash of each word: a longest run of letters and digits, in lower case."""
    if not _tables:
        chars = [chr(c) for c in range(sys.maxunicode + 1)]
        _tables.append(np.array([c.isalnum() for c in chars]))
        _tables.append(np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32))
    inside, lower = _tables
    found, at = [], 0
    while at < len(text):
        part, last = text[at : at + BLOCK], at + BLOCK >= len(text)
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        word = inside[points]
        if not last and not word.all():  # the next block begins where a word may begin
            points, word = points[: (cut := len(word) - int(np.argmin(word[::-1])))], word[:cut]
        elif not last:  # one word longer than a block
            end = at + BLOCK
            while end < len(text) and text[end].isalnum():
                end += 1
            points, word = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4"), np.ones(end - at, bool)
        turn = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = turn[::2], turn[1::2]
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((lower[points].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(points))[: len(points)], out=total[1:])
        found.append((start + at, end + at, mix((total[end] - total[start]) * powers(INVERSE, len(points) + 1)[start])))
        at += len(points)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))


def _sums(words: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words))[: len(words)], out=total[1:])
    return total


def _between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(INVERSE, len(total))[start] + (end - start).astype(np.uint64))


def digests(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 31 bits for the words from each start to each end."""
    other = _between(_sums(mix(words ^ np.uint64(BASE))), start, end)
    return _between(_sums(words), start, end).view(np.int64), (other >> np.uint64(33)).astype(np.int32)


def marks(words: np.ndarray) -> np.ndarray:
    """The mark of every run of PASSAGE words."""
    n = len(words) - PASSAGE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.arange(len(words) - SEED + 1)
    least, width, want = _between(_sums(words), at, at + SEED), 1, PASSAGE - SEED + 1
    while width < want:  # the least of twice as many each time, or as many as are wanted
        step = min(width, want - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    return least.view(np.int64)


def lines_of(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the word after the last of each line that has PASSAGE words."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    edge = np.concatenate([[0], np.searchsorted(starts, breaks), [len(starts)]]).astype(np.int64)
    long = np.diff(edge) >= PASSAGE
    return edge[:-1][long], edge[1:][long]


_UNIT = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("again", pa.bool_())])
_RUN = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("again", pa.bool_())])


def _gathered(rows, schema: pa.Schema, most: int = 200_000):
    """Record batches of the tuples of arrays that ``rows`` yields."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _unit_rows(batches):
    """Each text (kind -2), mark (-1) and line (0, 1, …) of the documents, a mark once for a document."""

    def rows():
        for batch in batches:
            for key, row, text in zip(batch.column("id"), batch.column("row"), batch.column("text")):
                text = text.as_py()
                starts, _, words = words_of(text)
                n = len(words)
                if n < PASSAGE:
                    continue
                least = marks(words)
                turn = np.concatenate([[True], least[1:] != least[:-1]])
                # a mark whose stretch is longer than one place can give, or that has several, is there again
                mark, which = np.unique(least, return_inverse=True)
                again = (np.bincount(which[turn]) > 1) | (np.bincount(which) > PASSAGE - SEED + 1)
                first, after = lines_of(text, starts)
                first, after = np.concatenate([[0], first]), np.concatenate([[n], after])
                h, g = digests(words, first, after)
                _, seen, place = np.unique(h[1:], return_index=True, return_inverse=True)
                repeated = np.concatenate([[False], seen[place] != np.arange(len(h) - 1)])
                kind = np.concatenate([[-2], np.arange(len(h) - 1), np.full(len(mark), -1)])
                yield np.full(len(kind), key.as_py()), np.full(len(kind), row.as_py()), kind, np.concatenate([h, mark]), np.concatenate([g, np.zeros(len(mark), np.int32)]), np.concatenate([repeated, again])

    return _gathered(rows(), _UNIT)


def _run_rows(batches):
    """Every run of PASSAGE words with a mark that recurs, outside lines that go; ``again`` where the document has it before."""

    def rows():
        for batch in batches:
            for key, row, text, hot, gone in zip(batch.column("id"), batch.column("row"), batch.column("text"), batch.column("marks"), batch.column("lines")):
                text = text.as_py()
                starts, _, words = words_of(text)
                if len(words) < PASSAGE:
                    continue
                on = np.isin(marks(words), hot.values.to_numpy())
                for line in gone.as_py() or ():
                    first, after = (x[line] for x in lines_of(text, starts))
                    on[first : after - PASSAGE + 1] = False
                at = np.flatnonzero(on)
                if len(at):
                    h, g = digests(words, at, at + PASSAGE)
                    _, seen, place = np.unique(h, return_index=True, return_inverse=True)
                    yield np.full(len(at), key.as_py()), np.full(len(at), row.as_py()), at, h, g, at >= at[seen[place]] + PASSAGE

    return _gathered(rows(), _RUN)


def _later(units: DataFrame, *key: str) -> DataFrame:
    """The units that a row of a smaller document, or an earlier place of their own row, has; ``first`` names the document that keeps it."""
    firsts = units.groupBy(*key).agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1")
    # staged, so that the join has a shuffle of its own, whose hot keys can be split
    firsts = stage(firsts.select(*key, F.col("least.id").alias("first"), F.col("least.row").alias("first_row")), "firsts")
    return units.join(firsts, [*key]).where((F.col("row") != F.col("first_row")) | F.col("again"))


def repeated_units(rows: DataFrame) -> DataFrame:
    """``(row, whole, lines, runs)`` of every row of ``(id, row, text)`` with units that occur earlier; ``row`` numbers the rows.

    ``whole`` is the document that keeps the whole text, or null; ``lines`` holds (line, first)
    and ``runs`` (word, first) structs. A digest that very many documents hold is a partial
    minimum and a join whose hot key adaptive execution splits; a text's copies give no runs.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    units = stage(rows.mapInArrow(_unit_rows, "id long, row long, kind int, h long, g int, again boolean"), "units")
    whole = stage(_later(units.where("kind = -2"), "h", "g").groupBy("row").agg(F.min("first").alias("whole")), "whole")
    lines = _later(units.where("kind >= 0"), "h", "g").select("row", F.col("kind").alias("line"), "first").distinct()
    marked = stage(units.where("kind = -1").join(whole, "row", "left_anti").select("row", "h", "again"), "marks")
    hot = stage(marked.groupBy("h").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("h"), "hot_marks")
    hot = marked.select("row", "h").join(hot, "h")
    # of each remaining row: the marks that recur, and the lines that go
    of_row = hot.groupBy("row").agg(F.collect_list("h").alias("marks"))
    lines = stage(lines.join(whole, "row", "left_anti").groupBy("row").agg(F.collect_list(F.struct("line", "first")).alias("lines")), "lines")
    wanted = stage(of_row.join(lines.select("row", F.col("lines.line").alias("lines")), "row", "left"), "wanted")
    found = flagged(rows, "row", wanted.select("row"), "may").where("may").drop("may").join(wanted, "row").select("id", "row", "text", "marks", "lines")
    runs = stage(found.mapInArrow(_run_rows, "id long, row long, at int, h long, g int, again boolean"), "runs")
    runs = _later(runs, "h", "g").groupBy("row").agg(F.collect_list(F.struct("at", "first")).alias("runs"))
    return stage(runs.join(lines, "row", "full").join(whole, "row", "full"), "removals")


def spans_of(text: str, whole: int | None, lines: list[tuple[int, int]], at: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, first)`` of the characters that go: units that meet are one span, out to the breaks of lines that go as a whole."""
    if whole is not None:
        return [(0, len(text), whole)]
    starts, ends, words = words_of(text)
    n = len(words)
    on = at <= n - PASSAGE
    order = np.argsort(at[on], kind="stable")
    at, firsts = at[on][order], firsts[on][order]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > PASSAGE])) if len(at) else ()
    units = [(int(at[i]), int(at[j - 1]) + PASSAGE, int(firsts[i:j].min())) for i, j in zip(cut, [*cut[1:], len(at)])]
    if lines:
        first, after = lines_of(text, starts)
        units = sorted(units + [(int(first[i]), int(after[i]), f) for i, f in lines if i < len(first)])
    out: list[tuple[int, int, int]] = []
    for a, b, f in units:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), min(f, out[-1][2]))
        else:
            out.append((a, b, f))
    spans = []
    for a, b, f in out:
        start, end = int(starts[a]), int(ends[b - 1])
        head = text.rfind("\n", int(ends[a - 1]) if a else 0, start) + 1
        if head or not a:  # no word before it in its line
            start = head
        tail = text.find("\n", end, int(starts[b]) if b < n else len(text)) + 1
        if tail or b == n:
            end = tail or len(text)
        spans.append((start, end, f))
    return spans


_SPANS = "array<struct<start:bigint,end:bigint,first_doc_id:bigint>>"
_CUT = pa.schema([("doc_id", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())]))), ("text", pa.string())])


def _pairs(x) -> tuple[np.ndarray, np.ndarray]:
    return tuple(x.values.field(i).to_numpy() for i in (0, 1)) if x.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))


def _cut_rows(batches):
    def rows():
        for batch in batches:
            for key, text, whole, lines, runs in zip(*(batch.column(c) for c in ("doc_id", "text", "whole", "lines", "runs"))):
                text = text.as_py()
                line, first = _pairs(lines)
                spans, left, at = spans_of(text, whole.as_py(), list(zip(line.tolist(), first.tolist())), *_pairs(runs)), [], 0
                for start, end, _ in spans:
                    left.append(text[at:start])
                    at = end
                yield {"doc_id": key.as_py(), "removed": [dict(zip(("start", "end", "first_doc_id"), s)) for s in spans], "text": "".join([*left, text[at:]])}

    return chunked(rows(), _CUT, 100)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_removed, removed_chars, removed, text)``, one row per document.

    ``removed`` lists ``(start, end, first_doc_id)``: the characters cut from the original text
    and the document that keeps the passage. A null text stays null and an empty one empty; both
    lose nothing, as does a row with a null id. Passages repeated within one text are removed too,
    but for the first and for what overlaps it, so that a text of one phrase over and over keeps
    PASSAGE words of it. Rows that repeat an id are rows of their own: the first of them, by place in the
    table, keeps what they share. An empty table gives no rows; other columns are ignored.
    """
    rows, number = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    rows = rows.select("id", F.col(number).alias("row"), "text")
    removals = repeated_units(rows)
    # most documents lose nothing: only those that may are shuffled
    rows = flagged(rows, "row", removals.select("row"), "may").withColumnRenamed("id", "doc_id")
    joined = rows.where("may AND text IS NOT NULL").drop("may").join(removals.withColumnRenamed("row", "found"), F.col("row") == F.col("found"), "left")
    cut = joined.where("found IS NOT NULL").select("doc_id", "text", "whole", "lines", "runs").mapInArrow(_cut_rows, f"doc_id long, removed {_SPANS}, text string")
    plain = rows.where("NOT may OR text IS NULL").select("doc_id", "text").unionByName(joined.where("found IS NULL").select("doc_id", "text"))
    told = cut.unionByName(plain.withColumn("removed", F.array().cast(_SPANS)))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return told.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), "removed", "text")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
