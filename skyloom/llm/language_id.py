"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent n-grams of one to three letters in order of
frequency. A document's own list is compared with each profile by the out-of-place
distance: the sum, over the document's n-grams, of the difference between the two ranks,
or of the list's length where the profile lacks the n-gram. The least distance wins.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.rows import keep_rows, numbered, table

#: n-grams in a profile and in a document's list.
TOP = 300
#: Letters of a text counted at a time; texts of any length are counted whole.
BLOCK = 1 << 18
#: No letter has these bits at the third place: they tell pairs and triples from each other and from single letters.
PAIR, TRIPLE = 1 << 62, 1 << 61
UNKNOWN = "und"
#: The pipeline rejects documents of a lower score.
REJECT_BELOW = 0.1

_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """The code points of the text, with 0 for all but letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters[0][points], points, 0).astype(np.int64)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the whole text as integers in ascending order, and how often each occurs.

    An n-gram of up to three code points is packed 21 bits each; 0 marks a word's edge, and
    no n-gram spans two words or is an edge alone. A block begins with the last two codes of
    the one before, so that the counts don't depend on where blocks are cut.
    """
    keys, counts, text = [], [], text.lower()
    before = np.zeros(1, np.int64)
    for at in range(0, max(1, len(text)), BLOCK):
        c = np.concatenate([before, _codes(text[at : at + BLOCK]), [0] if at + BLOCK >= len(text) else []]).astype(np.int64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one edge for each run of other characters
        k = len(before)
        new, last = c[k:], c[k - 1 : -1]
        grams = [new[new > 0], (last | new << 21 | PAIR)[(last > 0) | (new > 0)]]
        k = max(k, 2)
        if len(c) > k:
            grams.append((c[k - 2 : -2] | c[k - 1 : -1] << 21 | c[k:] << 42 | TRIPLE)[c[k - 1 : -1] > 0])
        keys_, n = np.unique(np.concatenate(grams), return_counts=True)
        keys.append(keys_)
        counts.append(n)
        before = c[-2:]
    if len(keys) == 1:
        return keys[0], counts[0]
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, most: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order of frequency; the smaller code first where equal."""
    if len(keys) > 4 * most:  # fewer to sort: none below the last that counts
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:most]


def _count_batches(batches):
    """Counts of n-grams by language, merged over as many documents as fit into the bound."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], schema=schema)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            got = ngram_counts(text.as_py())
            held.setdefault(lang.as_py(), []).append(got)
            size += len(got[0])
            if size > 1_000_000:
                yield from out()
                size = 0
    yield from out()


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = TOP) -> dict[str, list[int]]:
    """Each language's ``most`` most frequent n-grams over all rows with a language and a text.

    The model is so many integers for each language; counts are summed by Spark.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= most)
    found: dict[str, list] = {}
    for row in ranked.collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: [g for _, g in sorted(grams)] for lang, grams in sorted(found.items())}


def distances(grams: np.ndarray, profiles: list[tuple[str, np.ndarray, np.ndarray]], most: int = TOP) -> list[int]:
    """Out-of-place distance to each profile, given as sorted n-grams with their ranks."""
    own = np.arange(len(grams))
    found = []
    for _, keys, ranks in profiles:
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        found.append(int(np.where(keys[at] == grams, np.abs(ranks[at] - own), most).sum()))
    return found


def classify(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]], most: int = TOP) -> tuple[str, float]:
    """The nearest language, and 1 less the share of the greatest distance that there can be."""
    grams = top(*ngram_counts(text or ""), most) if profiles else ()
    if not len(grams):
        return UNKNOWN, 0.0
    far = distances(grams, profiles, most)
    best = min(range(len(far)), key=lambda i: (far[i], profiles[i][0]))
    return profiles[best][0], 1.0 - far[best] / (most * len(grams))


def prepared(model: dict[str, list[int]]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    found = []
    for lang, grams in sorted(model.items()):
        keys = np.array(grams, np.int64)
        order = np.argsort(keys)
        found.append((lang, keys[order], order))
    return found


def predict(docs: DataFrame, model: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row.

    A null text, a text without letters, and any text where the model has no language is
    ``und`` with score 0. Repeated rows each get their row; equal distances go to the first
    language by code point; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        profiles = prepared(model)
        for batch in batches:
            got = [classify(x.as_py(), profiles) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """The documents that are never learnt from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """Pipeline stage: the rows whose language is known, that is not ``und`` and near enough to a profile."""
    model = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    rows, number = numbered(docs)
    known = predict(rows, model, number).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= below)).select("doc_id")
    return keep_rows(rows, known, number)
