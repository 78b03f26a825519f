"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered. One weight vector over hashed words is shared by all grades, and
ascending thresholds cut its score: P(grade <= g) = logistic(threshold_g - score). The score of
a document gives its expected grade and the probability of the top grade, by which documents
are selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.llm.words import mix, word_hashes
from skyloom.plans.staging import stage

#: Hashed features.
WIDTH = 1 << 16
#: The classifier is fitted on at most so many labelled rows, those of least hash.
SAMPLE = 12_000
GRADES = 3
STEPS = 400
RATE = 0.05
PENALTY = 1e-5
#: A feature takes part if some split of the grades differs in its frequency by so many standard errors.
EVIDENCE = 5.0
SELECT_AT = 0.5

_CLASS = np.zeros(256, np.uint8)
for _code, _group in enumerate((b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"#$%&*|<>=+~^_@/\\[]{}`")):
    _CLASS[np.frombuffer(_group, np.uint8)] = _code
_CLASS[128:] = 1
_SHAPES = 8 * 6


def features(text: str | None) -> np.ndarray:
    """Sorted feature numbers of a whole text: its distinct hashed words, how often words recur, and the shares of kinds of characters.

    Shares are coded as the octave in which they lie, so that they don't depend on length.
    """
    text = text or ""
    words = word_hashes(text)
    distinct = np.unique(words)
    found = [(mix(distinct + np.uint64(1)) % np.uint64(WIDTH - 128)).astype(np.int64) + 128]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw):
        share = np.bincount(_CLASS[raw], minlength=8)[:8] / len(raw)
        octave = np.clip(np.floor(-np.log2(np.maximum(share, 1e-9))), 0, 5).astype(np.int64)
        found.append(np.arange(8) * 6 + octave)
        if len(words):
            found.append(np.array([_SHAPES + min(7, int(8 * len(distinct) / len(words)))]))
            mean = len(raw) / len(words)
            found.append(np.array([_SHAPES + 8 + min(15, int(2 * np.log2(mean)))]))
    return np.unique(np.concatenate(found))


def grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 for low quality, 1 for good but toxic, 2 for good text. Null ratings give none."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tail(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """``P(grade > g)`` of each score, for every g below the top grade."""
    return _logistic(scores[:, None] - thresholds[None, :])


def informative(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which features tell two adjacent grades, or all grades up to one from all above, apart; from counts by grade and feature, and rows by grade."""
    keep = np.zeros(count.shape[1], bool)
    for g in range(1, len(count)):
        for a, b in ((slice(0, g), slice(g, len(count))), (slice(g - 1, g), slice(g, g + 1))):
            na, nb = size[a].sum(), size[b].sum()
            if na and nb:
                ca, cb = count[a].sum(axis=0), count[b].sum(axis=0)
                p = (ca + cb) / (na + nb)
                keep |= np.abs(ca / na - cb / nb) > EVIDENCE * np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / na + 1 / nb))
    return keep


def fit(rows: list[np.ndarray], grade: np.ndarray, top: int = GRADES, width: int = WIDTH, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds, by Adam on the penalised likelihood of all rows.

    A row has a feature or hasn't. Features without evidence keep the weight 0. Thresholds are
    a first one and positive gaps, so they stay in order.
    """
    count = np.stack([np.bincount(np.concatenate([np.empty(0, np.int64), *(r for r, k in zip(rows, grade) if k == g)]), minlength=width) for g in range(top)])
    keep = informative(count, np.bincount(grade, minlength=top))
    rows = [r[keep[r]] for r in rows]
    at, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    case = 1 / len(rows)
    w, first, gaps = np.zeros(width), -1.0, np.zeros(top - 2)
    m, v = np.zeros(width + top - 1), np.zeros(width + top - 1)
    index = np.arange(len(rows))
    for step in range(1, steps + 1):
        score = np.bincount(owner, w[at], len(rows))
        cuts = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
        over = np.concatenate([np.ones((len(rows), 1)), tail(score, cuts), np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(over[index, grade] - over[index, grade + 1], 1e-12)
        slope = over * (1 - over)  # of P(grade > g) in the score
        by_score = -case * (slope[index, grade] - slope[index, grade + 1]) / p
        by_cut = np.array([(case * (np.where(grade == g + 1, slope[:, g + 1], 0) - np.where(grade == g, slope[:, g + 1], 0)) / p).sum() for g in range(top - 1)])
        by_gap = np.array([by_cut[g + 1 :].sum() * np.exp(gaps[g]) for g in range(top - 2)])
        grad = np.concatenate([np.bincount(at, by_score[owner], width) + PENALTY * w, [by_cut.sum()], by_gap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[:width], first - move[width], gaps - move[width + 1 :]
    return w, np.concatenate([[first], first + np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most ``sample`` labelled documents; None if no document is labelled.

    Of rows that repeat a sampled id, the one whose text has the least hash counts. What comes to the driver is bounded: counts by grade and feature, and of each sampled
    document the features with evidence, whatever its length.
    """
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([features(x.as_py()).astype(np.int32) for x in batch.column("text")], pa.list_(pa.int32()))], names=["grade", "at"])

    sampled = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = stage(sampled.select("grade", "text").mapInArrow(run, "grade int, at array<int>"), "features")
    size, count = np.zeros(GRADES, np.int64), np.zeros((GRADES, WIDTH), np.int64)
    for grade, n in rows.groupBy("grade").count().collect():
        size[grade] = n
    if not size.sum():
        return None
    counted = rows.select("grade", F.explode("at").alias("feature")).groupBy("grade", "feature").agg(F.count("*").alias("n")).toArrow()
    np.add.at(count, (counted.column("grade").to_numpy(), counted.column("feature").to_numpy()), counted.column("n").to_numpy())
    keep = informative(count, size)

    def kept(batches):
        for batch in batches:
            found = [(at := x.values.to_numpy())[keep[at]] for x in batch.column("at")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    got = rows.mapInArrow(kept, "grade int, at array<int>").toArrow()
    return fit([x.values.to_numpy() for x in got.column("at")], got.column("grade").to_numpy())


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, p_top, selected)`` of every row.

    ``p_top`` is the probability of the top grade and ``selected`` tells whether it reaches one
    half. A null text counts as empty; an empty one has no features and so a score of 0. Without a
    model, grade and probability are null and nothing is selected. Repeated rows each get
    their row; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else (model[0].astype(np.float32), model[1]))

    def run(batches):
        for batch in batches:
            if held.value is None:
                none = pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), none, none, pa.array([False] * batch.num_rows)], names=names)
                continue
            w, cuts = held.value
            rows = [features(x.as_py()) for x in batch.column("text")]
            scores = np.array([float(w[r].sum(dtype=np.float64)) for r in rows])
            p = tail(scores, cuts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= SELECT_AT)], names=names)

    names = ["doc_id", "expected_grade", "p_top", "selected"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_top double, selected boolean")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
