"""Quality by ordinal cumulative-link regression on graded ratings.

A text's features are the frequencies of its byte 4-grams and words, hashed into one vector.
All grades share one weight vector; ordered thresholds cut its score into grades:
P(grade <= j) = logistic(threshold_j - score). The model gives the expected grade and the
probability of reaching a grade, by which documents are selected.

Fitting reads at most `per_grade` rated rows of each grade and `most` in all, of at most `max_bytes`
each (documented bounds, in hash order). Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planarix.llm import arrow

BUCKETS = 4096


@dataclass(frozen=True)
class Model:
    grades: tuple[float, ...]
    weights: np.ndarray
    thresholds: np.ndarray


def _grams(raw: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Bucket of each run of four bytes."""
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    wide = raw.astype(np.uint64)
    return (arrow.mix(wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)) & mask).astype(np.int64)


def features(col: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of hashed 4-gram and word frequencies, one row a text; zero for a null or empty text. Long texts are counted in steps."""
    out = np.zeros((len(col), 2 * buckets), np.float32)
    mask = np.uint64(buckets - 1)
    for i, j, raw, off in arrow.pieces(col):
        starts, ends, rows = arrow.word_spans(raw, off)
        words = (arrow.word_hashes(raw, starts, ends) & mask).astype(np.int64)
        bounds = np.searchsorted(rows, np.arange(j - i + 1))
        several = _grams(raw, mask) if j > i + 1 else None
        for n in range(j - i):
            if several is not None:
                grams = np.bincount(several[off[n] : max(off[n], off[n + 1] - 3)], minlength=buckets)
            else:
                grams = sum((np.bincount(_grams(raw[a : a + arrow.STEP_BYTES + 3], mask), minlength=buckets) for a in range(0, len(raw), arrow.STEP_BYTES)), np.zeros(buckets, np.int64))
            for part, base in ((grams, 0), (np.bincount(words[bounds[n] : bounds[n + 1]], minlength=buckets), buckets)):
                if total := part.sum():
                    out[i + n, base : base + buckets] = np.sqrt(part / total)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, n: int, ridge: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of least weighted loss, by Nesterov steps with Adam scaling.

    Thresholds are a first one and positive steps (exponentials), so they stay ordered.
    """
    share = np.array([weight[grade <= j].sum() for j in range(n - 1)]) / weight.sum()
    cuts = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    steps = np.log(np.maximum(np.diff(cuts), 1e-2))
    theta = np.concatenate([np.zeros(x.shape[1]), cuts[:1], steps])
    d, m, v = x.shape[1], np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    rate = 0.3
    for t in range(1, rounds + 1):
        w, b = theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))
        z = x @ w.astype(np.float32)
        edge = np.concatenate([[-np.inf], b, [np.inf]])
        hi, lo = _sigmoid(np.clip(edge[grade + 1], -1e3, 1e3) - z), _sigmoid(np.clip(edge[grade], -1e3, 1e3) - z)
        hi, lo = np.where(grade == n - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dz = weight * (dhi - dlo) / p  # of the loss
        db = np.array([(-weight * (np.where(grade == j, dhi, 0) - np.where(grade == j + 1, dlo, 0)) / p).sum() for j in range(n - 1)])
        grad = np.concatenate([x.T @ dz.astype(np.float32) + ridge * w, [db.sum()], [db[j:].sum() * np.exp(theta[d + j]) for j in range(1, n - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))


def sample(ratings: DataFrame, most: int, per_grade: int, id_col: str, grade_col: str) -> tuple[DataFrame, dict[float, int]]:
    """(id, grade) of at most per_grade rows a grade and `most` in all, by a hash of the id; and the number of rows of each grade.

    A hash threshold leaves few more rows than asked for before they are ranked, so a grade that
    nearly all rows have isn't sorted.
    """
    known = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("double").alias("grade")).where("id is not null and grade is not null").distinct()
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().limit(most + 1).collect()}
    if len(counts) > most // 2:
        raise ValueError(f"more than {most // 2} different grades: put a continuous rating into steps first")
    if not counts:
        return known, counts
    each = min(per_grade, most // len(counts))
    share = F.element_at(F.create_map(*[F.lit(v) for g, n in counts.items() for v in (g, min(1.0, (each + 6 * each**0.5 + 20) / n))]), F.col("grade"))
    rank = F.xxhash64("id")
    few = known.where(F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53)) < share)
    nth = F.row_number().over(Window.partitionBy("grade").orderBy(F.shiftrightunsigned(rank, 11), "id"))
    return few.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth"), counts


def fit(docs: DataFrame, ratings: DataFrame, *, per_grade: int = 1500, most: int = 6000, max_bytes: int = 65536, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> Model:
    """Train on rated rows: all grades that occur, in ascending order. Without two grades the model is constant.

    Rows are weighted so that grades count as often as they are rated. Null identifiers, grades and
    texts are passed over; of rows that repeat an identifier the smallest text counts. Raises on more
    grades than half of `most`.
    """
    picked, counts = sample(ratings, most, per_grade, id_col, grade_col)
    grades = sorted(counts)
    if len(grades) < 2:
        return Model(tuple(grades or [0.0]), np.zeros(2 * BUCKETS), np.zeros(0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.octet_length("body") <= max_bytes)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "grade").agg(F.min("body").alias("body")).collect()  # at most `most` ids, and one bounded text for each
    rows.sort(key=lambda r: (r["id"], r["grade"]))
    if len({r["grade"] for r in rows}) < 2:
        return Model(tuple(grades), np.zeros(2 * BUCKETS), np.linspace(-1, 1, len(grades) - 1))
    x = features(pa.array([r["body"] for r in rows], pa.string()))
    number = {g: n for n, g in enumerate(grades)}
    grade = np.array([number[r["grade"]] for r in rows])
    weight = np.array([counts[grades[g]] / max(1, (grade == g).sum()) for g in grade])
    return Model(tuple(grades), *train(x, grade, weight, len(grades)))


def predict(model: Model, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of a grade >= reach."""
    z = x @ model.weights.astype(np.float32)
    upto = _sigmoid(model.thresholds[None, :] - z[:, None])
    chance = np.diff(np.hstack([np.zeros((len(z), 1)), upto, np.ones((len(z), 1))]), axis=1)
    grades = np.array(model.grades)
    return chance @ grades, chance[:, grades >= reach].sum(1)


def score(docs: DataFrame, model: Model, *, reach: float = 1.0, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append expected_grade and tail_probability (of a grade >= `reach`) to every row.

    Null and empty texts have no features and get the thresholds' own grade. Equal texts have equal
    results. An empty table gives an empty one. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        col = arrow.column(batch, text_col)
        made = [predict(shared.value, features(col.slice(i, 512)), reach) for i in range(0, len(col), 512)]
        return [pa.array(np.concatenate([m[k] for m in made]).astype(np.float64)) for k in (0, 1)]

    return arrow.with_columns(docs, "expected_grade double, tail_probability double", compute, keep)
