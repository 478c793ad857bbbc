"""Toxicity by compression distance.

Two dictionaries are made from labelled text. The *ordinary* one holds the segments that
zstandard's trainer picks from ordinary text. The *toxic* one is the same dictionary with what marks
toxic text in front: segments that recur in it, in many contexts, and hardly in ordinary text. A
window of words is compressed with either dictionary; the bytes that the toxic dictionary
saves are its compression distance. Since both share the ordinary part at equal offsets, an
ordinary window comes out equally long. A document's evidence is the gain of its windows above
a threshold; a logistic curve fitted on documents that the dictionaries never saw turns it into
a probability.

The toxic part isn't picked by zstandard's trainer: that goes by frequency alone, so most of
what it takes from toxic text is ordinary, and windows differ by chance more than by
toxicity. The README has the figures of two trained dictionaries.

Fitting reads at most `per_class` labelled rows of each class, of at most `max_bytes` each
(documented bounds; both classes by hash order). Scoring reads every whole text, all of its
characters but white space.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix.llm import arrow

#: Words, and runs of other characters.
_SPLIT = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


@dataclass(frozen=True)
class Model:
    """What the executors need: two dictionaries, a gain threshold and a curve."""

    ordinary: bytes
    toxic: bytes
    window: int
    match: int
    threshold: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def _windows(text: str, size: int) -> Iterator[bytes]:
    """Windows of `size` words, lower-cased; a long text's words aren't all held at once."""
    text = text.lower()
    if len(text) <= 1 << 20:
        words = _SPLIT.findall(text)
        yield from (f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size))
        return
    found = (m.group() for m in _SPLIT.finditer(text))
    while some := list(islice(found, size)):
        yield f" {' '.join(some)} ".encode()


class Scorer:
    """Compresses windows with both dictionaries of a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # fixed search parameters: levels would choose other ones for the longer dictionary
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
            window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=model.match, target_length=32, strategy=zstd.STRATEGY_GREEDY,
        )
        make = lambda d: zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress
        self._ordinary, self._toxic = make(model.ordinary), make(model.toxic)

    def gains(self, text: str) -> np.ndarray:
        o, t = self._ordinary, self._toxic
        return np.array([len(o(w)) - len(t(w)) for w in _windows(text, self.model.window)], dtype=np.int64)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Log of windows above the threshold, of their share, and of their summed gain."""
        return evidence(self.gains(text), self.model.threshold)

    def score(self, text: str) -> float:
        m = self.model
        z = m.bias + sum(w * (x - a) / s for w, x, a, s in zip(m.weights, self.evidence(text), m.mean, m.scale, strict=True))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def evidence(gains: np.ndarray, threshold: int) -> tuple[float, float, float]:
    hit = gains[gains >= threshold]
    n = max(1, len(gains))
    return float(np.log1p(len(hit))), float(np.log1p(100.0 * len(hit) / n)), float(np.log1p(hit.sum() / n))


def _segments(toxic: list[str], ordinary: list[str], budget: int) -> list[bytes]:
    """Word-initial segments of toxic text that ordinary text hardly has, best first.

    A segment counts in as many documents as it has different neighbouring words at most, so a
    passage that is copied into many documents doesn't count as often as it is copied.
    """

    def spread(docs: list[str], only: dict | None) -> dict[str, int]:
        """For each segment the smaller of its documents and its neighbourhoods."""
        inside: dict[str, set[int]] = defaultdict(set)  # of whole words
        around: dict[str, set[int]] = defaultdict(set)
        for number, text in enumerate(docs):
            words = ["", *_SPLIT.findall(text.lower()), ""]
            for before, w, after in zip(words, words[1:], words[2:], strict=False):
                if len(w) > 2 and (only is None or any(w[:n] in only for n in range(3, min(len(w), 12) + 1))):
                    inside[w].add(number)
                    around[w].add(hash((before, after)))
        of: dict[str, list[str]] = defaultdict(list)
        for w in inside:
            for n in range(3, min(len(w), 12) + 1):
                if only is None or w[:n] in only:
                    of[w[:n]].append(w)
        # neighbourhoods of different words are different; few of them settle a segment without a union
        places = {k: sum(len(around[w]) for w in ws) for k, ws in of.items()}
        return {k: min(n, len(set().union(*(inside[w] for w in of[k])))) for k, n in places.items() if n >= 4 or only is not None}

    in_toxic = {k: v for k, v in spread(toxic, None).items() if v >= 4}
    in_ordinary = spread(ordinary, in_toxic)
    ranked = []
    for k, v in in_toxic.items():
        expected = len(toxic) * (in_ordinary.get(k, 0) + 0.5) / len(ordinary)
        surprise = v * np.log(v / expected) - (v - expected)  # of a Poisson count
        if v >= 6 * expected and surprise >= 14 and len(k.encode()) >= 4:
            ranked.append((surprise * (1 + 0.02 * len(k)), k))
    chosen: list[str] = []
    floor = max((s for s, _ in ranked), default=0) / 25
    for s, k in sorted(ranked, reverse=True):
        if s < floor or sum(len(c) + 2 for c in chosen) > budget:
            break
        if not any(k.startswith(c) or c.startswith(k) for c in chosen):
            chosen.append(k)
    return [f" {k}".encode() for k in chosen]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(design.shape[1]), np.diag([ridge] * x.shape[1] + [1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + penalty, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def train(toxic: list[str], ordinary: list[str], prior: float, window: int = 8, dictionary_bytes: int = 16384, match: int = 5) -> Model:
    """Fit dictionaries on two thirds of the samples, threshold and curve on the rest.

    With no toxic or no ordinary sample the score is the prior, 0 or 1 (0 with no sample at all).
    """
    if not toxic or not ordinary:
        flat = 1.0 if toxic else 0.0
        return Model(b"\0" * 8, b"\0" * 8, window, match, 1, (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, 40.0 if flat else -40.0)
    cut_t, cut_o = (max(1, 2 * len(x) // 3) for x in (toxic, ordinary))
    samples = [w for text in ordinary[:cut_o] for w in _windows(text, window)]
    budget, some = 4_000_000, []
    for w in samples[:: max(1, sum(map(len, samples)) // budget)]:
        some.append(w)
    try:
        base = zstd.train_dictionary(dictionary_bytes, some).as_bytes()
        header = zstd.ZstdCompressionDict(base, dict_type=zstd.DICT_TYPE_FULLDICT) and base.find(b" ", 64)
        base = base[max(0, header) :]
    except zstd.ZstdError:  # too few samples for the trainer: the samples are the dictionary
        base = b"".join(some)[-dictionary_bytes:]
    base = base or b"\0" * 8
    extra = _segments(toxic[:cut_t], ordinary[:cut_o], dictionary_bytes)
    draft = Model(base, b"\0".join([*reversed(extra), base]), window, match, 1, (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, 0.0)
    fit_t, fit_o = toxic[cut_t:] or toxic, ordinary[cut_o:] or ordinary
    y = np.array([1.0] * len(fit_t) + [0.0] * len(fit_o))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / len(fit_t), (1 - prior) / len(fit_o)) * len(y)
    best: tuple[float, Model] | None = None
    scorer = Scorer(draft)
    gains = [scorer.gains(t) for t in fit_t + fit_o]
    for threshold in (1, 2, 3, 4):
        model = Model(**{**draft.__dict__, "threshold": threshold})
        x = np.array([evidence(g, threshold) for g in gains])
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        w, b = _logistic((x - mean) / scale, y, weight)
        z = ((x - mean) / scale) @ w + b
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        model = Model(**{**model.__dict__, "mean": tuple(mean), "scale": tuple(scale), "weights": tuple(w), "bias": b})
        if best is None or loss < best[0] - 1e-9:
            best = (loss, model)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, max_bytes: int = 65536, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Model:
    """Train from labelled rows, at most `per_class` of each class, in hash order of their ids.

    Labels other than 0 and 1, null identifiers and null texts are passed over; of rows that repeat an
    identifier the smallest text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("id")
    picked = known.where("label = 1").orderBy(order, "id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "id").limit(per_class))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.octet_length("body") <= max_bytes)
        .join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("body").alias("body")).collect()
    )  # fmt: skip  # at most 2 * per_class ids are broadcast, and one bounded text for each collected
    texts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in sorted(rows, key=lambda r: (zlib.crc32(f"{r['id']} shuffled".encode()), r["body"])):
        texts[r["label"]].setdefault(r["body"], r["id"])
    total = sum(counts.values())
    return train(list(texts[1]), list(texts[0]), counts.get(1, 0) / total if total else 0.0, **options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `score` (double, 0 to 1) and `predicted` (1 if score >= 0.5) to every row.

    Null and empty texts have no window and get the curve's value for no evidence. Equal texts have
    equal scores; long ones are worked through window by window. An empty table gives an
    empty one. Columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        scorer = Scorer(shared.value)
        scores = [scorer.score(t) for t in arrow.strings(arrow.column(batch, text_col))]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    return arrow.with_columns(docs, "score double, predicted int", compute, keep)
