"""Operator 8, quality classifier by compression.

Two zstandard dictionaries hold good and bad labelled text. The difference of a text's two compressed
sizes over its bytes goes through a logistic calibration, fitted on labelled texts outside the dictionaries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .compression import DictionaryModel, bounded_sample, excerpt, model_of

#: The bounds of the fit: labelled texts a class for the dictionary, characters that each gives (whole texts up to
#: that length, pieces from all over longer ones), and labelled texts a class for calibration, scored whole.
DICTIONARY_TEXTS, TEXT_CHARS, CALIBRATION_TEXTS = 1400, 400, 1400
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    sizes: DictionaryModel
    slope: float
    intercept: float
    prior: float

    def features(self, texts: list[str | None]) -> list[float | None]:
        """(bad size - good size) / bytes; None where a text is empty or a class has no example."""
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        known = [raw for raw in raws if raw]
        if not known or len(self.sizes.contents) < 2:
            return [None] * len(raws)
        sizes = self.sizes.sizes(known)
        found = iter([(bad - good) / len(raw) for bad, good, raw in zip(sizes["0"], sizes["1"], known)])
        return [next(found) if raw else None for raw in raws]

    def scores(self, texts: list[str | None]) -> list[float]:
        line = lambda x: 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * x + self.intercept))))
        return [self.prior if x is None else line(x) for x in self.features(texts)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Weighted one-variable logistic regression by Newton's method on a standardised x, with a small ridge."""
    mean, scale = float(np.average(x, weights=weight)), float(np.sqrt(np.average((x - np.average(x, weights=weight)) ** 2, weights=weight))) or 1.0
    z = np.column_stack([(x - mean) / scale, np.ones_like(x)])
    w = weight / weight.mean()
    beta = np.zeros(2)
    penalty = ridge * len(x) * np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (y - p)) - penalty * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality") -> QualityModel:
    """Learn from labels whose ``doc_id`` satisfies ``learn``; labels other than 0 and 1 and null ids are left out.

    The sample is drawn from the labels' ids, each once a class, and its texts (a bounded number a class) are
    looked up once; of rows that repeat an id the least text counts, so repeated documents and labels change
    nothing. With one class or none the score is the prior (0.5 without labels).
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality-fit")
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    usable = usable.select("doc_id", F.col(label).cast("int").cast("string").alias("__label"))
    sample, counts = bounded_sample(scratch, usable, "__label", F.col("doc_id"), ["doc_id"], DICTIONARY_TEXTS + CALIBRATION_TEXTS)
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("label", "rank").agg(F.min("text").alias("text"))  # the bounds above, twice
    found = scratch.save(found, "texts")

    @F.arrow_udf("string")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([excerpt(t.as_py(), TEXT_CHARS) for t in batch], pa.string())

    ranks: dict[str, list[int]] = {}
    for row in found.select("label", "rank").orderBy("label", "rank").collect():
        ranks.setdefault(row["label"], []).append(row["rank"])
    # the last rank of each class that goes into the dictionary: 70 of 100 texts where there are few
    last = {k: v[min(DICTIONARY_TEXTS, math.ceil(0.7 * len(v))) - 1] for k, v in ranks.items()}
    in_dictionary = F.lit(False)
    for k, rank in last.items():
        in_dictionary = in_dictionary | ((F.col("label") == k) & (F.col("rank") <= rank))
    contents: dict[str, list[str]] = {}
    for row in found.where(in_dictionary).select("label", "rank", pieces("text").alias("piece")).orderBy("label", "rank").collect():
        contents.setdefault(row["label"], []).append(row["piece"])
    sizes = model_of({k: "\n".join(v).encode("utf-8", "surrogatepass") for k, v in sorted(contents.items())})
    prior = counts.get("1", 0) / sum(counts.values()) if counts else 0.5
    model = QualityModel(sizes, 0.0, 0.0, prior)
    if len(sizes.contents) < 2:
        scratch.clear()
        return model

    @F.arrow_udf("double")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.features(batch.to_pylist()), pa.float64())

    rows = found.where(~in_dictionary).select("label", features("text").alias("x")).collect()  # two numbers a text
    scratch.clear()
    y = np.array([int(r["label"]) for r in rows], float)
    x = np.array([r["x"] for r in rows], float)
    if len(set(y)) < 2:
        return QualityModel(sizes, 100.0, math.log(max(prior, 1e-3) / max(1 - prior, 1e-3)), prior)
    weight = np.where(y == 1, counts["1"] / (y == 1).sum(), counts["0"] / (y == 0).sum())
    slope, intercept = logistic_fit(x, y, weight)
    return QualityModel(sizes, slope, intercept, prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """Add the calibrated score of each whole text. No shuffle.

    Null and empty texts get the prior; ties get equal scores; repeated rows are scored alike. Other columns
    pass through; one already called ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch.to_pylist()), pa.float64())

    return docs.withColumn(into, scored(F.col(text)))
