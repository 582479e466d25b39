"""Operator 1, language ID: compression classification.

A raw-content zstandard dictionary per language is taken from a bounded sample of labelled text. A text's
language is the one whose dictionary encodes its letters in the fewest bytes; narrow margins are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches
from .compression import DictionaryModel, bounded_sample, excerpt, model_of

#: The bounds of the fit: distinct labelled texts a language, and characters that a text gives (whole texts up
#: to that length, pieces from all over longer ones). A dictionary is all of that, nothing is cut from it.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 1000
#: A winner whose size is less than this share under the runner-up's is rejected.
MIN_MARGIN = 0.01
#: Bytes that make an odds ratio of e between two languages.
TEMPERATURE = 8.0
UNKNOWN = "und"

#: A word begins with a character of category L (a letter); marks belong to the letter before them.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str | None) -> str:
    """The text's words of letters, lower-cased and joined by spaces."""
    return " ".join(_WORDS.findall((text or "").lower()))


def fit(docs: DataFrame, learn: Column | None = None, lang: str = "lang", text: str = "text") -> DictionaryModel:
    """Learn from rows where ``learn`` holds and both columns are non-null; an empty model if there are none.

    Every language that labels a text is learned, be its texts few or copies of a few: a sample has each
    distinct text once. More than ``compression.MOST_LABELS`` languages are an error.
    """
    scratch = Scratch(docs.sparkSession, "language-fit")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = rows.select(F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text"))
    sample, _ = bounded_sample(scratch, rows, "__lang", F.col("__text"), ["__text"], SAMPLE_TEXTS)
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([excerpt(letters(t.as_py()), SAMPLE_CHARS) for t in batch], pa.string())

    contents: dict[str, list[str]] = {}
    for row in sample.select("label", "rank", pieces("__text").alias("piece")).orderBy("label", "rank").collect():
        contents.setdefault(row["label"], []).append(row["piece"])
    scratch.clear()
    return model_of({k: "\n".join(v).encode("utf-8", "surrogatepass") for k, v in sorted(contents.items())})


def classify_all(model: DictionaryModel, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
    """(language, score, margin, rejected) of each text. No letters or no model: ``und``, 0, 0, rejected."""
    raws = [letters(t).encode("utf-8", "surrogatepass") for t in texts]
    known = [i for i, raw in enumerate(raws) if raw and model.contents]
    out: list[tuple[str, float, float, bool]] = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
    by_label = model.sizes([raws[i] for i in known])
    for at, i in enumerate(known):
        sizes = {k: v[at] for k, v in by_label.items()}
        best = min(sizes, key=lambda k: (sizes[k], k))
        others = [v for k, v in sizes.items() if k != best]
        margin = (min(others) - sizes[best]) / min(others) if others else 1.0
        score = 1.0 / (1.0 + sum(math.exp(-min(700.0, (v - sizes[best]) / TEMPERATURE)) for v in others))
        out[i] = best, score, margin, margin < MIN_MARGIN
    return out


def classify(model: DictionaryModel, text: str | None) -> tuple[str, float, float, bool]:
    return classify_all(model, [text])[0]


def identify(docs: DataFrame, model: DictionaryModel, text: str = "text", into: str = "language") -> DataFrame:
    """Add the struct column ``into``: lang, score, margin, rejected. No shuffle.

    Null and empty texts and texts without a letter: ``und`` with score 0, rejected. Ties go to the first
    language by name and are rejected (margin 0). Repeated rows are judged alike; very long texts whole.
    Other columns pass through; one already called ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang:string,score:double,margin:double,rejected:boolean>")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = classify_all(model, batch.to_pylist())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "score", "margin", "rejected"])

    return docs.withColumn(into, identified(F.col(text)))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: fit on the stage's own labelled rows, drop what is rejected; columns unchanged."""
    columns = docs.columns
    return identify(docs, fit(docs), into="__language").where(~F.col("__language.rejected")).select(*columns)
