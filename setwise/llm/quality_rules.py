"""Operator 6, quality rules: repetition coverage.

Rolling hashes over several n-gram lengths find the words that lie inside n-grams found twice or more in
the same text; the characters of those words over all word characters are the coverage. Lines equal to an
earlier line are measured the same way. Everything is per row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: n-gram length -> largest share of word characters that may lie inside duplicated n-grams of that length.
NGRAM_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest share of word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Words and the share of words in repeated 5-word windows (percent) of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_KEEP_WORD_BYTES = bytes(i for i in range(256) if i not in SPACES and not 0x80 <= i < 0xC0)
_NOT_WORD_STARTS = bytes(set(range(256)) - set(_KEEP_WORD_BYTES))
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to count-1 of the multiplier and of its inverse mod 2^64; kept, and grown by doubling."""
    if len(_known[0]) < count:
        size = 1 << max(10, (count - 1).bit_length())
        for i, base in enumerate((int(_MULTIPLIER), pow(int(_MULTIPLIER), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _known[i] = np.cumprod(steps, dtype=np.uint64)
    return _known[0][:count], _known[1][:count]


_known: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def rolling_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all windows of ``n`` ids, rolled in one pass whatever ``n``.

    Running sums of id times power of the multiplier: a window's hash is the difference of two of them,
    shifted back by the power at which the window starts. That power is odd, so it has an inverse mod 2^64.
    """
    count = len(ids) - n + 1
    up, down = _powers(len(ids))
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(_mixed(ids) * up, out=sums[1:])
    return (sums[n:] - sums[:-n]) * down[:count]


def repeated_mask(ids: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside an ``n``-word window found twice or more. Equal hashes are checked word by word."""
    mask = np.zeros(len(ids), bool)
    if len(ids) <= n:
        return mask
    hashes = rolling_hashes(ids, n)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return mask
    left, right = order[:-1][same], order[1:][same]
    if all(np.array_equal(ids[left + i], ids[right + i]) for i in range(n)):
        starts = np.zeros(len(hashes), bool)
        starts[left] = starts[right] = True
    else:  # a hash collision: count the windows themselves
        windows = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        starts = counts[inverse.ravel()] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str | None) -> dict:
    """All figures of one text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    ascii_only = raw.isascii()
    lengths = np.fromiter(map(len, words) if ascii_only else (len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    total = int(lengths.sum())
    out = {"n_words": len(words), "word_chars": total, "n_symbols": len(raw.translate(None, _NOT_SYMBOLS))}
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += len(line.translate(None, _NOT_WORD_STARTS))
        elif line.split(None, 1):
            seen.add(line)
    out["n_dup_lines"] = dup_lines
    out["dup_line_coverage"] = dup_line_chars / total if total else 0.0
    out["n_repeat_words"] = 0
    narrower = None
    for n in sorted({5, *NGRAM_LIMITS}):
        # a longer repeat contains shorter ones, so nothing is left to find once a length finds nothing
        mask = narrower if narrower is not None and not narrower.any() else repeated_mask(ids, n)
        narrower = mask
        if n == 5:
            out["n_repeat_words"] = int(mask.sum())
        out[f"coverage_{n}"] = float(lengths[mask].sum() / total) if total else 0.0
    return out


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    base_failed = m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]
    kept = not base_failed and m["dup_line_coverage"] <= LINE_LIMIT and all(m[f"coverage_{n}"] <= limit for n, limit in NGRAM_LIMITS.items())
    return base_failed, kept


COLUMNS = (
    {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}
    | {"dup_line_coverage": pa.float64()}
    | {f"coverage_{n}": pa.float64() for n in NGRAM_LIMITS}
    | {"base_failed": pa.bool_(), "kept": pa.bool_()}
)
_SQL_TYPES = {pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}
_STRUCT = "struct<" + ",".join(f"{k}:{_SQL_TYPES[v]}" for k, v in COLUMNS.items()) + ">"


def _measure_all(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        m = measure(text.as_py())
        m["base_failed"], m["kept"] = verdict(m)
        rows.append(m)
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], v) for k, v in COLUMNS.items()], names=list(COLUMNS))


def repetition_coverage(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Add the struct column ``into`` with all measures and the verdict.

    Null and empty texts: no words, so ``base_failed``. Repeated rows and null ids: each row on its own. Very
    long texts are measured whole; a measure that ties with its limit passes.
    Other columns pass through, whatever their names; a column already called ``into`` is replaced.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf(_STRUCT)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _measure_all(batch)

    return docs.withColumn(into, measured(F.col(text)))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text passes; columns unchanged."""
    columns = docs.columns
    return repetition_coverage(docs, into="__quality").where(F.col("__quality.kept")).select(*columns)
