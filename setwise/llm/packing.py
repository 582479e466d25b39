"""Operator 7, best-fit packing by sums of squares.

Texts become token ids; texts longer than a sequence are cut into whole sequences and one shorter first
piece. How pieces share sequences depends on their lengths alone, so the packing is planned on the
histogram of lengths (at most ``budget`` rows): longest first, each piece goes into the open bin that makes
the sum of squared counts of open bins per residual gap smallest, and opens a bin only where none fits
(weighing a new bin in the same sum costs bins when the longest come first; README has figures).

Pieces of one length are placed in runs of a 16th of those left, whatever their number, so the last 16 go
one by one. The plan's size and time grow with the logarithm of the number of pieces. Pieces then find
their place by their rank among pieces of their length, through counts per partition: no sort, no group in
one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, bound_batches

#: A run is this part of a length's pieces that are left: a plan has about RUNS * ln(pieces) rows a length.
RUNS = 16
#: Parts into which a length's ranks are divided, for the join that looks a piece's place up.
SLOTS = 64

#: The byte-level pre-token pattern.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pre-tokenizer of such files.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Texts with other characters, or with very long runs, take the library's own path.
_UNUSUAL = re.compile("[^\x00-ɏ‐-⁞]|[^ \n]{1000}|[ \n\t]{1000}")


class ByteTokenizer:
    """Ids of a byte-level BPE file, as its library gives them with ``add_special_tokens=False``.

    The same merges run in a faster encoder for usual texts, where the vocabulary's order is that of the merges
    and the pre-tokens are the usual ones; any other file is left to the library.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.fast = None
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab(with_added_tokens=False)
        of_char = {v: k for k, v in _byte_alphabet().items()}
        ranks = {bytes(of_char[c] for c in token): i for token, i in vocab.items() if token not in special}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        in_order = [vocab.get(t) for t in joined] == list(range(256, 256 + len(joined)))
        usual = {k: v for k, v in (spec.get("pre_tokenizer") or {}).items() if k != "trim_offsets"} == _PRE_TOKENIZER and spec.get("normalizer") is None
        plain = not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        if in_order and usual and plain and sorted(ranks.values()) == list(range(len(ranks))):
            self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> list[int]:
        text = text or ""
        if self.fast is None or _UNUSUAL.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


def _byte_alphabet() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def cut(n: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: a shorter first piece, then whole sequences."""
    first = n % budget
    starts = ([0] if first else []) + list(range(first, n, budget))
    return [(s, (first if s == 0 and first else budget)) for s in starts]


def plan(hist: dict[int, int], budget: int, runs: int = RUNS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Sum-of-squares packing of a histogram: ([(length, first_rank, n, first_bin, offset)], bins).

    Ranks number the pieces of a length; pieces first_rank, ... first_rank + n - 1 go to bins first_bin, ... at
    that offset. A run goes to bins of one gap: the one where a piece changes the sum least (the tightest of
    equals), the latest bins of that gap first.
    """
    count = np.zeros(budget + 1, np.int64)  # open bins per residual gap
    pools: list[list[tuple[int, int]]] = [[] for _ in range(budget + 1)]  # their numbers, as (first, n)
    rows, bins = [], 0
    never = np.int64(1) << 60
    for length in sorted((k for k, v in hist.items() if v > 0), reverse=True):
        rank, total = 0, hist[length]
        while rank < total:
            here = count[length:]
            # change of the sum when a bin of gap g (from ``length`` up) takes the piece; full bins don't count
            change = np.where(here > 0, 2 - 2 * here + 2 * count[: budget + 1 - length], never)
            if here[0] > 0:
                change[0] = 1 - 2 * here[0]
            best = int(change.argmin())
            n = -(-(total - rank) // runs)
            if change[best] >= never:
                gap, taken = budget, [(bins, n)]
                bins += n
            else:
                gap, taken = length + best, []
                n = min(n, int(count[gap]))
                count[gap] -= n
                left = n
                while left:
                    first, have = pools[gap].pop()
                    use = min(have, left)
                    if use < have:
                        pools[gap].append((first, have - use))
                    taken.append((first + have - use, use))
                    left -= use
            for first, use in taken:
                rows.append((length, rank, use, first, budget - gap))
                rank += use
            if gap > length:
                pools[gap - length] += taken
                count[gap - length] += n
    return rows, bins


def _slot_size(pieces: int) -> int:
    return -(-pieces // SLOTS)


def _slots(hist: dict[int, int], rows: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
    """The plan for an equi-join: rows cut where the slot of a length's ranks ends."""
    out = []
    for length, rank, n, first, offset in rows:
        size = _slot_size(hist[length])
        shift = first - rank
        while n:
            part = min(n, size - rank % size)
            out.append((length, rank // size, rank, rank + part, shift, offset))
            rank, n = rank + part, n - part
    return pd.DataFrame(out, columns=["length", "slot", "first_rank", "end_rank", "shift", "offset"]).astype("int64")


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"


def tokenized_pieces(docs: DataFrame, path: str, end_id: int, budget: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; ``part``, ``nth``: the task and the piece's number among its task's pieces of that length."""
    bound_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, part = tokenizer(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(value.as_py())
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                for number, (start, length) in enumerate(cut(len(ids), budget)):
                    out.append((key, number, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, path: str, end_id: int = 2, budget: int = 1024) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows with a null or repeated doc_id are packed as rows of
    their own. An empty table gives no rows; extra columns are ignored. Whole sequences get negative ids of
    their own; shared ones count from 0. Pieces of equal length are told apart by their place in the input
    alone. Very long texts give many pieces. The pieces are written once to the shared folder, so a lost
    executor costs a reread.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenized_pieces(docs, path, end_id, budget), "pieces")
    whole = pieces.where(F.col("length") == budget).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (-1 - (F.shiftleft("part", 40) + F.col("nth"))).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    short = pieces.where(F.col("length") < budget)
    by_part = scratch.save(short.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    hist = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under `budget` rows
    if not hist:
        return whole
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sizes = spark.createDataFrame(pd.DataFrame([(k, _slot_size(n)) for k, n in hist.items()], columns=["length", "size"]).astype("int64"))
    ranked = short.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    slotted = ranked.join(F.broadcast(sizes), "length").withColumn("slot", F.expr("rank div size"))  # a row a length
    # the plan is bounded: about RUNS * ln(pieces) rows for each length under the budget
    planned = scratch.save(spark.createDataFrame(_slots(hist, plan(hist, budget)[0])), "plan")
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = slotted.join(F.broadcast(planned), ["length", "slot"]).where(inside)
    return whole.unionByName(placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: pieces and their places."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
