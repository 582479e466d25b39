"""Zstandard raw-content dictionaries as text models: sampling labelled text, sizing texts against a dictionary."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Dictionary bytes that a worker keeps as ready compressors. Texts come in batches and a batch goes through
#: one label at a time, so that beyond it a compressor is rebuilt once a batch, not once a text.
READY_BYTES = 64_000_000
#: A label column has at most this many values, else fitting fails: a model holds a dictionary for each.
MOST_LABELS = 10_000

_ready: OrderedDict[tuple, tuple[int, zstandard.ZstdCompressor]] = OrderedDict()


@dataclass(frozen=True)
class DictionaryModel:
    """Raw dictionary contents by label; ``sizes`` compresses whole texts against each of them.

    Texts are cut into ``chunk``-byte pieces so that the dictionary, not the text's own past, explains it.
    """

    contents: dict[str, bytes]
    level: int = 9
    chunk: int = 1024
    keys: dict[str, str] = field(default_factory=dict)

    def compressor(self, label: str) -> zstandard.ZstdCompressor:
        content = self.contents[label]
        key = (self.keys.get(label) or hashlib.md5(content).hexdigest(), self.level)
        if key in _ready:
            _ready.move_to_end(key)
            return _ready[key][1]
        if len(content) >= 8:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            made = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        else:
            made = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False)
        held = sum(n for n, _ in _ready.values())
        while _ready and held + len(content) > READY_BYTES:
            held -= _ready.popitem(last=False)[1][0]
        _ready[key] = (len(content), made)
        return made

    def sizes(self, raws: list[bytes]) -> dict[str, list[int]]:
        """Label -> the encoded size of each text."""
        step = self.chunk
        cut = [[raw[i : i + step] for i in range(0, max(len(raw), 1), step)] for raw in raws]
        out = {}
        for label in self.contents:
            compress = self.compressor(label).compress
            out[label] = [sum([len(compress(p)) for p in pieces]) for pieces in cut]
        return out


def model_of(contents: dict[str, bytes], **options) -> DictionaryModel:
    return DictionaryModel(contents, keys={k: hashlib.md5(v).hexdigest() for k, v in contents.items()}, **options)


def excerpt(text: str, chars: int, pieces: int = 4) -> str:
    """A text of up to ``chars`` characters is taken whole; of a longer one, equal pieces from its start to its very end."""
    if len(text) <= chars:
        return text
    width = chars // pieces
    return "\n".join(text[at : at + width] for at in (round(i * (len(text) - width) / (pieces - 1)) for i in range(pieces)))


def bounded_sample(scratch: Scratch, rows: DataFrame, label: str, key: Column, keep: list[str], per_label: int) -> tuple[DataFrame, dict[str, int]]:
    """(sample, rows by label). The sample: ``label, rank`` (from 1), ``*keep``, for each label the ``per_label``
    distinct keys with the smallest hashes, or all where there are fewer.

    Copies of a key are one key, however many there are. A hash threshold from the approximate number of
    distinct keys (with room for six standard errors) thins the rows before they meet; the hashes left, about
    ``per_label`` a label, are ranked on the driver. Null labels are left out; ``keep`` is the least of a key's values.
    """
    spark = scratch.spark
    hashed = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.xxhash64(key, F.lit("sample")).alias("__key"), *keep)
    counted = hashed.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("__key", 0.02).alias("keys"))
    counts = counted.limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} values are no labels")
    wanted = 1.12 * (per_label + 6 * per_label**0.5 + 16)
    shares = spark.createDataFrame([(r["label"], min(1.0, wanted / max(1, r["keys"]))) for r in counts], "label string, share double")
    position = F.pmod("__key", F.lit(1 << 30)) / float(1 << 30)
    thin = hashed.join(F.broadcast(shares), "label").where((position < F.col("share")) | (F.col("share") >= 1.0))
    thin = scratch.save(thin.groupBy("label", "__key").agg(*[F.min(c).alias(c) for c in keep]), "sample")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in thin.select("label", "__key").collect():  # about per_label hashes a label
        found.setdefault(r["label"], []).append((r["__key"] % (1 << 30), r["__key"]))
    ranks = [(name, k, i + 1) for name, keys in sorted(found.items()) for i, (_, k) in enumerate(sorted(keys)[:per_label])]
    ranked = spark.createDataFrame(ranks, "label string, __key bigint, rank int")
    return thin.join(F.broadcast(ranked), ["label", "__key"]).select("label", "rank", *keep), {r["label"]: r["n"] for r in counts}
