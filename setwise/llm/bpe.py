"""Operator 10, BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so it marks a certain cut.
White space is in no token either. A text therefore falls into words, a word's pre-tokens into fragments;
each fragment is encoded on its own (only a pre-token's last fragment carries the word-end suffix) and the
ids are concatenated.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches

#: Entries of a worker's word and pre-token caches; a full cache is emptied.
CACHE_WORDS, CACHE_PRETOKENS = 400_000, 200_000

#: Little-endian int32 ids, and the decoded text in UTF-8.
Coded = tuple[bytes, bytes]
_EMPTY: Coded = (b"", b"")

#: Words of printable ASCII and Latin-1 letters: normalisation only lower-cases them, character by character.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's pre-token pattern, for such words in lower case.
_PLAIN_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


#: The normaliser and pre-tokenizer of such files, which the plain paths above rely on.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def expected(spec: dict) -> bool:
    """Whether the file is a word-end BPE with the normaliser, pre-tokens, added tokens and decoder relied on here."""
    model, added = spec["model"], spec.get("added_tokens") or []
    plain_model = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("continuing_subword_prefix", "dropout", "ignore_merges", "byte_fallback"))
    plain_tokens = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    pre = spec.get("pre_tokenizer") or {}
    same = spec.get("normalizer") == _NORMALIZER and pre.get("type") == "Sequence" and pre.get("pretokenizers") == _PRE_TOKENIZERS
    return bool(plain_model and plain_tokens and same and not spec.get("decoder") and not spec.get("post_processor"))


class ForcedBoundaryCodec:
    """Encoder and decoder for one tokenizer file of the word-end BPE kind; other files are left to the library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec = spec | {"truncation": None, "padding": None}
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.usual = expected(spec)
        if not self.usual:
            return
        self.suffix = spec["model"]["end_of_word_suffix"]
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = [k.encode() for k in self.special]
        self.inside = set()
        for token in vocab:
            bare = token.removesuffix(self.suffix)
            self.inside.update(map(str.__add__, bare, bare[1:]))
        top = max([*vocab.values(), *self.special.values()])
        self.token_of = [""] * (top + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.token_of[i] = token
        small = "abcdefghijklmnopqrstuvwxyz"
        never = [f"{a}[{b}]" for a in small if (b := "".join(c for c in small if a + c not in self.inside))]
        #: Finds a forced boundary in a run of a-z.
        self.small_cut = re.compile("|".join(never) or "(?!)")
        #: Latin-1 letters as the characters that stand for their two bytes.
        self.latin = {c: self._pretokens(chr(c))[0] for c in range(0xDF, 0x100) if chr(c).isalpha()}
        self.words: dict[bytes, Coded] = {}
        self.pretokens: dict[str, Coded] = {}

    def cuts(self, pretoken: str) -> list[str]:
        """The pre-token's fragments (its characters stand for bytes)."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(pretoken)):
            if pretoken[i - 1 : i + 1] not in inside:
                out.append(pretoken[start:i])
                start = i
        out.append(pretoken[start:])
        return out

    def _pretokens(self, piece: str) -> list[str]:
        normal = self.whole.normalizer.normalize_str(piece) if self.whole.normalizer else piece
        return [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)]

    def _fragment(self, fragment: str, last: bool) -> list[int]:
        return [t.id for t in (self.whole if last else self.inner).model.tokenize(fragment)]

    def _pretoken(self, pretoken: str) -> Coded:
        """The code of a pre-token, its characters standing for bytes."""
        found = self.pretokens.get(pretoken)
        if found is None:
            if len(self.pretokens) >= CACHE_PRETOKENS:
                self.pretokens.clear()
            if pretoken.isascii() and pretoken.isalpha() and not self.small_cut.search(pretoken):
                ids = self._fragment(pretoken, True)
            else:
                parts = self.cuts(pretoken)
                ids = [i for part in parts[:-1] for i in self._fragment(part, False)] + self._fragment(parts[-1], True)
            found = struct.pack(f"<{len(ids)}i", *ids), " ".join([self.token_of[i] for i in ids]).encode()
            if len(pretoken) <= 64:
                self.pretokens[pretoken] = found
        return found

    def _word(self, word: bytes) -> Coded:
        """The code of a run without ASCII white space."""
        if word.isalpha():
            return self._pretoken(word.lower().decode("ascii"))
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and not any(m in word for m in self.marks):
            found = [self._pretoken(p.translate(self.latin)) for p in _PLAIN_PRETOKENS.findall(text.lower())]
        else:
            found = []
            for piece in self.special_split.split(text) if self.special_split else [text]:
                if piece in self.special:
                    found.append((struct.pack("<i", self.special[piece]), piece.encode()))
                elif piece:
                    found += [self._pretoken(p) for p in self._pretokens(piece)]
        if len(found) == 1:
            return found[0]
        return b"".join([v[0] for v in found]), b" ".join([v[1] for v in found])

    def encode_raw(self, text: str | None) -> Coded:
        """The code of a whole text; null counts as empty."""
        if not self.usual:
            ids = self.whole.encode(text or "", add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}i", *ids), self.decode(ids).encode()
        cache = self.words
        words = (text or "").encode("utf-8", "surrogatepass").split()
        found = list(map(cache.get, words))
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    v = found[i] = self._word(w)
                    if len(w) <= 64:
                        cache[w] = v
            if len(cache) > CACHE_WORDS:
                cache.clear()
        if _EMPTY in found:
            found = [v for v in found if v[0]]
        return b"".join([v[0] for v in found]), b" ".join([v[1] for v in found])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw(text)[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        if not self.usual:
            return self.whole.decode(ids, skip_special_tokens=False)
        return " ".join([self.token_of[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", into: str = "bpe") -> DataFrame:
    """Add the struct column ``into``: ids array<int> and decoded string. No shuffle.

    Null and empty texts: no ids, empty string. Special tokens' strings in a text become their ids, as the
    library does. Very long texts and words are encoded whole; merges of equal rank go left to right. Repeated
    rows each on their own, null ids too; an empty table gives no rows. Other columns pass through; one already
    called ``into`` is replaced. ``path`` must exist on every executor (it comes with an installed package).
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            pairs = [own.encode_raw(t.as_py()) for t in batch]
            ends = np.zeros(len(pairs) + 1, np.int64)
            np.cumsum([len(p[0]) // 4 for p in pairs], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join([p[0] for p in pairs]))])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.StructArray.from_arrays([ids, pa.array([p[1] for p in pairs], pa.binary()).cast(pa.string())], names=["ids", "decoded"])

    return docs.withColumn(into, encoded(F.col(text)))
